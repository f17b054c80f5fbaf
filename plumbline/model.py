"""Metadata of tables and schemas: what is known before any row is read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql.types import DataType, DecimalType, StringType, StructType


def fold(name: str) -> str:
    """Names are equal whatever their case."""
    return name.lower()


# Types of other catalogs, by the Spark type that holds their values. Names that Spark has mean Spark's types.
_SPARK_NAMES = {
    "bit": "boolean", "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "real": "float", "float4": "float", "float8": "double", "double precision": "double",
    "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "nvarchar": "string", "varchar": "string", "nchar": "string", "char": "string", "text": "string", "ntext": "string", "bpchar": "string",
    "sysname": "string", "xml": "string", "json": "string", "jsonb": "string", "uniqueidentifier": "string", "uuid": "string", "time": "string", "varbinary": "binary", "image": "binary", "bytea": "binary",
    "rowversion": "binary", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "datetimeoffset": "timestamp", "timestamptz": "timestamp",
}


@dataclass(frozen=True)
class TypeSpec:
    """A column type as a catalog names it; equal whatever the name's case."""

    name: str
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    is_max: bool = False
    user_defined: bool = False
    schema: str | None = None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, TypeSpec) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def _key(self) -> tuple:
        return fold(self.name), self.max_length, self.precision, self.scale, self.is_max, self.user_defined, self.schema and fold(self.schema)

    def __str__(self) -> str:
        name = f"{self.schema}.{self.name}" if self.user_defined and self.schema else self.name.upper()
        if self.is_max:
            return f"{name}(MAX)"
        if self.max_length is not None:
            return f"{name}({self.max_length})"
        if self.precision is not None:
            return f"{name}({self.precision}{'' if self.scale is None else f',{self.scale}'})"
        return name

    def spark_name(self) -> str:
        """The Spark type that holds its values, as DDL writes it; a name that isn't known stays as it is."""
        name = fold(self.name)
        if name in ("decimal", "numeric"):
            return f"decimal({self.precision or 10},{self.scale or 0})"
        return _SPARK_NAMES.get(name, name)

    def spark(self) -> DataType:
        """The same as a type; raises where there is none."""
        try:
            return DataType.fromDDL(self.spark_name())
        except Exception as e:
            raise ValueError(f"no Spark type holds {self}") from e

    @staticmethod
    def of(kind: DataType) -> TypeSpec:
        """The spec of a Spark type."""
        if isinstance(kind, DecimalType):
            return TypeSpec("decimal", precision=kind.precision, scale=kind.scale)
        if isinstance(kind, StringType):
            return TypeSpec("string")
        return TypeSpec(kind.simpleString())


@dataclass(frozen=True)
class Column:
    name: str
    type: TypeSpec
    nullable: bool = True
    ordinal: int = 0
    collation: str | None = None
    identity: str | None = None
    computed: str | None = None
    default: str | None = None
    generated: bool = False  # a row version: never compared


@dataclass(frozen=True)
class Key:
    name: str
    columns: tuple[str, ...]
    unique: bool = True
    filter: str | None = None
    included: tuple[str, ...] = ()
    kind: str = "btree"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    disabled: bool = False


@dataclass(frozen=True)
class Check:
    name: str
    expression: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[Key, ...] = ()
    indexes: tuple[Key, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    statistics: tuple[Key, ...] = ()
    storage: tuple[str, ...] = ()  # what the table is beyond an ordinary one: versioned, partitioned, replicated

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if fold(c.name) == fold(name)), None)

    @staticmethod
    def of(name: str, schema: StructType, **constraints) -> Table:
        """A table read from a Spark schema; constraints come from elsewhere."""
        columns = []
        for i, f in enumerate(schema.fields):
            collation = getattr(f.dataType, "collation", None) if isinstance(f.dataType, StringType) else None
            columns.append(Column(f.name, TypeSpec.of(f.dataType), f.nullable, i, collation, generated=bool(f.metadata.get("generated")), computed=f.metadata.get("computed")))
        return Table(name, tuple(columns), **constraints)


@dataclass(frozen=True)
class Module:
    """A view, routine or trigger: text and what it depends on."""

    kind: str
    name: str
    body: str
    depends_on: tuple[str, ...] = ()
    table: str | None = None


@dataclass(frozen=True)
class UserType:
    """An alias, composite, table or enum type; one of tables has keys, checks and indexes of its own."""

    name: str
    kind: str
    shape: str
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sequence:
    name: str
    type: TypeSpec
    start: int = 1
    increment: int = 1
    minimum: int | None = None
    maximum: int | None = None
    cycles: bool = False


@dataclass(frozen=True)
class Schema:
    name: str
    tables: tuple[Table, ...] = ()
    modules: tuple[Module, ...] = ()
    types: tuple[UserType, ...] = ()
    sequences: tuple[Sequence, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if fold(t.name) == fold(name)), None)

    @property
    def object_count(self) -> int:
        return len(self.tables) + len(self.modules) + len(self.types) + len(self.sequences)

    def with_tables(self, *tables: Table) -> Schema:
        return replace(self, tables=tables)
