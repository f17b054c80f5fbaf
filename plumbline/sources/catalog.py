"""Databases as folders of Parquet tables, with constraints in a JSON file beside them."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from typing import Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Check, ForeignKey, Key, Module, Schema, Sequence, Table, TypeSpec, UserType, fold

from ..plans.collation import Collation, read_collations

SIDECAR = "constraints.json"
#: How names of system objects begin: they are in no comparison.
HIDDEN = ("_", ".", "sys.", "information_schema.")


class Provider(Protocol):
    """What the operators need of a database."""

    def schema(self) -> Schema: ...

    def table(self, name: str) -> DataFrame: ...

    def volume(self) -> DataFrame: ...


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path: any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class ParquetDatabase:
    """Every ``<name>.parquet`` in a folder is a table."""

    def __init__(self, spark: SparkSession, path: str, constraints: dict | None = None) -> None:
        self.spark, self.path, self._given = spark, path.rstrip("/"), constraints

    def names(self) -> list[str]:
        fs, where = _files(self.spark, self.path)
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(n[: -len(".parquet")] for n in found if n.endswith(".parquet") and not n.startswith(HIDDEN))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(name))

    def constraints(self) -> dict:
        """Of the file, or as given: {table: {primary_key, uniques, indexes, foreign_keys, checks, not_null, columns}}, and modules, types, sequences."""
        if self._given is not None:
            return self._given
        fs, where = _files(self.spark, f"{self.path}/{SIDECAR}")
        if not fs.exists(where):
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/{SIDECAR}", wholetext=True).collect()))

    def schema(self) -> Schema:
        """Tables with their constraints; a table that can't be read becomes a warning."""
        held, tables, warnings = self.constraints(), [], []
        for name in self.names():
            try:
                tables.append(_with_constraints(Table.of(name, self.table(name).schema), held.get(name, {})))
            except Exception as e:  # noqa: BLE001  reported, not fatal
                warnings.append(f"{name} could not be read: {type(e).__name__}")
        known = {fold(m["name"]) for m in held.get("modules", [])} | {fold(t.name) for t in tables}
        modules = tuple(Module(m["kind"], m["name"], m["body"], _depends(m, known), m.get("table")) for m in held.get("modules", []))
        types = tuple(UserType(t["name"], t["kind"], t["shape"], _type_keys(t)) for t in held.get("types", []))
        sequences = tuple(Sequence(q["name"], TypeSpec(q.get("type", "bigint")), *[q.get(k, d) for k, d in (("start", 1), ("increment", 1), ("minimum", None), ("maximum", None), ("cycles", False))]) for q in held.get("sequences", []))
        return Schema(self.path.rpartition("/")[2], tuple(tables), modules, types, sequences, tuple(warnings))

    def bytes_of(self, name: str) -> int:
        fs, where = _files(self.spark, self.folder(name))
        return fs.getContentSummary(where).getLength()

    def collations(self, names: list[str]) -> dict[str, Collation]:
        """What the sidecar says of collations by these names, else what Spark knows."""
        stated = {fold(c["name"]): Collation(c["name"], c.get("code_page", 65001), c["style"], c.get("unicode", True)) for c in self.constraints().get("collations", [])}
        return read_collations(self.spark, names) | {n: stated[fold(n)] for n in names if fold(n) in stated}

    def watched(self, name: str, kept_as: str, columns: list[str]):
        """The table as one to scan by its files."""
        from ..operators.rescan import watch_folder

        return watch_folder(self.spark, kept_as, self.folder(name), columns)

    def folder(self, name: str) -> str:
        """Where the files of a table are."""
        return f"{self.path}/{name}.parquet"

    def volume(self) -> DataFrame:
        """table_name, row_count (from file footers), data_bytes."""
        out = None
        for name in self.names():
            one = self.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(self.bytes_of(name)).cast("bigint").alias("data_bytes"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "table_name string, row_count bigint, data_bytes bigint")

    def describe(self) -> dict:
        """Number of tables and modules and bytes; a problem instead of a failure."""
        try:
            schema = self.schema()
            return {"name": schema.name, "tables": len(schema.tables), "modules": len(schema.modules), "bytes": sum(map(self.bytes_of, self.names())), "problem": None}
        except Exception as e:  # noqa: BLE001
            return {"name": self.path, "tables": 0, "modules": 0, "bytes": 0, "problem": str(e).splitlines()[0]}


class CatalogDatabase(ParquetDatabase):
    """The tables and views of a database in Spark's catalog, in whatever format they are stored; constraints as given."""

    def __init__(self, spark: SparkSession, database: str, constraints: dict | None = None) -> None:
        super().__init__(spark, database, constraints or {})
        self.database = database

    def _listed(self, views: bool) -> list[str]:
        found = [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary and (t.tableType == "VIEW") == views]
        return sorted(n for n in found if not n.startswith(HIDDEN))

    def names(self) -> list[str]:
        return self._listed(False)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{name}`")

    def watched(self, name: str, kept_as: str, columns: list[str]):
        """The table as one to scan by its files, in whatever format; its changed files are found among all by their paths."""
        from ..operators.rescan import Watched, files_below

        table, folders = self.table(name), sorted({f.rpartition("/")[0] for f in self.table(name).inputFiles()})
        read = lambda paths: table if paths is None else table.where(F.col("_metadata.file_path").isin([quote(p, safe=":/=") for p in paths]))
        return Watched(kept_as, files_below(self.spark, folders), read, tuple(columns))

    def constraints(self) -> dict:
        """As given, with the views and their texts as modules."""
        views = [{"kind": "VIEW", "name": n, "body": self.spark.sql(f"SHOW CREATE TABLE `{self.database}`.`{n}`").first()[0]} for n in self._listed(True)]
        return {**self._given, "modules": [*self._given.get("modules", []), *views]}

    def bytes_of(self, name: str) -> int:
        sizes = [_files(self.spark, f) for f in self.table(name).inputFiles()]
        return sum(fs.getContentSummary(where).getLength() for fs, where in sizes)


def open_database(spark: SparkSession, kind: str, where: str, constraints: dict | None = None) -> Provider:
    """A provider by name: parquet (a folder) or catalog (a database of Spark's catalog)."""
    known = {"parquet": ParquetDatabase, "catalog": CatalogDatabase}
    if kind not in known:
        raise ValueError(f"{kind!r} is no kind of database; those are {', '.join(known)}")
    return known[kind](spark, where, constraints)


_NAME_OR_SIGN = re.compile(r"""`[^`]*`|\[[^\]]*\]|"[^"]*"|\w+|[.,();]""")
#: After these words a name of a table or routine stands; a comma goes on with names only after FROM and USING.
_BEFORE_NAMES = frozenset("FROM JOIN USING INTO UPDATE EXEC EXECUTE CALL TABLE REFERENCES".split())
_END_OF_LIST = frozenset("WHERE GROUP ORDER HAVING WINDOW UNION EXCEPT INTERSECT SELECT SET VALUES ON LIMIT".split())


def names_in(body: str) -> list[str]:
    """Names that stand where tables or routines do in a statement's text: after FROM, JOIN and the like, after commas of a FROM, and before a bracket.

    Comments and texts in quotes hold no names.
    """
    bare = re.sub(r"/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'", " ", body, flags=re.S)
    signs = _NAME_OR_SIGN.findall(bare)
    found: list[str] = []
    listed = [False]  # by depth of brackets, whether a comma goes on with names
    at = 0
    wanted = False
    while at < len(signs):
        sign = signs[at]
        word = sign.upper()
        at += 1
        if sign == "(":
            listed.append(False)
        elif sign == ")":
            listed = listed[:-1] or [False]
            wanted = False
        elif sign == ",":
            wanted = listed[-1]
        elif word in _BEFORE_NAMES:
            wanted, listed[-1] = True, word in ("FROM", "USING")
        elif word in _END_OF_LIST:
            wanted, listed[-1] = False, False
        elif sign not in ".;":
            parts = [sign]
            while at + 1 < len(signs) and signs[at] == ".":
                parts.append(signs[at + 1])
                at += 2
            called = at < len(signs) and signs[at] == "("
            if wanted or called:
                found.append(".".join(p.strip('`[]"') for p in parts))
            wanted = False
    return found


def _depends(module: dict, known: set[str]) -> tuple[str, ...]:
    """What a module needs: as stated, and every known name that its text uses as a table or routine."""
    stated = dict.fromkeys(module.get("depends_on", ()))
    for name in names_in(module["body"]):
        plain = name if fold(name) in known else name.rpartition(".")[2]
        if fold(plain) in known and fold(plain) != fold(module["name"]) and fold(plain) not in {fold(n) for n in stated}:
            stated[plain] = None
    return tuple(stated)


def _keys(held: list[dict], unique: bool) -> tuple[Key, ...]:
    return tuple(Key(k["name"], tuple(k["columns"]), k.get("unique", unique), k.get("filter"), tuple(k.get("included", ())), k.get("kind", "btree")) for k in held)


def _type_keys(held: dict) -> tuple[str, ...]:
    """Keys, checks and indexes of a type of tables, each as a text, in no order of the catalog's."""
    keys = [f"PRIMARY KEY ({', '.join(held['primary_key'])})"] if held.get("primary_key") else []
    keys += [f"UNIQUE ({', '.join(k['columns'])})" for k in held.get("uniques", [])]
    keys += [f"INDEX {k['name']} ({', '.join(k['columns'])})" for k in held.get("indexes", [])]
    keys += [f"CHECK ({c['expression']})" for c in held.get("checks", [])]
    return tuple(sorted(keys))


def _with_constraints(table: Table, held: dict) -> Table:
    never_null = {c.lower() for c in [*held.get("not_null", []), *held.get("primary_key", [])]}
    more = {fold(n): v for n, v in held.get("columns", {}).items()}  # identity, computed, default, collation, generated
    return replace(
        table,
        columns=tuple(replace(c, nullable=c.nullable and c.name.lower() not in never_null, **more.get(fold(c.name), {})) for c in table.columns),
        primary_key=tuple(held.get("primary_key", ())),
        uniques=_keys(held.get("uniques", []), True),
        indexes=_keys(held.get("indexes", []), False),
        foreign_keys=tuple(
            ForeignKey(k["name"], tuple(k["columns"]), k["parent"], tuple(k["parent_columns"]), k.get("on_delete", "NO ACTION"), k.get("on_update", "NO ACTION"), k.get("disabled", False)) for k in held.get("foreign_keys", [])
        ),
        checks=tuple(Check(c["name"], c["expression"], tuple(c.get("columns", ()))) for c in held.get("checks", [])),
        statistics=_keys(held.get("statistics", []), False),
        storage=tuple(held.get("storage", ())),
    )


def constraints_of(table: Table) -> dict:
    """What a sidecar has to say of a table, so that reading it gives the same."""
    keys = lambda of: [{"name": k.name, "columns": list(k.columns), "unique": k.unique, "filter": k.filter, "included": list(k.included), "kind": k.kind} for k in of]
    more = {c.name: {n: v for n, v in (("identity", c.identity), ("computed", c.computed), ("default", c.default), ("collation", c.collation), ("generated", c.generated)) if v} for c in table.columns}
    return {
        "primary_key": list(table.primary_key),
        "not_null": [c.name for c in table.columns if not c.nullable],
        "columns": {n: v for n, v in more.items() if v},
        "uniques": keys(table.uniques),
        "indexes": keys(table.indexes),
        "statistics": keys(table.statistics),
        "foreign_keys": [{"name": k.name, "columns": list(k.columns), "parent": k.parent, "parent_columns": list(k.parent_columns), "on_delete": k.on_delete, "on_update": k.on_update, "disabled": k.disabled} for k in table.foreign_keys],
        "checks": [{"name": c.name, "expression": c.expression, "columns": list(c.columns)} for c in table.checks],
        "storage": list(table.storage),
    }


def probe(spark: SparkSession) -> dict:
    return {"version": spark.version, "catalog": spark.catalog.currentCatalog(), "database": spark.catalog.currentDatabase()}


def list_databases(spark: SparkSession, root: str) -> DataFrame:
    """name and data_bytes of each folder under root that holds a table."""
    fs, where = _files(spark, root)
    rows = []
    for status in fs.listStatus(where):
        if status.isDirectory():
            names = [s.getPath() for s in fs.listStatus(status.getPath())]
            tables = [p for p in names if p.getName().endswith(".parquet") and not p.getName().startswith(HIDDEN)]
            if tables and not status.getPath().getName().startswith(HIDDEN):
                rows.append((status.getPath().getName(), sum(fs.getContentSummary(p).getLength() for p in tables)))
    return spark.createDataFrame(rows, "name string, data_bytes bigint")


def columns_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """table_name, ordinal, column_name, type, nullable of all tables."""
    rows = [(t.name, c.ordinal, c.name, str(c.type), c.nullable) for t in schema.tables for c in t.columns]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean")


def constraints_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """table_name, kind, constraint_name, columns (in the constraint's order) of all keys."""
    rows = []
    for t in schema.tables:
        keys = [("primary key", "", t.primary_key)] if t.primary_key else []
        keys += [("unique", k.name, k.columns) for k in t.uniques] + [("index", k.name, k.columns) for k in t.indexes] + [("foreign key", k.name, k.columns) for k in t.foreign_keys]
        rows += [(t.name, kind, name, i, c) for kind, name, columns in keys for i, c in enumerate(columns)]
    of = spark.createDataFrame(rows, "table_name string, kind string, constraint_name string, place int, column_name string")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "column_name"))), lambda x: x["column_name"])
    return of.groupBy("table_name", "kind", "constraint_name").agg(listed.alias("columns"))


def catalog_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    """Every column with the kinds of keys that it is in, sorted; none is an empty list."""
    held = constraints_frame(spark, schema).select("table_name", "kind", F.explode("columns").alias("column_name"))
    kinds = held.groupBy("table_name", "column_name").agg(F.sort_array(F.collect_set("kind")).alias("keys"))
    joined = columns_frame(spark, schema).join(kinds, ["table_name", "column_name"], "left")
    return joined.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
