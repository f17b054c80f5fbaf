"""Change scripts: ordered statements with what couldn't be expressed, and their packaging."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.literals import literal_column, qualify, quote
from ..model import Column, Schema, Table, fold
from ..sources.store import materialize
from .dependents import Holders, Node
from .ordering import Graph, topological
from .rebuild import Rebuild, blockers, rebuild
from .schema_diff import ObjectDiff, narrowing, rename_header
from .selection import Plan

#: Order of a script's steps.
PHASES = (
    "Schemas DropForeignKeys DropKeys DropProgrammables DropTables DropTypes DropSequences CreateSequences CreateTypes CreateTables AlterColumns Keys Indexes "
    "SecondaryIndexes CheckConstraints AddForeignKeys DataDeletes DataUpserts Programmables"
).split()
_RANK = {p: i for i, p in enumerate(PHASES)}


@dataclass(frozen=True)
class Step:
    phase: str
    object: str
    sql: str
    destructive: bool = False


@dataclass
class Script:
    steps: list[Step] = field(default_factory=list)
    refusals: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rebuilds: dict[str, Rebuild] = field(default_factory=dict)
    blocked: set[str] = field(default_factory=set)  # tables that should be rebuilt and can't be: nothing of them is scripted

    def ordered(self) -> list[Step]:
        """By phase; within one, as added."""
        return sorted(self.steps, key=lambda s: _RANK[s.phase])

    @property
    def destructive(self) -> list[Step]:
        return [s for s in self.ordered() if s.destructive]

    def text(self) -> str:
        steps = self.ordered()
        head = [f"-- {len(steps)} steps"] + [f"-- refused: {r}" for r in self.refusals] + [f"-- warning: {w}" for w in self.warnings]
        body = [f"-- {i}/{len(steps)} {s.phase}: {s.object}\n{s.sql};" for i, s in enumerate(steps, 1)]
        return "\n".join(head + body) + "\n"


def column_sql(c: Column) -> str:
    tail = "" if c.nullable else " NOT NULL"
    default = f" DEFAULT {c.default}" if c.default else ""
    made = f" GENERATED ALWAYS AS ({c.computed})" if c.computed else ""
    return f"{quote(c.name)} {c.type}{made}{default}{tail}"


def create_table(table: Table) -> str:
    lines = [column_sql(c) for c in table.columns]
    if table.primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(map(quote, table.primary_key))})")
    lines += [f"CONSTRAINT {quote(k.name)} UNIQUE ({', '.join(map(quote, k.columns))})" for k in table.uniques if not k.filter]
    return f"CREATE TABLE {qualify(*table.name.split('.'))} (\n  " + ",\n  ".join(lines) + "\n)"


def column_change(target: Column | None, source: Column | None) -> str:
    """How a column gets from one side to the other: add, drop, default, computed, rebuild, alter or none."""
    if target is None or source is None:
        return "add" if target is None else "drop"
    if (target.computed or source.computed) and target.computed != source.computed:
        return "computed"
    if target.identity != source.identity:
        return "rebuild"
    if target.type != source.type or target.nullable != source.nullable or target.collation != source.collation:
        return "alter"
    return "default" if target.default != source.default else "none"


#: Why an index isn't carried over, by its kind.
INDEX_REASONS = {
    "btree": "Spark finds rows by the statistics of files, so sort or bucket the table by these columns instead",
    "columnstore": "Parquet is stored by columns already",
    "spatial": "Spark has no shapes to index",
    "xml": "Spark has no documents to index",
    "fulltext": "Spark has no search over words",
    "hash": "bucketing takes its place",
}


def index_refusal(table: str, key) -> str:
    """That an index isn't carried over, with its kind and the reason."""
    parts = [f"{'unique ' if key.unique else ''}{key.kind} index on {', '.join(key.columns)}"] + [f"including {', '.join(key.included)}"] * bool(key.included) + [f"where {key.filter}"] * bool(key.filter)
    return f"{table}.{key.name}: an index has no counterpart ({' '.join(parts)}): {INDEX_REASONS.get(key.kind, 'Spark has no such index')}"


def schema_script(plan: Plan, source: Schema, target: Schema, diffs: Iterable[ObjectDiff]) -> Script:
    """Statements for the plan's schema units; what Spark SQL can't express is refused, not left out silently."""
    out = Script()
    by_name = {fold(d.name): d for d in diffs}
    modules = {fold(m.name): m for m in source.modules}
    created = []
    units = [(u, by_name[fold(u.object)]) for u in plan.units if u.kind != "Data" and fold(u.object) in by_name]
    _changes_between_tables(out, [d for u, d in units if d.type == "Table" and u.kind == "Alter"], {fold(d.name) for u, d in units if d.type == "Table" and u.kind == "Drop"}, source, target)
    for unit, diff in units:
        name = qualify(*unit.object.split("."))
        if diff.type == "Table":
            if fold(diff.name) in out.rebuilds:
                _rebuild_steps(out, name, source.table(unit.object))
            elif fold(diff.name) not in out.blocked:
                _table_steps(out, unit.kind, name, source.table(unit.object), target.table(unit.object), diff)
        elif diff.type.upper() in ("VIEW", "FUNCTION", "PROCEDURE", "TRIGGER"):
            if unit.kind == "Drop":
                out.steps.append(Step("DropProgrammables", unit.object, f"DROP {diff.type.upper()} IF EXISTS {name}", True))
            elif diff.type.upper() == "VIEW":
                created.append(unit.object)
            else:
                out.refusals.append(f"{unit.object}: a {diff.type.lower()} has no counterpart")
        else:
            out.refusals.append(f"{unit.object}: a {diff.type.lower()} has no counterpart")
    order = topological(created, {n: modules[fold(n)].depends_on for n in created})
    for name in order.all:
        body = rename_header(modules[fold(name)].body, "VIEW", name)
        out.steps.append(Step("Programmables", name, body.replace("CREATE VIEW", "CREATE OR REPLACE VIEW", 1)))
    if order.cyclic:
        out.warnings.append("these depend on each other: " + ", ".join(order.cyclic))
    return out


_CHILD_NODES = {"ForeignKey": "ForeignKey", "UniqueConstraint": "Unique", "CheckConstraint": "Check", "PrimaryKey": "PrimaryKey", "Index": "Index"}


def _changes_between_tables(out: Script, altered: list[ObjectDiff], dropped: set[str], source: Schema, target: Schema) -> None:
    """Which tables are rebuilt, and what else has to go before columns and keys change and come back after, each once over the whole plan.

    What the plan itself drops, alone or with its table, isn't touched here; what goes and can't come back is refused.
    """
    holders = Holders(target)
    changed, vanished, by_plan = {}, set(), {}
    for diff in altered:
        name, old, new = fold(diff.name), target.table(diff.name), source.table(diff.name)
        for child in diff.children:
            if child.type in _CHILD_NODES and child.kind != "SourceOnly":
                by_plan[Node(_CHILD_NODES[child.type], name, "" if child.type == "PrimaryKey" else fold(child.name))] = None
            if child.type == "Column" and child.kind != "SourceOnly":
                a, b = old.column(child.name), new.column(child.name)
                change, node = column_change(a, b), Node("Column", name, fold(child.name))
                if change == "drop":
                    vanished.add(node)
                if change in ("drop", "computed", "rebuild") or change == "alter" and (a.type != b.type or a.collation != b.collation):
                    changed[node] = change
    while True:
        starts = [n for n in (*changed, *by_plan) if n.table not in out.blocked]
        down = holders.reach(starts)
        out.rebuilds = {name: rebuild(source.table(name), target.table(name), target, why) for name, why in _reasons(down, changed, by_plan).items() if name not in dropped}
        stops = {name: blockers(source.table(name), target.table(name), target) for name in out.rebuilds}
        if not any(stops.values()):
            break
        for name, found in stops.items():  # without these tables less has to come down
            if found:
                out.blocked.add(name)
                out.refusals.append(f"{source.table(name).name}: {'; '.join(out.rebuilds[name].why)}; it can't be rebuilt: {'; '.join(found)}")
    down += [n for name in out.rebuilds for n in holders.refers_to(name) if n not in down]
    for node in down:
        if node in by_plan or node.table in dropped or node.kind in ("Column", "PrimaryKey") or node.kind != "ForeignKey" and node.table in out.rebuilds:
            continue
        table, held = holders.tables[node.table], holders.objects[node]
        of = qualify(*table.name.split("."))
        if node.kind == "Module":
            told = sorted(c.name for c in changed if c.table == node.table)
            out.warnings.append(f"{held.name} reads {table.name}, of which {', '.join(told)} changes")
        elif node.kind == "Index":
            out.warnings.append(f"{table.name}.{held.name}: this index holds what changes and goes with it")
        elif node.kind == "Default":
            column = Node("Column", node.table, node.name)
            new = source.table(table.name).column(held.name) if column in changed and source.table(table.name) else None
            if column in changed and column not in vanished and new is not None and new.default == held.default:
                out.steps.append(Step("DropKeys", table.name, f"ALTER TABLE {of} ALTER COLUMN {quote(held.name)} DROP DEFAULT"))
                out.steps.append(Step("Keys", table.name, f"ALTER TABLE {of} ALTER COLUMN {quote(held.name)} SET DEFAULT {held.default}"))
        elif node.kind == "ForeignKey" and not _still_there(held, source, dropped):
            out.refusals.append(f"{table.name}.{held.name}: it refers to what the plan takes from {held.parent}, and isn't dropped by the plan")
        else:
            out.steps.append(Step("DropForeignKeys" if node.kind == "ForeignKey" else "DropKeys", table.name, f"ALTER TABLE {of} DROP CONSTRAINT {quote(held.name)}"))
            if node.table not in out.rebuilds:  # a rebuilt table gets its keys from the source
                out.steps.append(_restored(node.kind, of, table.name, held))


def _reasons(down: list[Node], changed: dict[Node, str], by_plan: Iterable[Node]) -> dict[str, list[str]]:
    """By table, why no statement makes its changes."""
    why: dict[str, list[str]] = {}
    for node in down:
        change = changed.get(node)
        if change in ("computed", "rebuild"):
            why.setdefault(node.table, []).append(f"{node.name} becomes or ceases to be {'computed' if change == 'computed' else 'an identity'}")
        elif node.kind == "Column" and change is None:
            why.setdefault(node.table, []).append(f"{node.name} is computed from what changes")
        elif node.kind == "PrimaryKey":
            why.setdefault(node.table, []).append("its primary key changes" if node in by_plan else "its primary key holds what changes")
    return why


def _still_there(fk, source: Schema, dropped: set[str]) -> bool:
    """Whether the source's parent still has the columns of a key, as a key."""
    parent = source.table(fk.parent)
    if parent is None or fold(fk.parent) in dropped:
        return False
    return all(parent.column(c) for c in fk.parent_columns) and bool(Holders(Schema("", (parent,))).keys_on(fk.parent, fk.parent_columns))


def _restored(kind: str, of: str, table: str, held) -> Step:
    if kind == "ForeignKey":
        return Step("AddForeignKeys", table, _add_key(of, held))
    if kind == "Check":
        return Step("CheckConstraints", table, f"ALTER TABLE {of} ADD CONSTRAINT {quote(held.name)} CHECK ({held.expression})")
    return Step("Keys", table, f"ALTER TABLE {of} ADD CONSTRAINT {quote(held.name)} UNIQUE ({', '.join(map(quote, held.columns))})")


def _rebuild_steps(out: Script, name: str, source: Table) -> None:
    """The copy, its count and the swap, then all that the source has on the table."""
    made = out.rebuilds[fold(source.name)]
    out.steps.append(Step("AlterColumns", source.name, f"-- rebuilt: {'; '.join(made.why)}\n{made.sql()}", True))
    if source.primary_key:
        out.steps.append(Step("Keys", source.name, f"ALTER TABLE {name} ADD PRIMARY KEY ({', '.join(map(quote, source.primary_key))})"))
    for c in source.columns:
        if not c.nullable:
            out.steps.append(Step("Keys", source.name, f"ALTER TABLE {name} ALTER COLUMN {quote(c.name)} SET NOT NULL"))
        if c.default and not c.computed:
            out.steps.append(Step("Keys", source.name, f"ALTER TABLE {name} ALTER COLUMN {quote(c.name)} SET DEFAULT {c.default}"))
        if c.identity:
            out.warnings.append(f"{source.name}.{c.name}: numbers are kept; Spark gives no next ones")
        if c.computed:
            out.warnings.append(f"{source.name}.{c.name}: values are computed once; Spark doesn't keep them up")
    out.steps += [_restored("Unique", name, source.name, k) for k in source.uniques if not k.filter]
    out.steps += [_restored("Check", name, source.name, k) for k in source.checks]
    out.steps += [_restored("ForeignKey", name, source.name, k) for k in source.foreign_keys]
    out.refusals += [index_refusal(source.name, k) for k in (*source.indexes, *[u for u in source.uniques if u.filter])]


def _table_steps(out: Script, kind: str, name: str, source: Table | None, target: Table | None, diff: ObjectDiff) -> None:
    if kind == "Drop":
        out.steps.append(Step("DropTables", diff.name, f"DROP TABLE {name}", True))
    elif kind == "Create":
        out.steps.append(Step("CreateTables", diff.name, create_table(source)))
        out.refusals += [index_refusal(diff.name, k) for k in (*source.indexes, *[u for u in source.uniques if u.filter])]
        out.refusals += [f"{diff.name}.{c.name}: an identity has no counterpart" for c in source.columns if c.identity]
        for fk in source.foreign_keys:
            out.steps.append(Step("AddForeignKeys", diff.name, _add_key(name, fk)))
        for check in source.checks:
            out.steps.append(Step("CheckConstraints", diff.name, f"ALTER TABLE {name} ADD CONSTRAINT {quote(check.name)} CHECK ({check.expression})"))
    else:
        for child in diff.children:
            _child_step(out, name, source, target, child)


def _child_step(out: Script, name: str, source: Table, target: Table, child: ObjectDiff) -> None:
    if child.type != "Column":
        if child.type == "ForeignKey" and child.kind == "SourceOnly":
            out.steps.append(Step("AddForeignKeys", source.name, _add_key(name, next(k for k in source.foreign_keys if fold(k.name) == fold(child.name)))))
        elif child.type == "ForeignKey" and child.kind == "TargetOnly":
            out.steps.append(Step("DropForeignKeys", source.name, f"ALTER TABLE {name} DROP CONSTRAINT {quote(child.name)}"))
        elif child.type in ("UniqueConstraint", "CheckConstraint") or child.type == "ForeignKey":
            if child.kind != "SourceOnly":
                phase = "DropForeignKeys" if child.type == "ForeignKey" else "DropKeys"
                out.steps.append(Step(phase, source.name, f"ALTER TABLE {name} DROP CONSTRAINT {quote(child.name)}"))
            if child.kind != "TargetOnly":
                out.steps.append(_added(name, source, child))
        else:
            key = next((k for k in (source if child.kind != "TargetOnly" else target).indexes if fold(k.name) == fold(child.name)), None)
            out.refusals.append(index_refusal(source.name, key) if key and child.type == "Index" else f"{source.name}.{child.name}: a {child.type} can't be changed by a statement")
        return
    old, new = target.column(child.name), source.column(child.name)
    change = column_change(old, new)
    if change == "add":
        out.steps.append(Step("AlterColumns", source.name, f"ALTER TABLE {name} ADD COLUMNS ({column_sql(new)})"))
    elif change == "drop":
        out.steps.append(Step("AlterColumns", source.name, f"ALTER TABLE {name} DROP COLUMN {quote(child.name)}", True))
    elif change == "alter":
        loss = narrowing(old, new)
        if loss.kind != "None":
            out.warnings.append(loss.why)
        alter = f"ALTER TABLE {name} ALTER COLUMN {quote(child.name)} "
        if old.type != new.type or old.collation != new.collation:
            out.steps.append(Step("AlterColumns", source.name, f"{alter}TYPE {new.type}" + (f" COLLATE {new.collation}" if new.collation else ""), loss.kind == "Narrows"))
        if old.nullable != new.nullable:
            out.steps.append(Step("AlterColumns", source.name, f"{alter}{'DROP' if new.nullable else 'SET'} NOT NULL"))
    if change in ("alter", "default") and old.default != new.default:
        out.steps.append(Step("AlterColumns", source.name, f"ALTER TABLE {name} ALTER COLUMN {quote(child.name)} " + (f"SET DEFAULT {new.default}" if new.default else "DROP DEFAULT")))


def _added(name: str, source: Table, child: ObjectDiff) -> Step:
    """The step that adds a constraint as the source has it."""
    own = {"UniqueConstraint": source.uniques, "CheckConstraint": source.checks, "ForeignKey": source.foreign_keys}[child.type]
    found = next(k for k in own if fold(k.name) == fold(child.name))
    if child.type == "ForeignKey":
        return Step("AddForeignKeys", source.name, _add_key(name, found))
    body = f"CHECK ({found.expression})" if child.type == "CheckConstraint" else f"UNIQUE ({', '.join(map(quote, found.columns))})"
    return Step("CheckConstraints" if child.type == "CheckConstraint" else "Keys", source.name, f"ALTER TABLE {name} ADD CONSTRAINT {quote(found.name)} {body}")


def _add_key(name: str, fk) -> str:
    columns, parents = (", ".join(map(quote, c)) for c in (fk.columns, fk.parent_columns))
    return f"ALTER TABLE {name} ADD CONSTRAINT {quote(fk.name)} FOREIGN KEY ({columns}) REFERENCES {qualify(*fk.parent.split('.'))} ({parents})" + "".join(f" ON {event} {action}" for event, action in (("DELETE", fk.on_delete), ("UPDATE", fk.on_update)) if action.upper() != "NO ACTION")


def statements(change_set: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """``ordinal`` (deletes, inserts, updates), the keys and ``sql``: one statement a row of the change set."""
    kinds: StructType = change_set.schema
    shown = {c: literal_column(F.col(f"`{c}`"), kinds[c].dataType) for c in change_set.columns if c not in ("op", "target_hash")}
    name = qualify(*table.split("."))
    pair = lambda c: F.concat(F.lit(f"{quote(c)} = "), shown[c])
    where = F.concat(F.lit(" WHERE "), F.concat_ws(" AND ", *[F.when(F.col(f"`{k}`").isNull(), F.lit(f"{quote(k)} IS NULL")).otherwise(pair(k)) for k in keys]))
    values = [c for c in shown if c not in keys]
    insert = F.concat(F.lit(f"INSERT INTO {name} ({', '.join(map(quote, shown))}) VALUES ("), F.concat_ws(", ", *shown.values()), F.lit(")"))
    update = F.concat(F.lit(f"UPDATE {name} SET "), F.concat_ws(", ", *[pair(c) for c in values]), where)
    sql = F.when(F.col("op") == "Delete", F.concat(F.lit(f"DELETE FROM {name}"), where)).when(F.col("op") == "Insert", insert).otherwise(update)
    ordinal = F.when(F.col("op") == "Delete", 0).when(F.col("op") == "Insert", 1).otherwise(2)
    return change_set.select(ordinal.alias("ordinal"), *[F.col(f"`{k}`") for k in keys], sql.alias("sql"))


#: Rows of one INSERT.
BATCH_ROWS = 1_000


def numbered(df: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """df with the place of each row in the order of its keys, nulls first, from 0.

    Rows are dealt by ranges of the key and sorted there; a row's place is its place in its range and the rows of all
    ranges before. The ranges' sizes, a number a range, are all that meets in one place.
    """
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    shown = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    # the low 33 bits of such an id count the rows of a partition; written, so that both reads see the same ranges
    held = materialize(dealt.select(*shown, F.monotonically_increasing_id().alias("id")).select("*", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at")), "numbered")
    sizes = {r["range"]: r["n"] for r in held.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [(-1, 0)], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    offsets = df.sparkSession.createDataFrame(before, "part long, before long")
    placed = held.join(F.broadcast(offsets), F.col("range") == F.col("part"))
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], (F.col("before") + F.col("at")).alias(name))


def insert_batches(change_set: DataFrame, table: str, keys: list[str], size: int = BATCH_ROWS) -> DataFrame:
    """``batch``, ``rows`` and ``sql``: the inserts of a change set in the order of their keys, so many rows a statement."""
    inserts = change_set.where("op = 'Insert'").drop("op", "target_hash")
    shown = [literal_column(F.col(f"`{c}`"), inserts.schema[c].dataType) for c in inserts.columns]
    head = f"INSERT INTO {qualify(*table.split('.'))} ({', '.join(map(quote, inserts.columns))}) VALUES\n"
    rows = numbered(inserts, keys, "__number").select("__number", F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(")")).alias("row"))
    batches = rows.groupBy(F.floor(F.col("__number") / size).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("__number", "row"))).alias("r"))
    return batches.select("batch", F.size("r").alias("rows"), F.concat(F.lit(head), F.array_join(F.col("r.row"), ",\n")).alias("sql"))


def data_order(tables: Iterable[Table]) -> tuple[list[str], list[str]]:
    """(tables by which to delete: children first, tables by which to insert: parents first)."""
    order = list(Graph(tables).data_order().all)
    return order[::-1], order


def package(script: Script, files: dict[str, str] | None = None) -> tuple[str, bytes]:
    """(file name, bytes): the script alone, or with its data files and a note in a zip."""
    if not files:
        return "script.sql", script.text().encode()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("script.sql", script.text())
        for name, text in files.items():
            z.writestr(f"data/{name}", text)
        z.writestr("README.txt", "Run script.sql; it loads the files in data/.\n")
    return "script.zip", held.getvalue()
