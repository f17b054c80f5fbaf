"""One comparison of two databases, from the first look to the applied change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.predicate import to_spark
from .model import Column, Key, Schema, fold
from .operators import closure, columns, compare, drift, keys, rescan, screen
from .operators.rescan import FingerprintStore
from .plans import collation, detail, fk_map, guards, schema_diff, script, selection, sizes
from .plans.rebuild import rebuild
from .sources.catalog import ParquetDatabase, constraints_of
from .sources.manifest import Conflict, State, Transaction, VersionedDatabase
from .sources.snapshot import SnapshotTable
from .sources.store import materialize


class NotComparable(ValueError):
    """Why a table can't be compared as asked."""


@dataclass
class TableChoice:
    """How a table's rows are chosen for the plan."""

    mode: str = "AllRows"
    top: int = 100
    predicate: str | None = None
    picks: DataFrame | None = None


@dataclass
class CompareSession:
    """State: key overrides, chosen tables, exclusions, and what the last script was built on."""

    source: ParquetDatabase
    target: ParquetDatabase
    options: schema_diff.Options = field(default_factory=schema_diff.Options)
    limits: guards.Limits = field(default_factory=guards.Limits)
    key_overrides: dict[str, tuple[str, ...]] = field(default_factory=dict)
    choices: dict[str, TableChoice] = field(default_factory=dict)
    selections: list[selection.Selection] = field(default_factory=list)
    exclusions: list[selection.Exclusion] = field(default_factory=list)
    reviewed: DataFrame | None = None
    reviewed_state: State | None = None
    planned: selection.Plan = selection.Plan((), ())
    not_rebuilt: set[str] = field(default_factory=set)
    script_bytes: int = 0
    scanned: list[tuple[str, str, str]] | None = None
    kept: FingerprintStore | None = None
    _collations: dict[str, collation.Collation] | None = None

    def __post_init__(self) -> None:
        self.source_schema: Schema = self.source.schema()
        self.target_schema: Schema = self.target.schema()

    # Schemas.

    def schema_diff(self) -> list[schema_diff.ObjectDiff]:
        return schema_diff.schema_diff(self.source_schema, self.target_schema, self.options)

    # Keys.

    def key(self, table: str) -> tuple[str, ...]:
        found = self.source_schema.table(table)
        return self.key_overrides.get(fold(table)) or (columns.default_key(found) if found else ())

    def key_options(self, table: str) -> dict:
        """Declared keys, else a profile of single columns, what is recommended, and a note on every column."""
        found = self.source_schema.table(table)
        declared = columns.declared_keys(found)
        rows = [] if declared else keys.profile(self.source.table(table)).collect()  # a row a column
        profiled = [(r["column_name"], r["could_be_key"]) for r in rows]
        by_column = {fold(r["column_name"]): r for r in rows}
        notes = {c.name: self._key_note(c, declared, by_column.get(fold(c.name))) for c in found.columns}
        return {"declared": [k.columns for k in declared], "profile": profiled, "recommended": keys.recommend([k.columns for k in declared], profiled), "notes": notes}

    @staticmethod
    def _key_note(column: Column, declared: list[Key], measured) -> str:
        """What speaks for or against a column as a key by itself."""
        holder = next((k for k in declared if [fold(c) for c in k.columns] == [fold(column.name)]), None)
        if holder:
            return f"a key by {holder.name or 'the primary key'}"
        part = next((k for k in declared if fold(column.name) in map(fold, k.columns)), None)
        if part:
            return f"part of the key by {part.name or 'the primary key'}"
        if measured is None:
            return "may be null" if column.nullable else "not measured"
        if measured["null_count"]:
            return f"null in {measured['null_count']} of {measured['row_count']} rows"
        return "another value in every row" if measured["could_be_key"] else f"{measured['distinct_count']} values in {measured['row_count']} rows"

    def choose_key(self, table: str, chosen: tuple[str, ...]) -> None:
        """Takes a key that is unique on both sides; raises with the numbers otherwise."""
        for side, database in (("source", self.source), ("target", self.target)):
            row = keys.check_key(database.table(table), list(chosen)).first()
            if why := keys.verdict(row["row_count"], row["distinct_count"], row["null_key_count"]):
                raise NotComparable(f"{side}: {why}")
        self.key_overrides[fold(table)] = tuple(chosen)
        self.scanned = None

    # Data.

    def volumes(self) -> list[dict]:
        """Rows and bytes of every source table on both sides, its key and whether that is declared; the largest first."""
        here, there = ({r["table_name"]: r for r in d.volume().collect()} for d in (self.source, self.target))  # a row a table
        out = []
        for table in self.source_schema.tables:
            a, b, key = here[table.name], there.get(table.name), self.key(table.name)
            state = "none" if not key else "chosen" if fold(table.name) in self.key_overrides else "declared"
            sizes_ = {f"{side}_{n}": (r[f"{'row_count' if n == 'rows' else 'data_bytes'}"] if r else 0) for side, r in (("source", a), ("target", b)) for n in ("rows", "bytes")}
            out.append({"table": table.name, **sizes_, "key": key, "key_state": state, "on_target": b is not None})
        return sorted(out, key=lambda r: (-r["source_bytes"], r["table"]))

    def fk_map(self, table: str, depth: int = 1, direction: str = "both") -> fk_map.FkMap:
        """The neighbourhood of a table, with what the comparison says of it."""
        return fk_map.fk_map(self.source_schema, self.target_schema, self.schema_diff(), table, depth, direction)

    def detail(self, name: str) -> dict:
        """An object's difference in words, and both sides as text."""
        diff = next(d for d in self.schema_diff() if fold(d.name) == fold(name))
        return {"summary": detail.summary(diff)} | {side: self._text_of(schema, name) for side, schema in (("source", self.source_schema), ("target", self.target_schema))}

    @staticmethod
    def _text_of(schema: Schema, name: str) -> str | None:
        if table := schema.table(name):
            return detail.sketch(table)
        return next((m.body for m in schema.modules if fold(m.name) == fold(name)), None)

    # What of the schemas is in the plan.

    def tick(self, name: str, chosen: bool = True) -> dict:
        """Puts an object that differs into the plan, or takes it out; returns the selection's state."""
        unit = next((u for u in selection.schema_units(self.schema_diff()) if fold(u.object) == fold(name)), None)
        if unit is None:
            raise ValueError(f"{name} has no difference to be planned")
        own = selection.Selection(selection.TABLE, unit.object)
        self.exclusions = [e for e in self.exclusions if (fold(e.object), e.kind) != (fold(unit.object), unit.kind)]
        if not chosen:
            self.selections = [s for s in self.selections if not (s.scope == selection.TABLE and fold(s.object or "") == fold(name))]
        covered = any(s.covers(own) for s in self.selections)
        if chosen and not covered:
            self.selections.append(own)
        elif not chosen and covered:  # by the whole database, from which it is left out
            self.exclusions.append(selection.Exclusion(unit.object, unit.kind))
        return self.selection_state()

    def set_scope(self, whole: bool) -> dict:
        """The whole database, or what is in the plan now as single picks; exclusions go."""
        held = self._schema_plan()[1]
        self.exclusions.clear()
        self.selections[:] = [selection.Selection(selection.DATABASE)] if whole else [selection.Selection(selection.TABLE, n) for n in dict.fromkeys(u.object for u in held.units)]
        return self.selection_state()

    def selection_state(self) -> dict:
        """What is in the plan, what else that needs, and what stands against it."""
        diffs, plan = self._schema_plan()
        needed = selection.close_schema(plan, self.source_schema, self.target_schema, diffs)
        made = script.schema_script(plan, self.source_schema, self.target_schema, diffs)
        return {
            "scope": "Database" if any(s.scope == selection.DATABASE for s in self.selections) else "Picked",
            "selected": sorted(u.object for u in plan.units),
            "required": needed.required,
            "conflicts": needed.unsatisfiable + [f"{a} is needed by {b} but excluded" for a, b in needed.blocked] + made.refusals,
            "exclusions": list(self.exclusions),
        }

    def _schema_plan(self) -> tuple[list[schema_diff.ObjectDiff], selection.Plan]:
        diffs = self.schema_diff()
        return diffs, selection.compile_plan(selection.schema_units(diffs), self.selections, self.exclusions)

    def scan(self, again: bool = False) -> DataFrame:
        """State and reason of every table, as found last unless asked again. With kept fingerprints only changed files are read."""
        schema = "table_name string, state string, reason string"
        if self.scanned is not None and not again:
            return self.source.spark.createDataFrame(self.scanned, schema)
        failed: dict[str, str] = {}
        sides: list[dict[str, DataFrame]] = [{}, {}]
        for side, database in zip(sides, (self.source, self.target)):
            for name in database.names():
                try:
                    side[name] = database.table(name)
                except Exception as e:  # noqa: BLE001  reported, not fatal
                    failed[name] = f"could not be read: {type(e).__name__}"
        for side in sides:
            for name in failed:
                side.pop(name, None)
        every = {n: self.key(n) for s in sides for n in s}
        sizes_ = {n: self.source.bytes_of(n) for n in sides[0]}
        if not any(sides):
            rows = []
        elif self.kept is None:
            rows = screen.screened(*sides, every, sizes_, self.limits.scan_bytes)
        else:
            rows = list(map(tuple, screen.screen(*sides, every, sizes_, self.limits.scan_bytes, fingerprints=lambda side, named: self._kept_prints(side, named, failed)).collect()))
        self.scanned = sorted(rows + [(n, "not comparable", why) for n, why in failed.items()])
        return self.source.spark.createDataFrame(self.scanned, schema)

    def _kept_prints(self, side: str, named: dict[str, list[str]], failed: dict[str, str]) -> DataFrame:
        """Fingerprints of a side's tables by what is kept of their files; failed gets what can't be read."""
        database = self.source if side == "source" else self.target
        watched = {f"{side}:{database.path}/{n}": n for n in named}
        found = self.kept.scan(database.watched(n, key, named[n]) for key, n in watched.items())
        failed.update({watched[k]: why for k, why in self.kept.failed.items()})
        names = F.create_map(*[F.lit(x) for pair in watched.items() for x in pair])
        return found.withColumn("table_name", names[F.col("table_name")])

    def request(self, table: str, choice: TableChoice | None = None) -> compare.CompareRequest:
        """The checked request for a table: key, columns, collations, filter."""
        choice = choice or self.choices.get(fold(table)) or TableChoice()
        a, b = self.source_schema.table(table), self.target_schema.table(table)
        if a is None or b is None:
            raise NotComparable(f"{table} is only on {'target' if a is None else 'source'}")
        key = self.key(table)
        if not key:
            raise NotComparable(f"{table} has no primary key; choose one")
        resolved = columns.resolve(a, b, key)
        found = collation.findings(a, b, key, resolved.compared, self.collation_facts())
        if collation.blocked(found):
            raise NotComparable("; ".join(f"{f.column}: {f.why}" for f in found if f.risk == "Blocking"))
        if not resolved.can_compare:
            raise NotComparable(f"{table} has no comparable columns")
        predicate = to_spark(choice.predicate, [x for x in self.source.table(table).dtypes if x[0] in {*key, *resolved.compared}]) if choice.mode == "Filter" else None
        return compare.CompareRequest(key, resolved.compared, choice.mode, choice.top, predicate)

    def compare(self, table: str, choice: TableChoice | None = None) -> dict:
        """Counts, excluded columns, the first 200 changed cells and bytes to fetch."""
        request = self.request(table, choice)
        a, b = self.source.table(table), self.target.table(table)
        counted = {r["classification"]: r["n"] for r in compare.collected(compare.counts(compare.classify(a, b, request)))}
        resolved = columns.resolve(self.source_schema.table(table), self.target_schema.table(table), request.keys)
        return {
            "counts": counted,
            "excluded": resolved.excluded,
            "cells": compare.cell_diffs(a, b, request, 200),
            "transfer": sizes.transfer(counted.get("Insert", 0), counted.get("Update", 0), len(resolved.compared)),
        }

    def collation_facts(self) -> dict[str, collation.Collation]:
        """What is known of all collations of both sides: the source is asked first, the target about the rest."""
        if self._collations is None:
            names = {c.collation for s in (self.source_schema, self.target_schema) for t in s.tables for c in t.columns if c.collation}
            self._collations = collation.facts(names, self.source.collations, self.target.collations)
        return self._collations

    def collation_warnings(self) -> list[str]:
        """What differences of collations mean for this comparison."""
        by_table = {}
        for a in self.source_schema.tables:
            if b := self.target_schema.table(a.name):
                by_table[a.name] = collation.findings(a, b, self.key(a.name), columns.resolve(a, b, self.key(a.name)).compared, self.collation_facts())
        return collation.told(by_table)

    def select(self, table: str, choice: TableChoice) -> None:
        """Puts a table's rows into the plan; SchemaOnly takes them out."""
        if choice.mode == "SchemaOnly":
            self.choices.pop(fold(table), None)
        else:
            self.request(table, choice)
            self.choices[fold(table)] = choice

    def changes(self) -> dict[str, DataFrame]:
        """The change set of every chosen table, written once; closed_changes adds the parents that its rows need."""
        out = {}
        for name, choice in self.choices.items():
            table = self.source_schema.table(name)
            out[table.name] = materialize(compare.changes(self.source.table(table.name), self.target.table(table.name), self.request(table.name), choice.picks), "changes")
        return out

    def closure(self, changes: dict[str, DataFrame]) -> closure.Closure:
        """Parents missing on the target, from the inserts and updates of a plan."""
        written = {n: c.where("op <> 'Delete'") for n, c in changes.items()}
        there = set(self.target.names())
        source = {n: self.source.table(n) for n in self.source.names()}
        target = {n: self.target.table(n) for n in source if n in there}
        links = {t.name: list(t.foreign_keys) for t in self.source_schema.tables}
        return closure.close(written, source, target, links, self.limits.closure_rows)

    def closed_changes(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame], closure.Closure]:
        """Change sets with the parents that their rows need, those of the parents alone, and the closure."""
        changes = self.changes()
        found = self.closure(changes)
        parents = {}
        for name, rows in found.added.items():
            key = self._parent_key(name)
            target = self.target.table(name) if name in self.target.names() else rows.limit(0)
            compared = self.request(name, TableChoice()) if self.key(name) and self.target_schema.table(name) else compare.CompareRequest(key)
            on = [F.col(f"t.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in key]
            there = target.alias("t").join(rows.select(*[F.col(f"`{k}`") for k in key]).alias("s"), on, "left_semi")
            parents[name] = materialize(compare.changes(rows, there, compared), "parents")
        union = {n: c.unionByName(parents[n]) if n in parents else c for n, c in changes.items()}
        return parents | union, parents, found

    def _parent_key(self, name: str) -> tuple[str, ...]:
        """A table's key, else the columns by which a foreign key refers to it."""
        refers = (fk.parent_columns for t in self.source_schema.tables for fk in t.foreign_keys if fold(fk.parent) == fold(name))
        return tuple(self.key(name) or next(refers, ()))

    def script(self) -> script.Script:
        """Schema statements for the selection, data statements for chosen tables, warnings; remembers what was reviewed."""
        self.reviewed_state = self.target.current() if isinstance(self.target, VersionedDatabase) else None
        diffs, plan = self._schema_plan()
        needed = selection.close_schema(plan, self.source_schema, self.target_schema, diffs)
        wanted = {fold(a) for a, _, _ in needed.required}
        closed = selection.Plan(plan.units + tuple(u for u in selection.schema_units(diffs) if fold(u.object) in wanted), plan.exclusions)
        made = script.schema_script(closed, self.source_schema, self.target_schema, diffs)
        self.planned, self.not_rebuilt = closed, made.blocked
        made.refusals += [f"{a} is needed by {b} but excluded" for a, b in needed.blocked] + needed.unsatisfiable
        made.warnings += [f"{a} is needed by {b}: {why}" for a, b, why in needed.required]
        changes, parents, found = self.closed_changes()
        made.warnings += found.warnings
        deletes, inserts = script.data_order(self.source_schema.tables)
        for phase, order in (("DataDeletes", deletes), ("DataUpserts", inserts)):
            for name in order:
                if name in changes:
                    self._data_steps(made, phase, name, changes[name])
        # written, so that what was reviewed stays as it was
        state = self._row_state(parents)
        self.reviewed = state if state is None else materialize(state, "reviewed")
        self.script_bytes = len(made.text().encode())
        return made

    def _data_steps(self, made: script.Script, phase: str, name: str, changes: DataFrame) -> None:
        wanted = changes.where("op = 'Delete'" if phase == "DataDeletes" else "op <> 'Delete'")
        key = list(self._parent_key(name))
        size = sizes.script_size(wanted, key, [c for c in changes.columns if c not in (*key, "op", "target_hash")]).first()["bytes"]
        if phase == "DataDeletes" and name in self.target.names():
            n, rows = wanted.count(), self.target.table(name).count()
            if sizes.delete_share(n, rows, self.limits.delete_share):
                made.warnings.append(f"{name}: {n} of {rows} rows are deleted")
        if size > self.limits.inline_bytes:
            made.steps.append(script.Step(phase, name, f"-- staged: about {size} bytes, applied as a new version of the table", phase == "DataDeletes"))
            return
        inserts = wanted.where("op = 'Insert'")
        for row in script.insert_batches(inserts, name, key).orderBy("batch").collect():  # bounded by inline_bytes
            made.steps.append(script.Step(phase, name, row["sql"]))
        for row in script.statements(wanted.where("op <> 'Insert'"), name, key).orderBy("ordinal", *key).collect():
            made.steps.append(script.Step(phase, name, row["sql"], phase == "DataDeletes"))
        table = self.source_schema.table(name)
        for column in [c.name for c in table.columns if c.identity] if table and phase == "DataUpserts" else []:
            top = inserts.agg(F.max(f"`{column}`").alias("top")).first()["top"]
            if top is not None:
                made.warnings.append(f"{name}.{column}: the next identity has to be above {top}")

    def row_state(self) -> DataFrame | None:
        """Differences of all chosen tables, and of the parents that they need, as they are now."""
        return self._row_state(self.closed_changes()[1])

    def _row_state(self, parents: dict[str, DataFrame]) -> DataFrame | None:
        out = None
        for name in self.choices:
            table = self.source_schema.table(name).name
            request = self.request(table)
            one = drift.snapshot(compare.classify(self.source.table(table), self.target.table(table), request), table, list(request.keys))
            out = one if out is None else out.unionByName(one)
        for name, rows in parents.items():
            out = out.unionByName(drift.snapshot(rows.withColumnRenamed("op", "classification"), name, list(self._parent_key(name))))
        return out.distinct() if parents else out

    def drift(self) -> list[str]:
        """What has changed since the last script, by table."""
        now = self.row_state()
        if now is None:
            return []
        if self.reviewed is None:
            return ["no script of this plan was reviewed"]
        rows = drift.drift_counts(drift.drift(self.reviewed, now)).collect()
        return [f"{r['table_name']}: {r['moved']} moved, {r['settled']} settled, {r['appeared']} appeared" for r in rows]

    def apply(self, tables: VersionedDatabase | dict[str, SnapshotTable], environment: str, confirmation: str, acknowledged: bool = False) -> dict:
        """Applies the change sets if nothing forbids it; returns what blocked or what was done.

        In a versioned database the reviewed plan's tables change at once, columns, keys and rows, and only if none has changed since.
        Tables of their own are all written and counted before the first is pointed to.
        """
        changes, needed, parents = self.closed_changes()
        destructive = tuple(f"deletes in {n}" for n, c in changes.items() if not c.where("op = 'Delete'").isEmpty())
        if isinstance(tables, VersionedDatabase):
            destructive += self._schema_losses()
        request = guards.ApplyRequest(self.target_schema.name, environment, confirmation, acknowledged, destructive, tuple(self.drift()), len(changes), self.script_bytes)
        blocked = guards.blockers(request, self.limits)
        if parents.stopped:
            blocked += parents.warnings
        known = set(tables.names()) if isinstance(tables, VersionedDatabase) else set(tables)
        blocked += [f"{n}: rows that others need can't be written, no versioned table is given" for n in needed if n not in known]
        if isinstance(tables, VersionedDatabase):
            blocked += [f"{n}: it has to be rebuilt and can't be" for n in sorted(self.not_rebuilt)]
        if blocked:
            return {"outcome": "Blocked", "why": blocked}
        order = [n for n in script.data_order(self.source_schema.tables)[1] if n in changes and n in known]
        if isinstance(tables, VersionedDatabase):
            try:
                with tables.transaction(self.reviewed_state) as t:
                    altered = self._apply_schema(t)
                    done = {n: t.apply(n, changes[n], self._parent_key(n), written=True) for n in order} | altered
            except Conflict as e:
                return {"outcome": "Blocked", "why": [str(e)]}
        else:
            done = {n: tables[n].prepare(changes[n], self._parent_key(n), written=True) for n in order}
            before = {n: tables[n].version() for n in order}
            try:
                for name in order:
                    tables[name].point_to(done[name]["version"])
            except Exception:
                for name in order:
                    tables[name].point_to(before[name])
                raise
        self.scanned = None
        return {"outcome": "Applied", "done": done, "warnings": parents.warnings}

    def _schema_losses(self) -> tuple[str, ...]:
        """Tables, columns and values that the planned schema takes from the target."""
        lost = [f"drops {u.object}" for u in self.planned.units if u.kind == "Drop" and self.target_schema.table(u.object)]
        for unit in self.planned.units:
            old, new = self.target_schema.table(unit.object), self.source_schema.table(unit.object)
            if unit.kind == "Alter" and old and new:
                lost += [f"drops {unit.object}.{c.name}" for c in old.columns if new.column(c.name) is None]
                lost += [f"narrows {unit.object}.{c.name}" for c in old.columns if (to := new.column(c.name)) and schema_diff.narrowing(c, to).kind == "Narrows"]
        return tuple(lost)

    def _apply_schema(self, t: Transaction) -> dict[str, dict]:
        """The planned tables with the source's columns and keys; rows stay as far as columns do."""
        done = {}
        for unit in self.planned.units:
            old, new = self.target_schema.table(unit.object), self.source_schema.table(unit.object)
            if unit.kind == "Drop" and old:
                t.drop(old.name)
            elif unit.kind == "Create" and new:
                t.write(new.name, self.source.table(new.name).limit(0), 0)
                t.describe(new.name, constraints_of(new))
            elif unit.kind == "Alter" and old and new:
                t.rebuild(old.name, rebuild(new, old, self.target_schema, []).columns)
                t.describe(old.name, constraints_of(new))
            else:
                continue
            done[unit.object] = {"schema": unit.kind}
        return done
