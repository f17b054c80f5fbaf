"""From what a user selects to the change units of a plan, with everything that these need."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from ..model import Schema, fold
from .schema_diff import ObjectDiff

DATABASE, TABLE, ROW = "Database", "Table", "Row"


@dataclass(frozen=True)
class Selection:
    """A whole database, an object, or a row of it."""

    scope: str
    object: str | None = None
    row: str | None = None

    def covers(self, other: Selection) -> bool:
        if self.scope == DATABASE:
            return True
        if fold(self.object or "") != fold(other.object or "") or other.scope == DATABASE:
            return False
        return self.scope == TABLE or other.scope == ROW and self.row == other.row


def normalise(selections: Iterable[Selection]) -> list[Selection]:
    """Without what a wider selection covers, and without repeats."""
    distinct = list(dict.fromkeys(selections))
    return [s for s in distinct if not any(o is not s and o.covers(s) and not (s.covers(o) and distinct.index(s) < distinct.index(o)) for o in distinct)]


@dataclass(frozen=True)
class Unit:
    """One change: of an object's schema or of its data."""

    object: str
    kind: str  # Create, Alter, Drop, Data
    row: str | None = None

    @property
    def id(self) -> str:
        return ":".join((self.kind, fold(self.object), *([self.row] if self.row is not None else [])))


@dataclass(frozen=True)
class Exclusion:
    """Leaves out a kind of change of an object."""

    object: str
    kind: str


@dataclass(frozen=True)
class Plan:
    units: tuple[Unit, ...]
    exclusions: tuple[Exclusion, ...]


_KINDS = {"SourceOnly": "Create", "TargetOnly": "Drop", "Different": "Alter"}


def schema_units(diffs: Iterable[ObjectDiff]) -> list[Unit]:
    return [Unit(d.name, _KINDS[d.kind]) for d in diffs if d.changed]


def compile_plan(units: Iterable[Unit], selections: Iterable[Selection], exclusions: Iterable[Exclusion]) -> Plan:
    """Covered units that aren't excluded, once each, and the exclusions that took effect."""
    chosen = normalise(selections)
    left_out = {(fold(e.object), e.kind): e for e in exclusions}
    kept: dict[str, Unit] = {}
    applied: dict[Exclusion, None] = {}
    for unit in units:
        as_selection = Selection(ROW if unit.row is not None else TABLE, unit.object, unit.row)
        if not any(s.covers(as_selection) for s in chosen):
            continue
        if (rule := left_out.get((fold(unit.object), unit.kind))) is not None:
            applied[rule] = None
        else:
            kept.setdefault(unit.id, unit)
    return Plan(tuple(kept.values()), tuple(applied))


@dataclass
class SchemaClosure:
    """required: (object, needed by, why); blocked: needed but excluded; unsatisfiable: needed but nowhere to be had."""

    required: list[tuple[str, str, str]] = field(default_factory=list)
    blocked: list[tuple[str, str]] = field(default_factory=list)
    unsatisfiable: list[str] = field(default_factory=list)


def close_schema(plan: Plan, source: Schema, target: Schema, diffs: Iterable[ObjectDiff]) -> SchemaClosure:
    """Objects that the plan's creations and alterations need and the target lacks, and those that these need."""
    changes = {fold(d.name): d for d in diffs}
    selected = {fold(u.object) for u in plan.units}
    excluded = {fold(e.object) for e in plan.exclusions}
    out = SchemaClosure()
    queue = sorted((u.object for u in plan.units if u.kind in ("Create", "Alter")), key=lambda n: (changes[fold(n)].type if fold(n) in changes else "", fold(n)))
    for name in queue:  # grows as it is walked
        for needed, why in _needs(name, source, target, changes.get(fold(name))):
            key = fold(needed)
            if key in selected:
                continue
            if key in excluded:
                out.blocked.append((needed, name))
            elif key not in changes or not changes[key].changed:
                said = f"{name} needs {needed} ({why}), which no change provides"
                if said not in out.unsatisfiable:
                    out.unsatisfiable.append(said)
            else:
                selected.add(key)
                out.required.append((needed, name, why))
                queue.append(needed)
    return out


def _needs(name: str, source: Schema, target: Schema, diff: ObjectDiff | None) -> list[tuple[str, str]]:
    """What an object needs that the target lacks, with the reason."""
    there = {fold(x.name) for x in (*target.tables, *target.modules, *target.types, *target.sequences)}
    table = source.table(name)
    if table is None:
        module = next((m for m in source.modules if fold(m.name) == fold(name)), None)
        if module is None:
            return []
        needed = [(d, "its text") for d in module.depends_on] + ([(module.table, "its table")] if module.table else [])
        return [(n, why) for n, why in needed if fold(n) not in there]
    created = diff is None or diff.kind == "SourceOnly"
    added = {(c.type, fold(c.name)) for c in diff.children if c.kind == "SourceOnly"} if diff else set()
    out = []
    for column in table.columns:
        if column.type.user_defined and (created or ("Column", fold(column.name)) in added):
            kind = f"{column.type.schema}.{column.type.name}" if column.type.schema else column.type.name
            if fold(kind) not in there:
                out.append((kind, f"the type of {column.name}"))
    for fk in table.foreign_keys:
        if fold(fk.parent) == fold(name) or not (created or ("ForeignKey", fold(fk.name)) in added):
            continue
        parent = target.table(fk.parent)
        if parent is None or any(parent.column(c) is None for c in fk.parent_columns):
            out.append((fk.parent, fk.name))
    return out
