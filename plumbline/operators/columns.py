"""Which columns of two tables are compared, and why the others aren't."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..model import Key, Table, fold


@dataclass(frozen=True)
class Resolution:
    """Compared columns in order, and (column, reason) of those left out."""

    keys: tuple[str, ...]
    compared: tuple[str, ...]
    excluded: tuple[tuple[str, str], ...]

    @property
    def can_compare(self) -> bool:
        return bool(self.compared)


def resolve(source: Table, target: Table, keys: Iterable[str], ignored: Iterable[str] = ()) -> Resolution:
    """Columns of both sides, by the source's order, without keys; each exclusion has one reason."""
    key_names, skip = {fold(k) for k in keys}, {fold(c) for c in ignored}
    there = {fold(c.name) for c in target.columns}
    compared, excluded = [], []
    for column in sorted(source.columns, key=lambda c: c.ordinal):
        name = fold(column.name)
        if name in key_names:
            continue
        reasons = (
            (name not in there, "only on source"),
            (column.generated, "not comparable"),
            (column.computed is not None, "computed"),
            (name in skip, "excluded by rule"),
        )
        reason = next((text for holds, text in reasons if holds), None)
        if reason:
            excluded.append((column.name, reason))
        else:
            compared.append(column.name)
    here = {fold(c.name) for c in source.columns}
    excluded += [(c.name, "only on target") for c in sorted(target.columns, key=lambda c: c.ordinal) if fold(c.name) not in here | key_names]
    return Resolution(tuple(keys), tuple(compared), tuple(excluded))


def default_key(table: Table) -> tuple[str, ...]:
    """The primary key or nothing; all columns are never guessed."""
    return table.primary_key


def declared_keys(table: Table) -> list[Key]:
    """Unique constraints, and unique indexes without a filter, over columns that can't be null; the shortest first."""
    held = [*table.uniques, *[i for i in table.indexes if i.unique and not i.filter]]
    sound = [k for k in held if k.columns and all((c := table.column(n)) is not None and not c.nullable for n in k.columns)]
    return sorted(sound, key=lambda k: len(k.columns))
