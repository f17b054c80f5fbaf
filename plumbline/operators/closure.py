"""Parents that a change set needs and the target lacks.

Parents of each foreign key are found by an anti and a semi join. Tables are walked from children to
parents; each round works on the rows that the one before has added, so cycles end when nothing new
is found. Rows of a round are written, not recomputed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ForeignKey
from ..sources.store import materialize

MAX_ROWS = 5_000


def _match(a: str, b: str, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{p}`") == F.col(f"{b}.`{q}`") for p, q in pairs])


def references(rows: DataFrame, fk: ForeignKey) -> DataFrame:
    """Distinct parent keys that rows ask for, by the parent's column names; a null asks for nothing."""
    named = rows.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(fk.columns, fk.parent_columns)])
    return named.dropna().distinct()


def missing_parents(rows: DataFrame, fk: ForeignKey, target_parent: DataFrame | None) -> DataFrame:
    """Parent keys that rows ask for and the target lacks; all, if it lacks the table."""
    wanted = references(rows, fk)
    if target_parent is None:
        return wanted
    pairs = [(c, c) for c in fk.parent_columns]
    return wanted.alias("w").join(target_parent.alias("t"), _match("w", "t", pairs), "left_anti")


def orphans(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows of the child whose parent doesn't exist; a null in the key asks for none."""
    asked = child.dropna(subset=list(fk.columns))
    return asked.alias("c").join(parent.alias("p"), _match("c", "p", list(zip(fk.columns, fk.parent_columns))), "left_anti")


@dataclass
class Closure:
    """added: by table, rows to insert besides; required: (parent, rows, child, key); warnings; stopped: whether more are needed."""

    added: dict[str, DataFrame] = field(default_factory=dict)
    required: list[tuple[str, int, str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stopped: bool = False


def close(planned: Mapping[str, DataFrame], source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], keys: Mapping[str, list[ForeignKey]], max_rows: int = MAX_ROWS) -> Closure:
    """The parents, and theirs, that planned rows (inserts and updates by table) need."""
    out = Closure()
    pulled = 0
    queue = [(name, rows) for name, rows in planned.items()]
    while queue:
        name, rows = queue.pop(0)
        for fk in keys.get(name, []):
            if not set(fk.columns) <= set(rows.columns):
                out.warnings.append(f"{fk.name}: {name} was planned without the columns of this key")
                continue
            if fk.parent not in source:
                out.warnings.append(f"{fk.name}: {fk.parent} isn't compared")
                continue
            wanted = missing_parents(rows, fk, target.get(fk.parent))
            pairs = [(c, c) for c in fk.parent_columns]
            for known in (planned.get(fk.parent), out.added.get(fk.parent)):
                if known is not None and set(fk.parent_columns) <= set(known.columns):
                    wanted = wanted.alias("w").join(known.alias("k"), _match("w", "k", pairs), "left_anti")
            wanted = materialize(wanted, "closure")
            n = wanted.count()
            if not n:
                continue
            if pulled + n > max_rows:
                out.warnings.append(f"{fk.name}: {n} more parents would go beyond {max_rows} rows; nothing further was followed")
                out.stopped = True
                return out
            found = materialize(source[fk.parent].alias("s").join(wanted.alias("w"), _match("s", "w", pairs), "left_semi"), "closure")
            if (lost := wanted.alias("w").join(found.alias("f"), _match("w", "f", pairs), "left_anti").count()):
                out.warnings.append(f"{fk.name}: {lost} parents in {fk.parent} are on neither side")
            got = found.count()
            if not got:
                continue
            pulled += got
            out.added[fk.parent] = found if fk.parent not in out.added else out.added[fk.parent].unionByName(found)
            out.required.append((fk.parent, got, name, fk.name))
            queue.append((fk.parent, found))
    return out
