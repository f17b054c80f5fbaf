"""Tables that no statement can bring to the source's form: they are copied into it, counted and swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.literals import qualify, quote
from ..model import Schema, Table, fold


@dataclass(frozen=True)
class Rebuild:
    """Every column of the new table, in order: its type and what of an old row it is."""

    table: str
    why: tuple[str, ...]
    columns: dict[str, tuple[str, str]]
    copy: str

    def sql(self) -> str:
        """Statements of Spark SQL; the count is asserted before anything is dropped."""
        old, new = qualify(*self.table.split(".")), qualify(*self.copy.split("."))
        shown = ",\n  ".join(f"CAST({expression} AS {type_}) AS {quote(name)}" for name, (type_, expression) in self.columns.items())
        return ";\n".join(
            (
                f"CREATE TABLE {new} AS SELECT\n  {shown}\nFROM {old}",
                f"SELECT assert_true((SELECT count(*) FROM {new}) = (SELECT count(*) FROM {old}), 'rows were lost on the way')",
                f"DROP TABLE {old}",
                f"ALTER TABLE {new} RENAME TO {old}",
            )
        )


def blockers(source: Table, target: Table, schema: Schema) -> list[str]:
    """Why a table can't be rebuilt: what a plain copy of it would lose, what is bound to it, what its rows can't fill."""
    found = [f"a copy would lose that it is {s}" for s in target.storage]
    bound = [m.name for m in schema.modules if fold(target.name) in map(fold, m.depends_on) and re.search(r"(?i)\bwith\s+schemabinding\b", m.body)]
    if bound:
        found.append(f"{', '.join(sorted(bound))} can't be without it")
    empty = [c.name for c in source.columns if not (c.nullable or c.default or c.computed or c.identity) and target.column(c.name) is None]
    if empty:
        found.append(f"its rows have nothing for {', '.join(empty)}")
    return found


def rebuild(source: Table, target: Table, schema: Schema, why: list[str]) -> Rebuild:
    """How the target's rows become rows of the source's form; new columns have their default, computed ones are computed."""
    columns = {}
    inner = {fold(c.name): c for c in source.columns if c.computed}

    def expression(text: str, open_: frozenset[str] = frozenset()) -> str:
        """A computed column's text over stored columns only."""
        parts = re.split(r"('(?:[^']|'')*')", re.sub(r"\[([^\]]+)\]", lambda m: quote(m[1]), text))
        name = lambda m: f"({expression(inner[key].computed, open_ | {key})})" if (key := fold(m[0].strip("`"))) in inner and key not in open_ else m[0]
        return "".join(p if p.startswith("'") else re.sub(r"`[^`]+`|[^\W\d]\w*", name, p) for p in parts)

    for c in sorted(source.columns, key=lambda c: c.ordinal):
        old = target.column(c.name)
        if c.computed:
            columns[c.name] = (c.type.spark_name().upper(), expression(c.computed, frozenset({fold(c.name)})))
        elif old is not None:
            columns[c.name] = (c.type.spark_name().upper(), quote(old.name))
        else:
            columns[c.name] = (c.type.spark_name().upper(), c.default or "NULL")
    taken, copy = {fold(t.name) for t in schema.tables}, f"{target.name}__copy"
    while fold(copy) in taken:
        copy += "_"
    return Rebuild(target.name, tuple(why), columns, copy)
