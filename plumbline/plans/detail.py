"""Differences and tables in words."""

from __future__ import annotations

from collections import Counter

from ..model import Table
from .schema_diff import ObjectDiff


def summary(diff: ObjectDiff) -> str:
    """One line: on which side it is missing, or which kinds of parts and which of its own properties aren't alike."""
    missing = {"SourceOnly": "target", "TargetOnly": "source"}.get(diff.kind)
    if missing:
        return f"missing on the {missing}"
    parts = Counter(child.type for child in diff.children if child.changed)
    told = [f"{kind} x{n}" if n > 1 else kind for kind, n in sorted(parts.items())] + [p.name for p in diff.properties]
    return f"not alike: {', '.join(told)}" if told else "alike"


def sketch(table: Table) -> str:
    """A table as text, to be read side by side."""
    lines = [f"{c.name} {c.type}{'' if c.nullable else ' NOT NULL'}" for c in sorted(table.columns, key=lambda c: c.ordinal)]
    if table.primary_key:
        lines.append(f"PRIMARY KEY ({', '.join(table.primary_key)})")
    lines += [f"UNIQUE {k.name} ({', '.join(k.columns)})" for k in table.uniques]
    lines += [f"{'UNIQUE ' if k.unique else ''}INDEX {k.name} ({', '.join(k.columns)})" for k in table.indexes]
    lines += [f"CHECK {c.name} ({c.expression})" for c in table.checks]
    lines += [f"FOREIGN KEY {k.name} ({', '.join(k.columns)}) REFERENCES {k.parent} ({', '.join(k.parent_columns)})" for k in table.foreign_keys]
    return f"TABLE {table.name}\n" + "".join(f"  {x}\n" for x in lines)
