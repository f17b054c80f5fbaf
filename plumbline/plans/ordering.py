"""Dependency order of tables and what hangs on what."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

from ..model import Table, fold


@dataclass(frozen=True)
class Order:
    """ordered: dependencies first; cyclic: in a cycle or behind one, in the order given."""

    ordered: tuple[str, ...]
    cyclic: tuple[str, ...]

    @property
    def all(self) -> tuple[str, ...]:
        return self.ordered + self.cyclic


def topological(nodes: Iterable[str], depends_on: Mapping[str, Iterable[str]]) -> Order:
    """Nodes after what they depend on, the earliest given first; unknown and self dependencies don't count."""
    names = list(nodes)
    index = {fold(n): i for i, n in enumerate(names)}
    users: list[list[int]] = [[] for _ in names]
    waits = [0] * len(names)
    for name, needed in depends_on.items():
        at = index.get(fold(name))
        if at is None:
            continue
        for other in {index[fold(d)] for d in needed if fold(d) in index} - {at}:
            users[other].append(at)
            waits[at] += 1
    ready = [i for i, w in enumerate(waits) if not w]
    heapify(ready)
    out = []
    while ready:
        out.append(at := heappop(ready))
        for user in users[at]:
            waits[user] -= 1
            if not waits[user]:
                heappush(ready, user)
    done = set(out)
    return Order(tuple(names[i] for i in out), tuple(n for i, n in enumerate(names) if i not in done))


class Graph:
    """Parents and children of tables by foreign key; self references and tables outside are left out."""

    def __init__(self, tables: Iterable[Table]) -> None:
        self.tables = {fold(t.name): t for t in tables}
        self.parents: dict[str, list[str]] = {n: [] for n in self.tables}
        self.children: dict[str, list[str]] = {n: [] for n in self.tables}
        for name, table in self.tables.items():
            for parent in dict.fromkeys(fold(fk.parent) for fk in table.foreign_keys):
                if parent in self.tables and parent != name:
                    self.parents[name].append(parent)
                    self.children[parent].append(name)

    def data_order(self) -> Order:
        """Parents before children: inserts in this order, deletes in its reverse."""
        return topological([t.name for t in self.tables.values()], {t.name: self.parents[n] for n, t in self.tables.items()})

    def ancestors(self, name: str) -> list[str]:
        """All tables that a table needs, nearest first."""
        seen, queue = {fold(name): None}, [fold(name)]
        for at in queue:
            for parent in self.parents.get(at, []):
                if parent not in seen:
                    seen[parent] = None
                    queue.append(parent)
        return [self.tables[n].name for n in list(seen)[1:]]

    def neighbourhood(self, name: str, depth: int = 1, direction: str = "both") -> tuple[list[tuple[str, int]], list[tuple[str, str, str, bool]]]:
        """(table, band) around a table, parents in negative bands, and its edges (child, parent, key, nullable).

        depth is 1 to 3; the first visit of a table gives its band; an edge is nullable if all its columns are.
        """
        depth = min(3, max(1, depth))
        bands = {fold(name): 0}
        for step, sides in ((-1, self.parents), (1, self.children)):
            if direction not in ("both", "parents" if step < 0 else "children"):
                continue
            reach = [fold(name)]
            for level in range(1, depth + 1):
                reach = [n for at in reach for n in sides[at] if n not in bands]
                for n in reach:
                    bands.setdefault(n, step * level)
                reach = list(dict.fromkeys(reach))
        edges = []
        for n in bands:
            table = self.tables[n]
            for fk in table.foreign_keys:
                if fold(fk.parent) in bands and fold(fk.parent) != n:
                    nullable = all((c := table.column(x)) is not None and c.nullable for x in fk.columns)
                    edges.append((table.name, self.tables[fold(fk.parent)].name, fk.name, nullable))
        return [(self.tables[n].name, b) for n, b in bands.items()], edges
