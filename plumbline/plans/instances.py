"""Which databases of two instances belong together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import fold


@dataclass(frozen=True)
class Pair:
    source: str | None
    target: str | None
    kind: str  # Declared, ByName, SourceOnly, TargetOnly


def match(source: list[str], target: list[str], declared: list[tuple[str, str]] = ()) -> tuple[list[Pair], list[str]]:
    """Pairs and problems: declared ones in order, then by name, then what is left of either side."""
    here, there = {fold(n): n for n in source}, {fold(n): n for n in target}
    pairs, problems = [], []
    used_here: set[str] = set()
    used_there: set[str] = set()
    for a, b in declared:
        x, y = fold(a.strip()), fold(b.strip())
        if not x or not y:
            problems.append("a declared pair lacks a name")
        elif x in used_here:
            problems.append(f"{a} is declared twice")
        elif x not in here or y not in there:
            problems.append(f"{a if x not in here else b} doesn't exist")
        else:
            pairs.append(Pair(here[x], there[y], "Declared"))
            used_here.add(x)
            used_there.add(y)
    for x, name in here.items():
        if x not in used_here and x in there and x not in used_there:
            pairs.append(Pair(name, there[x], "ByName"))
            used_here.add(x)
            used_there.add(x)
    pairs += [Pair(name, None, "SourceOnly") for x, name in here.items() if x not in used_here]
    pairs += [Pair(None, name, "TargetOnly") for x, name in there.items() if x not in used_there]
    rank = {"Declared": 0, "ByName": 0, "SourceOnly": 1, "TargetOnly": 2}
    return sorted(pairs, key=lambda p: (rank[p.kind], fold(p.source or p.target or ""))), problems


def match_frames(source: DataFrame, target: DataFrame, declared: DataFrame) -> DataFrame:
    """The same for name lists that are tables: source_name, target_name, kind."""
    lower = lambda df, c, alias: df.select(F.col(c).alias(alias), F.lower(c).alias(f"{alias}_key"))
    s, t = lower(source, "name", "source_name"), lower(target, "name", "target_name")
    d = declared.select(F.lower("source_name").alias("dk"), F.lower("target_name").alias("dt"))
    first = s.join(d, F.col("source_name_key") == F.col("dk")).join(t, F.col("dt") == F.col("target_name_key"))
    first = first.select("source_name", "target_name", F.lit("Declared").alias("kind"))
    rest_s = s.join(first.select(F.lower("source_name").alias("u")), F.col("source_name_key") == F.col("u"), "left_anti")
    rest_t = t.join(first.select(F.lower("target_name").alias("u")), F.col("target_name_key") == F.col("u"), "left_anti")
    kind = F.when(F.col("target_name").isNull(), "SourceOnly").when(F.col("source_name").isNull(), "TargetOnly").otherwise("ByName")
    named = rest_s.join(rest_t, F.col("source_name_key") == F.col("target_name_key"), "full_outer").select("source_name", "target_name", kind.alias("kind"))
    return first.unionByName(named)


@dataclass(frozen=True)
class Described:
    """What is known of one database without comparing it."""

    tables: int = 0
    views: int = 0
    routines: int = 0
    collation: str | None = None
    accessible: bool = True
    state: str = "ONLINE"
    problem: str | None = None

    @property
    def counts(self) -> tuple[int, int, int]:
        return self.tables, self.views, self.routines


@dataclass(frozen=True)
class _Facts:
    """Of a pair, what signals are told from."""

    pair: Pair
    known: tuple[Described | None, Described | None]

    @property
    def sides(self) -> list[str]:
        return [side for side, name in (("source", self.pair.source), ("target", self.pair.target)) if name is not None]

    @property
    def troubles(self) -> list[str]:
        """Why a side can't be read."""
        told = []
        for side, d in zip(("source", "target"), self.known):
            closed = d and ("no access" if not d.accessible else d.state.lower() if d.state.upper() != "ONLINE" else d.problem)
            told += [f"{side}: {closed}"] if closed else []
        return told

    def differing(self, measure: str) -> list[str]:
        """Both sides' values of a measure, if they aren't the same."""
        a, b = (getattr(d, measure) for d in self.known)
        alike = a == b if not isinstance(a or b, str) else fold(a or "") == fold(b or "")
        return [] if alike else [str(a), str(b)]


#: Signals, whose names are fixed, the first that holds counts: when, and in words. Equal counts are no equal schemas.
_SIGNALS = (
    ("SourceOnly", lambda f: f.sides == ["source"], lambda f: "the target hasn't it; a plan never makes databases"),
    ("TargetOnly", lambda f: f.sides == ["target"], lambda f: "the source hasn't it; a plan never drops databases"),
    ("Unreadable", lambda f: f.troubles, lambda f: "; ".join(f.troubles)),
    ("NotCompared", lambda f: None in f.known, lambda f: "not looked into so far"),
    ("CollationDiffers", lambda f: f.differing("collation"), lambda f: " and ".join(f.differing("collation")) + " order and match texts differently"),
    ("CountsDiffer", lambda f: f.differing("counts"), lambda f: "tables, views and routines: " + " and ".join(f.differing("counts"))),
    ("CountsMatch", lambda f: True, lambda f: f"{f.known[0].counts} tables, views and routines on either side; only a comparison shows whether they are alike"),
)


def signal(pair: Pair, source: Described | None = None, target: Described | None = None) -> tuple[str, str]:
    """What a pair says at a glance, and in words."""
    facts = _Facts(pair, (source, target))
    return next((name, told(facts)) for name, holds, told in _SIGNALS if holds(facts))


def survey(source: dict[str, Described | None], target: dict[str, Described | None], declared: list[tuple[str, str]] = ()) -> tuple[list[tuple[Pair, str, str]], list[str]]:
    """Each pair with its signal, and warnings. None: not read yet."""
    pairs, problems = match(list(source), list(target), declared)
    rows = [(p, *signal(p, source.get(p.source), target.get(p.target))) for p in pairs]
    both = [r for r in rows if r[0].kind in ("Declared", "ByName")]
    if source and target and not both:
        problems.append("no name is on both sides, so nothing is compared; databases of other names may belong together: declare such pairs")
    if unread := [r for r in both if r[1] == "NotCompared"]:
        problems.append(f"{len(unread)} pairs weren't read yet")
    return rows, problems
