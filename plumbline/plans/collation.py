"""Whether two sides' collations let rows be compared."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Table, fold


@dataclass(frozen=True)
class Collation:
    """What is known of a collation by its name."""

    name: str
    code_page: int
    style: str
    unicode: bool = True


#: Spark's collations: UTF-8 all, telling case, accents and trailing blanks apart or not.
KNOWN = {
    fold(c.name): c
    for c in (
        Collation("UTF8_BINARY", 65001, "binary"),
        Collation("UTF8_LCASE", 65001, "lcase"),
        Collation("UNICODE", 65001, "cs_as"),
        Collation("UNICODE_CI", 65001, "ci_as"),
        Collation("UNICODE_AI", 65001, "cs_ai"),
        Collation("UNICODE_CI_AI", 65001, "ci_ai"),
    )
}


def read_collations(spark: SparkSession, names: Iterable[str]) -> dict[str, Collation]:
    """What Spark knows of collations by these names; others are left out."""
    wanted = sorted({fold(n) for n in names})
    if not wanted:
        return {}
    rows = spark.sql("SELECT * FROM collations()").where(F.lower("NAME").isin(wanted)).collect()  # a row a name
    short = {"CASE_SENSITIVE": "cs", "CASE_INSENSITIVE": "ci", "ACCENT_SENSITIVE": "as", "ACCENT_INSENSITIVE": "ai"}
    found = {}
    for r in rows:
        own = KNOWN.get(fold(r["NAME"]))
        style = "_".join([short.get(r["CASE_SENSITIVITY"] or "", "cs"), short.get(r["ACCENT_SENSITIVITY"] or "", "as"), (r["LANGUAGE"] or "").lower(), (r["PAD_ATTRIBUTE"] or "").lower()])
        found[fold(r["NAME"])] = own or Collation(r["NAME"], 65001, style)
    return found


def facts(names: Iterable[str], *askers: Callable[[list[str]], dict[str, Collation]]) -> dict[str, Collation]:
    """What is known of collations: the first asked answers for what it knows, the next is asked about the rest only."""
    known: dict[str, Collation] = {}
    left = sorted({fold(n) for n in names})
    for ask in askers:
        if left:
            known |= {fold(n): c for n, c in ask(left).items()}
            left = [n for n in left if n not in known]
    return known


def told(by_table: dict[str, list[Finding]], source: str | None = None, target: str | None = None) -> list[str]:
    """What the findings of a database mean: which tables can't be compared, which differences don't matter here."""
    stopped = sorted(t for t, found in by_table.items() if blocked(found))
    out = [f"not compared for their collations: {', '.join(stopped)}"] if stopped else []
    mild = sum(f.risk == "Advisory" for found in by_table.values() for f in found)
    if mild:
        out.append(f"{mild} columns order or fold texts differently; rows are matched by their very characters, so none of that changes a result")
    if not stopped and fold(source or "") != fold(target or ""):
        out.append(f"the databases default to {source} and {target}, which no compared column takes up")
    return out


@dataclass(frozen=True)
class Finding:
    column: str
    risk: str  # Blocking or Advisory
    why: str


def findings(source: Table, target: Table, keys: tuple[str, ...], compared: tuple[str, ...], known: dict[str, Collation] = KNOWN) -> list[Finding]:
    """What stands against comparing these columns; blocking ones refuse the compare."""
    out = []
    key_names = {fold(k) for k in keys}
    for name in (*keys, *compared):
        a, b = source.column(name), target.column(name)
        if a is None or b is None or not a.collation or not b.collation or fold(a.collation) == fold(b.collation):
            continue
        x, y = known.get(fold(a.collation)), known.get(fold(b.collation))
        if x is None or y is None:
            lost = a.collation if x is None else b.collation
            out.append(Finding(name, "Blocking", f"nothing is known of collation {lost}"))
        elif not x.unicode and not y.unicode and x.code_page != y.code_page:
            out.append(Finding(name, "Blocking", f"code pages {x.code_page} and {y.code_page} hold different characters"))
        elif x.style != y.style:
            risk = "Blocking" if fold(name) in key_names else "Advisory"
            out.append(Finding(name, risk, f"{a.collation} and {b.collation} don't agree on which texts are equal"))
    return out


def blocked(found: list[Finding]) -> bool:
    return any(f.risk == "Blocking" for f in found)
