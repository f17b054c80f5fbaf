"""Two tables, row by row: what to insert, update and delete to make the target like the source.

Both sides are one stream of keys and digests, aggregated by key: how many rows each side has of it, and
each side's digest. So one partial aggregate and one exchange find the classes, what is on one side only, and keys that repeat;
no key is dealt twice and nothing is sorted. A repeated key fails the query that reads the result, by a message
that names the side and the key. Null keys are keys. Under TopN and Filter a target row without a source
row means nothing; the target is first cut down to the source's keys or the same predicate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.digest import canonical, display, pair_hash, pair_hex, render
from ..sources.store import materialize

CLASSES = ("Insert", "Update", "Delete", "Same")
MODES = ("SchemaOnly", "AllRows", "TopN", "Filter")


class DuplicateKeys(ValueError):
    """A side has several rows of one key, so rows can't be matched."""


@dataclass(frozen=True)
class CompareRequest:
    """How rows are chosen and matched."""

    keys: tuple[str, ...]
    compared: tuple[str, ...] | None = None
    mode: str = "AllRows"
    top: int = 100
    predicate: str | None = None
    profile: str = "exact"

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("a compare needs a key")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode == "Filter" and not (self.predicate or "").strip():
            raise ValueError("a filter needs a predicate")
        if self.mode == "TopN" and self.top < 1:
            raise ValueError("a limit is 1 at least")


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that more than one row has, with their number ``n``."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").withColumnRenamed("__n", "n")


def collected(df: DataFrame) -> list:
    """The rows of a small result; a repeated key that it met is told as such."""
    try:
        return df.collect()
    except Exception as e:
        if found := re.search(r"the (source|target) has \d+ rows of key \(.*?\)(?=\s|$|\.)", str(e)):
            raise DuplicateKeys(found[0]) from e
        raise


#: Sides in the stream; HIDDEN are rows of the target that a filter leaves out.
_SOURCE, _TARGET, _HIDDEN = 0, 1, 2


def _keyed(df: DataFrame, keys: tuple[str, ...], compared: list[str], profile: str, side: Column) -> DataFrame:
    # rendered in a step of its own: the digests name each text several times
    texts = [render(F.col(f"`{c}`"), df.schema[c].dataType, profile).alias(f"v{i}") for i, c in enumerate(compared)]
    shown = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], *texts, side.cast("int").alias("side"))
    first, second = pair_hash(canonical([(F.col(f"v{i}"), StringType()) for i in range(len(compared))]))
    return rows.select(*shown, first.alias("h1"), second.alias("h2"), "side")


def _by_key(both: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """k0.., n_source, n_target, n_hidden, and the digests of either side."""
    of = lambda side, h: F.max(F.when(F.col("side") == side, F.col(h)))
    count = lambda side: F.count_if(F.col("side") == side)
    digests = [of(side, h).alias(f"{name}{h}") for side, name in ((_SOURCE, "s_"), (_TARGET, "t_")) for h in ("h1", "h2")]
    return both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(count(_SOURCE).alias("n_source"), count(_TARGET).alias("n_target"), count(_HIDDEN).alias("n_hidden"), *digests)


def _unique(rows: DataFrame, n_keys: int) -> DataFrame:
    """rows; reading them fails at a key that repeats on a side."""
    shown = display([F.col(f"k{i}") for i in range(n_keys)])
    told = lambda side, n: F.raise_error(F.concat(F.lit(f"the {side} has "), F.col(n).cast("string"), F.lit(" rows of key ("), shown, F.lit(")"))).cast("boolean")
    return rows.where(F.when(F.col("n_source") > 1, told("source", "n_source")).when(F.col("n_target") > 1, told("target", "n_target")).otherwise(True))


def _same_keys(a: str, b: str, keys: Iterable[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return condition


def top_by_key(df: DataFrame, keys: Iterable[str], n: int) -> DataFrame:
    """The first n rows by key, nulls first: a top-k by partition, no full sort."""
    return df.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(n)


def chosen_rows(source: DataFrame, target: DataFrame, request: CompareRequest) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that the mode compares."""
    if request.mode == "Filter":
        return source.where(request.predicate), target.where(request.predicate)
    if request.mode == "TopN":
        source = top_by_key(source, request.keys, request.top)
        # the limit bounds the size that Spark estimates, and by that it broadcasts these keys or doesn't
        wanted = source.select(*[F.col(f"`{k}`") for k in request.keys])
        target = target.alias("t").join(wanted.alias("w"), _same_keys("t", "w", request.keys), "left_semi")
    return source, target


def classify(source: DataFrame, target: DataFrame, request: CompareRequest, check_keys: bool = True, extra: bool = False) -> DataFrame:
    """Keys, ``classification`` and ``target_hash`` (null for inserts) of every row. Runs nothing.

    With extra also ``key_exists_on_target``, which tells real inserts from rows whose target copy a
    filter leaves out. Unless check_keys is off, reading the result fails where a key repeats.
    """
    keys = request.keys
    compared = [c for c in (request.compared if request.compared is not None else source.columns) if c not in keys]
    if request.mode == "SchemaOnly":
        source, target = source.limit(0), target.limit(0)
    side = F.lit(_TARGET)
    if extra and request.mode == "Filter":
        side = F.when(F.expr(request.predicate), F.lit(_TARGET)).otherwise(_HIDDEN)
        source = source.where(request.predicate)
    else:
        source, target = chosen_rows(source, target, request)
    both = _keyed(source, keys, compared, request.profile, F.lit(_SOURCE)).union(_keyed(target, keys, compared, request.profile, side))
    rows = _by_key(both, keys)
    if request.mode in ("TopN", "Filter"):
        rows = rows.where("n_source > 0")
    if check_keys:
        rows = _unique(rows, len(keys))
    same = (F.col("s_h1") == F.col("t_h1")) & (F.col("s_h2") == F.col("t_h2"))
    kind = F.when(F.col("n_target") == 0, "Insert").when(F.col("n_source") == 0, "Delete").when(same, "Same").otherwise("Update")
    shown = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    more = [((F.col("n_target") > 0) | (F.col("n_hidden") > 0)).alias("key_exists_on_target")] if extra else []
    return rows.select(*shown, kind.alias("classification"), F.when(F.col("n_target") > 0, pair_hex(F.col("t_h1"), F.col("t_h2"))).alias("target_hash"), *more)


def counts(classified: DataFrame) -> DataFrame:
    """``classification`` and its number ``n``."""
    return classified.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def changes(source: DataFrame, target: DataFrame, request: CompareRequest, picks: DataFrame | None = None, check_keys: bool = True) -> DataFrame:
    """The change set: keys, ``op`` (Insert, Update, Delete), the source's values and target_hash.

    picks: keys to keep; None is all, an empty table none.
    """
    if picks is not None and request.mode != "AllRows":
        raise ValueError("rows can be picked only when all rows are compared")
    found = classify(source, target, request, check_keys).where("classification <> 'Same'")
    if picks is not None:
        found = found.alias("c").join(picks.alias("p"), _same_keys("c", "p", request.keys), "left_semi")
    values = [c for c in source.columns if c not in request.keys]
    joined = found.alias("c").join(source.alias("s"), _same_keys("c", "s", request.keys), "left_outer")
    return joined.select(*[F.col(f"c.`{k}`") for k in request.keys], F.col("c.classification").alias("op"), *[F.col(f"s.`{v}`") for v in values], F.col("c.target_hash"))


def unmatched_picks(picks: DataFrame, found: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Picked keys that no difference has."""
    return picks.alias("p").join(found.alias("c"), _same_keys("p", "c", keys), "left_anti")


#: Ranges by which wanted keys are looked for in a table's files.
RANGES = 16


def key_ranges(wanted: DataFrame, key: str, n: int = RANGES) -> list[tuple]:
    """At most n (least, greatest) of a key column that together hold all its values, in order; nulls are in none.

    Keys are dealt by ranges that hold equally many, so far-off groups of keys end in ranges of their own.
    """
    held = wanted.select(F.col(f"`{key}`").alias("k")).where("k is not null")
    parts = held.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("least"), F.max("k").alias("greatest"))
    return sorted((r["least"], r["greatest"]) for r in parts.collect())  # n rows


def fetch(df: DataFrame, wanted: DataFrame, keys: Iterable[str], ranges: list[tuple] | None = None) -> DataFrame:
    """The rows of df with a wanted key. With ranges of the first key column, files and row groups outside of them aren't read."""
    keys = list(keys)
    if ranges is not None:
        column = F.col(f"`{keys[0]}`")
        inside = column.isNull()
        for least, greatest in ranges:
            inside = inside | column.between(least, greatest) if least != greatest else inside | (column == least)
        df = df.where(inside)
    return df.alias("f").join(wanted.select(*[F.col(f"`{k}`") for k in keys]).alias("w"), _same_keys("f", "w", keys), "left_semi")


def cell_diffs(source: DataFrame, target: DataFrame, request: CompareRequest, limit: int | None = 200) -> DataFrame:
    """Keys, ``column_name``, ``source_value`` and ``target_value`` of changed cells of the first updated rows by key.

    A limit of rows is part of the report; None is all rows. The first rows' keys are found once and written; of both
    tables only the ranges that hold them are read.
    """
    keys = request.keys
    compared = [c for c in (request.compared if request.compared is not None else source.columns) if c not in keys]
    updated = classify(source, target, request, check_keys=False).where("classification = 'Update'").select(*keys)
    if limit is not None:
        updated = materialize(top_by_key(updated, keys, limit), "updated")
        ranges = key_ranges(updated, keys[0])
        source, target = fetch(source, updated, keys, ranges), fetch(target, updated, keys, ranges)
    joined = updated.alias("u").join(source.alias("s"), _same_keys("u", "s", keys)).join(target.alias("t"), _same_keys("u", "t", keys))
    cells = [F.struct(F.lit(c).alias("column_name"), render(F.col(f"s.`{c}`"), source.schema[c].dataType, request.profile).alias("source_value"), render(F.col(f"t.`{c}`"), target.schema[c].dataType, request.profile).alias("target_value")) for c in compared]
    changed = F.filter(F.array(*cells), lambda x: ~x["source_value"].eqNullSafe(x["target_value"]))
    return joined.select(*[F.col(f"u.`{k}`") for k in keys], F.explode(changed).alias("c")).select(*keys, "c.*")


def row_details(source: DataFrame, target: DataFrame, request: CompareRequest, limit: int | None = 200) -> DataFrame:
    """Keys, ``changed`` (names of changed columns) and ``unchanged`` (how many compared columns are alike) of updated rows."""
    compared = [c for c in (request.compared if request.compared is not None else source.columns) if c not in request.keys]
    by_row = cell_diffs(source, target, request, limit).groupBy(*[F.col(f"`{k}`") for k in request.keys])
    return by_row.agg(F.sort_array(F.collect_list("column_name")).alias("changed")).withColumn("unchanged", F.lit(len(compared)) - F.size("changed"))


def apply_changes(target: DataFrame, change_set: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The target after the change set: untouched rows, and the source's values of inserts and updates."""
    keys = list(keys)
    untouched = target.alias("t").join(change_set.alias("c"), _same_keys("t", "c", keys), "left_anti")
    written = change_set.where("op <> 'Delete'").select(*[F.col(f"`{c}`").cast(target.schema[c].dataType) for c in target.columns])
    return untouched.unionByName(written)
