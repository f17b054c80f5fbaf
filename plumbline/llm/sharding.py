"""Minimax contiguous sharding, in DataFrame operations only.

Rows are put into ``n_shards`` contiguous runs of an order of atomic groups (rows of equal text), so
that the largest shard, in bytes, is as small as that order allows. The capacity is found by binary
search with a greedy check: fill shards in order, start a new one where the next group does not fit.

The order is that of a 60-bit prefix of the text's SHA-256. The group sizes stay distributed: the
driver sees a histogram over key ranges, finds by the same search a capacity that whole ranges
allow (an upper bound) and one that no cut inside a range can beat (a lower bound), and splits only
the ranges in which a cut may fall, 256-fold a round, until every such range is one atomic unit.
Then both bounds meet and the cuts are exact. A round reads a bounded number of rows: about
256 x n_shards x (n_shards + 2) at most.

Defined cases: a null text is an empty text of size 1; repeated rows each take a slot; an empty
table gives an empty result; a group larger than the mean is a shard's floor and never split;
texts that share the 60-bit prefix are one unit. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exprs import whole
from .store import materialize

KEY_BITS = 60


@dataclass(frozen=True)
class Range:
    """Keys that share their first ``bits`` bits: where they start, their bytes and atomic units."""

    start: int
    bits: int
    size: int
    units: int


def _search(low: int, high: int, feasible) -> int:
    """The least feasible value in low..high, high being feasible."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def _atomic_cuts(ends: list[int], capacity: int, n_shards: int) -> list[int] | None:
    """Greedy: how many leading items the first 1, 2, ... shards hold; None if n_shards are too few."""
    cuts, base, at = [], 0, 0
    for _ in range(n_shards):
        at = bisect_right(ends, base + capacity, lo=at)
        cuts.append(at)
        base = ends[at - 1] if at else 0
    return cuts if at == len(ends) else None


def _open_reach(items: list[Range], ends: list[int], capacity: int, n_shards: int) -> list[int] | None:
    """Greedy with ranges of several units cut anywhere: bytes the first 1, 2, ... shards hold."""
    reach, base = [], 0
    for _ in range(n_shards):
        at = bisect_right(ends, base + capacity)
        whole_end = ends[at - 1] if at else 0
        base = base + capacity if at < len(items) and items[at].units > 1 else max(whole_end, base)
        base = min(base, ends[-1])
        reach.append(base)
    return reach if base >= ends[-1] else None


def _split(units: DataFrame, ranges: list[Range], step: int) -> list[Range]:
    """The histogram of those ranges, each cut into 2**step; one job, at most len(ranges) << step rows."""
    bits = {r.bits for r in ranges}
    found: list[Range] = []
    for b in bits:  # one value, but for the last few bits
        finer = min(KEY_BITS, b + step)
        bucket = F.shiftrightunsigned("key", KEY_BITS - finer)
        rows = units
        if b:
            wanted = [r.start >> (KEY_BITS - b) for r in ranges if r.bits == b]
            rows = rows.where(F.shiftrightunsigned("key", KEY_BITS - b).isin(wanted))
        table = rows.groupBy(bucket.alias("b")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
        found += [Range(x["b"] << (KEY_BITS - finer), finer, x["size"], 1 if x["low"] == x["high"] else 2) for x in table.collect()]
    return found


def minimax_bounds(units: DataFrame, n_shards: int, first_bits: int = 14, step: int = 8) -> tuple[int, list[int]]:
    """The minimax capacity, and the first key of shards 1, 2, ... (KEY_BITS ones beyond the last).

    units: key long (KEY_BITS bits), size long; rows of one key are one atomic unit.
    """
    items = sorted(_split(units, [Range(0, 0, 0, 2)], first_bits), key=lambda r: r.start)
    if not items:
        return 0, [1 << KEY_BITS] * (n_shards - 1)
    while True:
        ends, total = [], 0
        for r in items:
            total += r.size
            ends.append(total)
        floor = -(-total // n_shards)
        high = _search(floor, total, lambda c: _atomic_cuts(ends, c, n_shards) is not None)
        low = _search(floor, high, lambda c: _open_reach(items, ends, c, n_shards) is not None)
        near, far = _open_reach(items, ends, low, n_shards), _open_reach(items, ends, high, n_shards)
        touched = set()
        for a, b in zip(near, far):
            first = bisect_right(ends, min(a, b) - 1)
            while first < len(items) and (ends[first - 1] if first else 0) <= max(a, b):
                touched.add(first)
                first += 1
        coarse = [i for i in touched if items[i].units > 1]
        if not coarse or low == high and _aligned(ends, near):
            cuts = _atomic_cuts(ends, high, n_shards)
            return high, [items[c].start if c < len(items) else 1 << KEY_BITS for c in cuts[:-1]]
        gone = set(coarse)
        finer = _split(units, [items[i] for i in coarse], step)
        items = sorted([r for i, r in enumerate(items) if i not in gone] + finer, key=lambda r: r.start)


def _aligned(ends: list[int], reach: list[int]) -> bool:
    known = set(ends)
    return all(x in known for x in reach)


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text: str = "text", rows_per_slot_bucket: int = 50_000) -> DataFrame:
    """One row an input row: id_col, size, text_crc32, shard, slot.

    Slots count from 0 in each shard without gaps. They are dealt by bucket: a row's place among
    its bucket's rows plus the rows of the shard's earlier buckets, so no task sorts a whole shard. Buckets are
    by row number (as written), so rows that are alike in every column spread too.
    """
    t = whole(F.col(f"`{text}`"))
    digest = F.conv(F.substring(F.sha2(t, 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    slim, _ = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), digest.alias("key"), F.monotonically_increasing_id().alias("row")), "shard-sizes")
    _, bounds = minimax_bounds(slim, n_shards)
    number = sum((F.when(F.col("key") >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    n_buckets = max(1, slim.count() // (n_shards * rows_per_slot_bucket) + 8)
    placed = slim.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "id", "row"))
    rows = placed.withColumn("place", place).join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))
