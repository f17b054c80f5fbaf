"""Exact removal of repeated byte strings by suffix order and longest previous factors.

Every string of ``min_bytes`` bytes (a window) that occurs twice or more, in one document or in
several, is repeated. What is removed is the bytes that repeated windows cover: all of them, or with
keep="first" those of windows that have an earlier occurrence.

A suffix array of the whole corpus fits no machine, so windows are first dealt to groups within
which all equal windows meet. A window's anchor is its k-gram of least hash (the leftmost, on ties); equal
windows have equal anchors at equal places. The windows of one anchor form a run, one stretch of
text.

1. Anchors that occur once hold nothing repeated; most of the corpus ends here, as hashes only.
2. Equal stretches are counted by 128 bits of hash (64 of the anchor, 64 of the stretch): those that
   occur twice or more are repeated as a whole, and one of them stands for all.
3. What is left are anchors with several kinds of stretches, at the edges of repeated passages. The
   stretches of an anchor go into one suffix order, cut at min_bytes. From its previous and next smaller
   positions comes the array of longest previous factors; a window whose factor reaches min_bytes has an earlier
   occurrence, and the place that the factor is from a later one.
4. An anchor with more than ``GROUP`` kinds is split first, so that no task holds a hot one: its
   windows are dealt by ranges of ``WIDTHS[0]`` places before the anchor, and a range by the bytes that all its windows
   share. Equal windows still meet; steps 1 to 3 are repeated with these groups. A group that is still
   too large is split by single places, where a group is one window.

Positions are in UTF-8 bytes, and the order of occurrences is that of (text hash, place); of equal
texts the document of least id is the first. Texts are named by their MD5.

Defined cases: a null text is the empty text; texts shorter than min_bytes lose nothing; repeated
rows are copies of each other; an empty table gives an empty result; texts are taken whole; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize
from .wordarrays import mix, pieces, powers, window_minimum

GRAM = 32
#: Kinds of stretches of one anchor that one task orders; an anchor with more is split.
GROUP = 2_000
#: Places by which a group is split, then split again.
WIDTHS = (12, 1)
#: Bytes of stretches that are put in order at once.
ORDER_BYTES = 1 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of many texts: (text, first window, last window, anchor hash, place of the anchor), counted from each text's start."""
    n_grams, n = len(data) - gram + 1, len(data) - min_bytes + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * powers(n_grams, -1))
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n_grams, dtype=np.uint64)
    place = (window_minimum(packed, min_bytes - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    starts = np.flatnonzero(np.arange(n) + min_bytes <= offsets[1:][text])
    if not len(starts):
        return none, none, none, none, none
    place, text = place[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    base = offsets[text[first]]
    return text[first], starts[first] - base, starts[last] - base, hashes[place[first]].view(np.int64), place[first] - base


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each of distinct values the index of the nearest smaller one before it, or -1."""
    found = np.arange(-1, len(x) - 1)
    open_ones = np.flatnonzero((found >= 0) & (x[found] > x))
    while len(open_ones):  # what lies between a candidate and its own candidate is larger still
        found[open_ones] = found[found[open_ones]]
        at = found[open_ones]
        open_ones = open_ones[(at >= 0) & (x[at] > x[open_ones])]
    return found


def previous_factors(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous factors, cut at min_bytes, of the windows of stretches data[bounds[i]:bounds[i + 1]], by group.

    Returns (start in data, length of the longest earlier match in the group, its start in data or -1), by start.
    """
    padded = np.concatenate([data, np.zeros(2 * min_bytes + 8, np.uint8)])
    n = len(data)
    word = np.zeros(n + min_bytes, np.uint64)
    for j in range(8):
        word |= padded[j : j + n + min_bytes].astype(np.uint64) << np.uint64(56 - 8 * j)
    ranks = [(8, np.unique(word, return_inverse=True)[1])]
    length = 8
    while length < min_bytes:  # ranks by the first `length` bytes, doubled, the last step as far as needed
        step = min(length, min_bytes - length)
        rank = ranks[-1][1]
        pairs = (rank[: len(rank) - step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        length += step
        ranks.append((length, np.unique(pairs, return_inverse=True)[1]))
    rank = ranks[-1][1]
    stretch = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + min_bytes <= bounds[1:][stretch])
    group = groups[stretch[starts]]
    order = np.lexsort((starts, rank[starts], group))
    place, group = starts[order], group[order]
    best, source = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for found in (previous_smaller(place), len(place) - 1 - previous_smaller(place[::-1])[::-1]):
        some = np.flatnonzero((found >= 0) & (found < len(place)))
        some = some[group[found[some]] == group[some]]
        a, b = place[some], place[found[some]]
        same = np.zeros(len(some), np.int64)
        for length, by in reversed(ranks):  # common bytes, by halves; what is asked beyond a stretch is cut below
            fits = np.flatnonzero(same + length <= min_bytes)
            fits = fits[by[a[fits] + same[fits]] == by[b[fits] + same[fits]]]
            same[fits] += length
        differ = word[np.minimum(a + same, n)] ^ word[np.minimum(b + same, n)]
        tail = sum((differ >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 8))
        same = np.minimum(same + np.where(same < min_bytes, tail, 0), min_bytes)
        better = same > best[some]
        best[some[better]], source[some[better]] = same[better], b[better]
    back = np.argsort(place)
    return place[back], best[back], source[back]


def _runs(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(anchor, stretch, t, n, low, high): the runs of (t, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at, end, data, offsets in pieces(batch.column(2)):
                text, low, high, anchor, _ = anchors(data, offsets, min_bytes)
                if not len(text):
                    continue
                view = memoryview(np.ascontiguousarray(data))
                begin = offsets[text]
                stretch = [digest(view[a:b]) for a, b in zip((begin + low).tolist(), (begin + high + min_bytes).tolist())]
                part = batch.slice(at, end - at)
                rows = pa.array(text)
                columns = [pa.array(anchor), pa.array(np.array(stretch, np.uint64).view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "stretch", "t", "n", "low", "high"])

    return docs.select("t", "n", "text").mapInArrow(run, "anchor long, stretch long, t binary, n int, low int, high int")


def _fetched(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(anchor, many, own, t, n, low, body): the stretches of (t, n, d.text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                part = batch.slice(at, 64)
                for t, n, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).field("text").to_pylist(), part.column(3).to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    out += [(w["anchor"], w["many"], w["own"], t, n, w["low"], data[w["low"] : w["high"] + min_bytes]) for w in wanted]
                columns = list(zip(*out)) or [()] * 7
                types = (pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["anchor", "many", "own", "t", "n", "low", "body"])

    return rows.select("t", "n", "d", "wanted").mapInArrow(run, "anchor long, many boolean, own boolean, t binary, n int, low int, body binary")


def _ordered(stretches: DataFrame, min_bytes: int) -> DataFrame:
    """(t, n, low, high, later) of repeated windows among stretches of equal anchors, by longest previous factors."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        anchor = table["anchor"].to_numpy()
        bodies = table["body"].to_pylist()
        data = np.frombuffer(b"".join(bodies), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        place, factor, source = previous_factors(data, bounds, np.unique(anchor, return_inverse=True)[1], min_bytes)
        earlier = factor >= min_bytes
        some = earlier.copy()
        some[np.searchsorted(place, source[earlier])] = True  # has a later occurrence
        place, earlier = place[some], earlier[some]
        which = np.searchsorted(bounds, place, "right") - 1
        own = table["own"].to_numpy(zero_copy_only=False)[which]
        place, earlier, which = place[own], earlier[own], which[own]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (which[1:] != which[:-1]) | (earlier[1:] != earlier[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        rows = pa.array(which[first])
        low = (place[first] - bounds[which[first]]).astype(np.int32) + table["low"].to_numpy()[which[first]]
        high = low + (place[last] - place[first]).astype(np.int32) if len(first) else low
        columns = [table["t"].combine_chunks().take(rows), table["n"].combine_chunks().take(rows), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(earlier[first])]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=["t", "n", "low", "high", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                held.append(batch)
                size += batch.nbytes
                if size < ORDER_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(len(b) for b in table["body"].slice(cut).to_pylist())
        if held:
            yield solve(pa.Table.from_batches(held))

    ordered = stretches.repartition("anchor").sortWithinPartitions("anchor", "t", "n", "low")
    return ordered.select("anchor", "own", "t", "n", "low", "body").mapInArrow(run, "t binary, n int, low int, high int, later boolean")


def _split(stretches: DataFrame, width: int, min_bytes: int) -> DataFrame:
    """(anchor, stretch, own, t, n, low, high, body): the stretches cut by ranges of width places before the anchor.

    The new anchor is a hash of the old one, the range and the bytes that every window of the range has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda *parts: xxhash.xxh3_64_intdigest(b"".join(parts)) - (1 << 63)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                bodies = part.column(4).to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
                places = anchors(np.frombuffer(b"".join(bodies), np.uint8), offsets, min_bytes)[4].tolist()  # one run a stretch
                out = []
                for own, t, n, low, body, place in zip(*[c.to_pylist() for c in part.columns], places):
                    least = place - (len(body) - min_bytes)  # places before the anchor of the last window, of the first: place
                    gram = body[place : place + GRAM]
                    for j in range(least // width, place // width + 1):
                        first, last = max(least, j * width), min(place, j * width + width - 1)
                        core = body[place - j * width : place + min_bytes - (j * width + width - 1)]
                        piece = body[place - last : place - first + min_bytes]
                        key = f"{j}:{len(core)}:".encode()
                        out.append((signed(key, gram, core), signed(f"{first}:{last}:".encode(), piece), own, t, n, low + place - last, low + place - first, piece))
                columns = list(zip(*out)) or [()] * 8
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["anchor", "stretch", "own", "t", "n", "low", "high", "body"])

    return stretches.select("own", "t", "n", "low", "body").mapInArrow(run, "anchor long, stretch long, own boolean, t binary, n int, low int, high int, body binary")


def repeats(docs: DataFrame, min_bytes: int = 200, group: int = GROUP, order: bool = True) -> DataFrame:
    """(t, n, runs array<struct<low, high, later>>) of texts with repeated windows, from (d struct<.., text>, t, n).

    later: the windows low..high have an earlier occurrence in the order of (t, place); without
    order it is only right for runs that are in one stretch throughout, and less is fetched.
    """
    spark = docs.sparkSession
    spent: list[str] = []
    place = F.struct("t", "n", "low", "high")

    def written(df: DataFrame, name: str) -> DataFrame:
        # both sides of a join and its result are written: Spark splits a hot key's rows only between plain exchanges
        out, path = materialize(df, name)
        spent.append(path)
        return out

    def counted(pieces: DataFrame, copies: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of pieces (anchor, stretch, t, n, low, high): the kinds; runs that are repeated as a whole; anchors of several kinds."""
        kinds = written(pieces.groupBy("anchor", "stretch").agg(F.sum(copies).alias("c"), F.min(place).alias("first")), "kinds")
        twice = kinds.where("c >= 2").select(F.col("anchor").alias("ka"), F.col("stretch").alias("ks"), "first")
        whole = pieces.join(twice, (F.col("anchor") == F.col("ka")) & (F.col("stretch") == F.col("ks")))
        mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c1")).where("m >= 2" if order else "m >= 2 and c1 = 1")
        return kinds, whole, written(mixed.select(F.col("anchor").alias("ka"), (F.col("m") > group).alias("many")), "mixed")

    runs, runs_path = materialize(_runs(docs.where(F.col("n") >= min_bytes).select("t", "n", F.col("d.text").alias("text")), min_bytes), "runs")
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("anchor")
    again, again_path = materialize(again, "anchors")
    several, several_path = materialize(runs.join(again, "anchor", "left_semi"), "several")
    discard(spark, runs_path, again_path)
    # copies of a text have equal rows, which are one row from here on
    same = written(several.groupBy("anchor", "stretch", "t", "n", "low", "high").agg(F.count(F.lit(1)).alias("copies")), "again")
    discard(spark, several_path)
    kinds, whole, mixed = counted(same, F.col("copies"))
    found = whole.select("t", "n", "low", "high", (place != F.col("first")).alias("later"))
    wanted = kinds.join(mixed, F.col("anchor") == F.col("ka")).select("first.*", "anchor", "many", (F.lit(True) if order else F.col("c") == 1).alias("own"))
    wanted = wanted.groupBy("t", "n").agg(F.collect_list(F.struct("anchor", "many", "own", "low", "high")).alias("wanted")).select(F.col("t").alias("wt"), F.col("n").alias("wn"), "wanted")
    held = docs.join(wanted, (F.col("t") == F.col("wt")) & (F.col("n") == F.col("wn")))
    stretches = written(_fetched(held, min_bytes).dropDuplicates(["t", "n", "low", "anchor"]), "stretches")
    for width in (*WIDTHS, None):
        found = found.unionByName(_ordered(stretches.where("not many"), min_bytes))
        stretches = stretches.where("many")
        if width is None or stretches.isEmpty():
            break
        pieces = written(_split(stretches, width, min_bytes), "pieces")
        kinds, whole, mixed = counted(pieces, F.lit(1))
        found = found.unionByName(whole.where("own").select("t", "n", "low", "high", (place != F.col("first")).alias("later")))
        one = kinds.join(mixed, F.col("anchor") == F.col("ka")).select(F.col("anchor").alias("oa"), F.col("stretch").alias("os"), "many", "c", "first")
        one = pieces.join(written(one, "one"), (F.col("anchor") == F.col("oa")) & (F.col("stretch") == F.col("os"))).where(place == F.col("first"))
        stretches = written(one.select("anchor", "many", (F.col("own") & (F.lit(True) if order else F.col("c") == 1)).alias("own"), "t", "n", "low", "body"), "stretches")
    out, _ = materialize(found.groupBy("t", "n").agg(F.collect_list(F.struct("low", "high", "later")).alias("runs")), "repeats")
    discard(spark, *spent)
    return out


def _spans(runs: list[dict], min_bytes: int, length: int, every: bool) -> list[tuple[int, int]]:
    """Maximal covered byte spans."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"] + min_bytes) for r in runs if every or r["later"]):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def strip_repeats(docs: DataFrame, min_bytes: int = 200, keep: str = "none", id_col: str = "doc_id", text: str = "text", digests: bool = False, group: int = GROUP) -> DataFrame:
    """One row a document: id_col, n_bytes, n_removed, n_spans and kept, the remaining bytes; with digests kept_sha256 instead.

    keep="none" removes every occurrence of a repeated window, keep="first" all but the first.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), body.alias("text")).alias("d"), F.unhex(F.md5(body.cast("binary"))).alias("t"), F.octet_length(body).alias("n"))
    found = repeats(rows, min_bytes, group, keep == "first").select(F.col("t").alias("rt"), F.col("n").alias("rn"), "runs")
    joined = rows.join(found, (F.col("t") == F.col("rt")) & (F.col("n") == F.col("rn")), "left")
    if keep == "first":
        least = rows.groupBy("t", "n").agg(F.min("d.id").alias("least")).select(F.col("t").alias("lt"), F.col("n").alias("ln"), "least")
        joined = joined.join(least, (F.col("t") == F.col("lt")) & (F.col("n") == F.col("ln")))
        every = (F.col("n") >= min_bytes) & ~F.col("d.id").eqNullSafe(F.col("least"))
    else:
        every = F.lit(False)
    joined = joined.select("d", "runs", every.alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out = []
                for value, runs, copy in zip(part.column(0).field("text").to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = value.encode("utf-8", "surrogatepass")
                    spans = [(0, len(data))] if copy else _spans(runs or [], min_bytes, len(data), keep == "none")
                    edges = [0, *[x for s in spans for x in s], len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digests else kept))
                columns = list(zip(*out))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).field("id"), *[pa.array(c, k) for c, k in zip(columns, types)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    last = "kept_sha256" if digests else "kept"
    out = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias(last))
