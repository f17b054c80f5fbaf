"""Similarity join of documents on their word n-grams, by vertical partitioning.

The n-grams of all documents have one global order: those of many documents come last, all others first, both by
hash. The order is cut into fragments: equal ranges of the rare ones' hashes, and one fragment of the frequent ones. A document's
set falls into a segment in each. What two documents share is counted in every fragment by itself, from two segments, and
the counts are summed by pair, so no task ever holds two whole sets of long documents, nor the sets of a group.

Two sets that are similar enough share an n-gram so early in both that what follows can still make up the overlap: candidates
are documents that share one of their prefix. In a bucket of copies nearly all do, so a bucket doesn't yield all its
pairs. Only components are asked for: at first every set meets two centres of each of its buckets; then those
outside of a bucket's largest component meet a few of its members; at last every pair of different components that shares a
prefix n-gram meets, if lengths and places allow the overlap. Pairs of one component add nothing and are left out,
so every link between components is found, and none is assumed. Before its segments are fetched a pair's parities are compared: of a set,
two to four bits an n-gram say of which hashes it has an odd number. Sets differ in at least as many n-grams as
parities do in bits, so what they rule out is no link. The last pairs are held by parities of 512 bits even before they are made.

Frequency only sets the order. It is counted over all documents, by 40 or more bits of each hash; the n-grams
of more than ``FREQUENT`` documents become a bitmap of fixed size, which is the same for all, so the order is one whatever the bitmap
lets in. The similarity is compared in whole numbers, of sets of 64-bit hashes.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing, not even with each other; a text of fewer
words is one n-gram; repeated rows are documents of their own, linked as copies are; a null id is the component's id only if
all are null; an empty table gives an empty result; texts are taken whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, frequent, may_have
from .minhash import _counted, components, weigh
from .store import discard, materialize
from .wordarrays import LOWER, grams, pieces, word_table, words_of

#: N-grams of more documents come last in the order.
FREQUENT = 100
#: Fragments of the rare n-grams, as a power of two.
FRAGMENT_BITS = 3
#: Bits of the parities by which pairs are ruled out where many meet.
SKETCH_BITS = 512
#: Of a bucket's largest component, so many members are met by those outside.
MEMBERS = 6
_SPACE = word_table("space")


@dataclass(frozen=True)
class JoinRules:
    """Documents link when 100 * common >= percent * union of their distinct 4-word shingles."""

    size: int = 4
    percent: int = 85

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """So many n-grams of a set of n, early in the order, have one in common with any similar set."""
        return n - -(-self.percent * n // 100) + 1

    def enough(self, common: Column, sizes: Column) -> Column:
        """Whether so many in common, of so many in both together, make a link."""
        return (100 + self.percent) * common >= self.percent * sizes


def _sets(column: pa.Array, rules: JoinRules) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct hashes, bounds) of texts."""
    for first, end, data, offsets in pieces(column):
        hashes, _, bounds = weigh(*shingles_of_words(data, offsets, rules.size))
        yield first, end, hashes, bounds


def shingles_of_words(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by text); words are what white space parts."""
    _, _, words, bounds = words_of(LOWER[data], offsets, _SPACE)
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], np.uint64)
    for k in range(1, size + 1):
        some = n == k if k < size else n >= size
        if some.any():
            every = grams(words, k)
            rows = np.flatnonzero(some)
            at = np.arange(counts[rows].sum()) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
            out[np.repeat(ends[rows], counts[rows]) + at] = every[np.repeat(bounds[rows], counts[rows]) + at]
    return out, ends


def _frequent(texts: DataFrame, rules: JoinRules) -> Broadcast[np.ndarray]:
    """The bitmap of n-grams that more than FREQUENT of texts have."""
    return frequent(texts.select("text"), lambda batch: (hashes for _, _, hashes, _ in _sets(batch.column(0), rules)), FREQUENT + 1)


def _prefixes(texts: DataFrame, frequent: Broadcast[np.ndarray], rules: JoinRules) -> DataFrame:
    """(content, size, prefix array<long>, parity array<long>), the prefix in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, bounds in _sets(batch.column(1), rules):
                sizes = np.diff(bounds)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                late = may_have(frequent.value, hashes)
                ordered = hashes[np.argsort(2 * doc + late, kind="stable")]  # by hash already
                wanted = np.where(sizes > 0, rules.prefix(sizes), 0)
                place = np.arange(len(hashes)) - bounds[:-1][doc]
                kept = ordered[place < wanted[doc]]
                cuts = np.concatenate([[0], np.cumsum(wanted)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(kept.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sizes), lists, *_parities(hashes, doc, sizes)], names=["content", "size", "prefix", "parity", "sketch"])

    return texts.select("content", "text").mapInArrow(run, "content binary, size long, prefix array<long>, parity array<long>, sketch array<long>")


def _parities(hashes: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """By set, parities of at least two bits an n-gram, a power of two, and of SKETCH_BITS."""
    wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    return _parity(hashes, doc, wide), _parity(hashes, doc, np.full(len(sizes), SKETCH_BITS))


def _parity(hashes: np.ndarray, doc: np.ndarray, bits: np.ndarray) -> pa.Array:
    """By set, so many bits that say of which hashes, cut to them, it has an odd number."""
    begins = np.concatenate([[0], np.cumsum(bits)])
    cell = begins[:-1][doc] + (hashes & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=begins[-1]) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((begins // 64).astype(np.int32)), pa.array(words))


def _entries(sets: DataFrame, shared: Broadcast[np.ndarray]) -> DataFrame:
    """(s, c, size, place): prefix n-grams that other sets' prefixes may hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths(), np.int64)
            s = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            on = np.flatnonzero(may_have(shared.value, s.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(s[on]), batch.column(0).take(pa.array(row[on])), batch.column(1).take(pa.array(row[on])), pa.array(place[on])], names=["s", "c", "size", "place"])

    return sets.select("c", "size", "prefix").mapInArrow(run, "s long, c long, size long, place long")


def _may_be_of(texts: DataFrame, contents: Broadcast[np.ndarray]) -> DataFrame:
    """(content, text) of those rows whose content may be in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(may_have(contents.value, np.asarray(batch.column(2)).view(np.uint64))))

    return texts.select("content", "text", F.xxhash64("content").alias("h")).mapInArrow(run, "content binary, text string")


def _segments(texts: DataFrame, frequent: Broadcast[np.ndarray], rules: JoinRules) -> DataFrame:
    """(c, fragment, part array<long>) of (c, text): a set, cut where the global order is."""
    fragments = (1 << FRAGMENT_BITS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, bounds in _sets(batch.column(1), rules):
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                fragment = np.where(may_have(frequent.value, hashes), fragments - 1, (hashes >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64))
                cell = doc * fragments + fragment
                order = np.argsort(cell, kind="stable")
                some, begins = np.unique(cell[order], return_index=True)
                cuts = np.append(begins, len(hashes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[order].view(np.int64)))
                ids = batch.column(0).slice(first, end - first).take(pa.array(some // fragments))
                yield pa.RecordBatch.from_arrays([ids, pa.array((some % fragments).astype(np.int32)), lists], names=["c", "fragment", "part"])

    return texts.select("c", "text").mapInArrow(run, "c long, fragment int, part array<long>")


def _apart(x: str, y: str) -> Column:
    """In how many bits two parities differ, the longer folded to the shorter's length."""
    n = F.least(F.size(x), F.size(y))

    def folded(p: str) -> Column:
        halves = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, n + 1, n), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(p) == n, F.col(p)).otherwise(halves)

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)


def _possible(pairs: DataFrame, parities: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs (a, b, sa, sb) whose parities don't differ in more bits than linked sets do in n-grams.

    Lengths of parities are powers of two, and the sizes of a pair are near, so one is the other's or twice it.
    """
    x, y = parities.select(F.col("c").alias("ca"), F.col("parity").alias("pa")), parities.select(F.col("c").alias("cb"), F.col("parity").alias("pb"))
    met = pairs.join(x, F.col("a") == F.col("ca")).join(y, F.col("b") == F.col("cb"))
    return met.where((100 + rules.percent) * _apart("pa", "pb") <= (100 - rules.percent) * (F.col("sa") + F.col("sb"))).select("a", "b", "sa", "sb")


def _links(pairs: DataFrame, segments: DataFrame, rules: JoinRules) -> DataFrame:
    """(a, b) of pairs (a, b, sa, sb) that link: what they share is counted in every fragment, and summed by pair."""
    x, y = segments.select(F.col("c").alias("ca"), "fragment", F.col("part").alias("xs")), segments.select(F.col("c").alias("cb"), F.col("fragment").alias("f"), F.col("part").alias("ys"))
    met = pairs.join(x, F.col("a") == F.col("ca")).join(y, (F.col("b") == F.col("cb")) & (F.col("fragment") == F.col("f")))
    summed = met.select("a", "b", "sa", "sb", F.size(F.array_intersect("xs", "ys")).alias("n")).groupBy("a", "b", "sa", "sb").agg(F.sum("n").alias("common"))
    return summed.where(rules.enough(F.col("common"), F.col("sa") + F.col("sb"))).select("a", "b")


def _roots(texts: DataFrame, sets: DataFrame, frequent: Broadcast[np.ndarray], rules: JoinRules) -> DataFrame:
    """(node, root) of sets that share a prefix n-gram with others and were compared, by c."""
    spark = texts.sparkSession
    spent: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        out, path = materialize(df, name)
        spent.append(path)
        return out

    grams_of = sets.select("c", F.explode("prefix").alias("s"))
    buckets = written(grams_of.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("centre"), F.max("c").alias("other")).where("n > 1").select(F.col("s").alias("k"), "centre", "other"), "buckets")
    entries = written(_entries(sets, bitmap(buckets, "k")).join(buckets, F.col("s") == F.col("k")).drop("k"), "entries")
    met = entries.select("c").distinct()
    parities = sets.select("c", "parity")
    labels, labels_path = materialize(met.select(F.col("c").alias("node"), F.col("c").alias("root")), "labels")
    segments: dict[str, DataFrame] = {}

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        """Of pairs (a, b, sa, sb) those that link, and their number."""
        # written, so that Spark knows how few they are before it deals out what belongs to them
        possible = written(_possible(pairs.distinct(), parities, rules), "possible")
        ends = possible.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        if "all" in segments:
            ends = ends.join(segments["all"].select("c").distinct(), "c", "left_anti")
        chosen = written(ends.join(sets.select("c", "content"), "c"), "chosen")
        near = _may_be_of(texts, bitmap(chosen.select(F.xxhash64("content").alias("h"))))
        first = near.join(chosen, "content").groupBy("c").agg(F.any_value("text").alias("text"))
        more = written(_segments(first, frequent, rules), "segments")
        segments["all"] = segments["all"].unionByName(more) if "all" in segments else more
        links = _links(possible, segments["all"], rules)
        out, path, (n, _) = _counted(links, "links", "a", "b")
        spent.append(path)
        return out, n

    def merged(links: DataFrame) -> None:
        nonlocal labels, labels_path
        ends = [labels.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab"]
        between = links.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        roots, path = components(between)
        moved = roots.select(F.col("node").alias("old"), F.col("root").alias("new"))
        after, after_path = materialize(labels.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        discard(spark, path, labels_path)
        labels, labels_path = after, after_path

    def could_link(x: str, y: str) -> Column:
        """Lengths, and places of the n-gram that both have, still allow a link."""
        sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
        return rules.enough(F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place")), sizes)

    def pair(x: str, y: str) -> list[Column]:
        first = F.col(f"{x}.c") > F.col(f"{y}.c")
        ends = F.when(first, F.struct(f"{x}.c", f"{x}.size", f"{y}.c", f"{y}.size")).otherwise(F.struct(f"{y}.c", f"{y}.size", f"{x}.c", f"{x}.size"))
        ends = ends.cast("struct<a: bigint, sa: bigint, b: bigint, sb: bigint>")
        return [ends[n].alias(n) for n in ("a", "b", "sa", "sb")]

    def held_against(rows: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs of rows and the chosen members (s, c, size, place) of their buckets."""
        x, y = rows.alias("x"), members.alias("y")
        return x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.c") != F.col("y.c")) & could_link("x", "y")).select(*pair("x", "y"))

    links, n = linked(held_against(entries, entries.where("c = centre or c = other")))
    for last in (False, True):
        if n:
            merged(links)
        rows = entries.join(labels, F.col("c") == F.col("node")).select("s", "c", "size", "place", "root")
        by_root = rows.groupBy("s", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = by_root.groupBy("s").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select(F.col("s").alias("k"), "largest")
        rows = written(rows.join(written(largest, "largest"), F.col("s") == F.col("k")).drop("k"), "open")
        outside = rows.where("root <> largest")
        if not last:
            if not n:
                continue
            members = F.array(*[F.min_by(F.struct("c", "size", "place"), F.xxhash64("c", "s", F.lit(i))) for i in range(MEMBERS)])
            inside = written(rows.where("root = largest").groupBy("s").agg(members.alias("m")).select("s", F.explode(F.array_distinct("m")).alias("m")).select("s", "m.*"), "inside")
            links, n = linked(held_against(outside, inside))
        else:
            # in a group of many that are nearly similar enough all would meet, so that sketches already speak in the join
            x, y = (held.join(sets.select(F.col("c").alias("cs"), "sketch"), F.col("c") == F.col("cs")).alias(name) for held, name in ((outside, "x"), (rows, "y")))
            apart = sum((F.bit_count(F.get("x.sketch", F.lit(i)).bitwiseXOR(F.get("y.sketch", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
            near = (100 + rules.percent) * apart <= (100 - rules.percent) * (F.col("x.size") + F.col("y.size"))
            once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.c") > F.col("y.c"))
            links, n = linked(x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & once & could_link("x", "y") & near).select(*pair("x", "y")))
            if n:
                merged(links)
    discard(spark, *spent)
    return labels


def join(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, n_shingles, component_id (the least id that links reach)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))).alias("content"), F.col(f"`{text}`").alias("text"))
    texts = rows.select("content", "text")
    frequent = _frequent(texts, rules)
    of_content = _prefixes(texts, frequent, rules).groupBy("content").agg(F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"), F.any_value("parity").alias("parity"), F.any_value("sketch").alias("sketch"))
    sets, _ = materialize(of_content.withColumn("c", F.monotonically_increasing_id()), "sets")
    roots = _roots(texts, sets, frequent, rules)
    least = rows.groupBy("content").agg(F.min("id").alias("least")).withColumnRenamed("content", "key")
    known = sets.select("content", "c", "size").join(least, F.col("content") == F.col("key")).join(roots, F.col("c") == F.col("node"), "left")
    labelled, _ = materialize(known.select("content", "size", "least", F.coalesce("root", "c").alias("root")), "labelled")
    by_root = labelled.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    told = labelled.join(by_root, F.col("root") == F.col("r")).select(F.col("content").alias("key"), "size", "component_id")
    found = rows.select("id", "content").join(told, F.col("content") == F.col("key"))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
