"""Near-duplicate classes by DartMinHash and banded joining.

Texts become words (A-Z lowered; runs of digits, a-z and anything beyond ASCII) and sets, or
weighted sets, of five-word shingles; a text of fewer words is one shingle.

Darts. Every unit of a shingle's weight is a strip hit by a Poisson stream of darts of rate one; a
dart has a rank (its arrival time), a place inside the strip (it counts where the weight reaches
that far), a coordinate, all hashed from shingle, strip and number alone, so equal
shingles of two texts are hit by equal darts. Of a text only darts of rank below T / total weight
are thrown, about T = k (ln k + 3) whatever its length; the earliest dart of a coordinate is that
coordinate's signature. Texts with an empty coordinate are thrown again with T doubled. Two
signatures agree in a coordinate with probability of the (weighted) Jaccard similarity.

Links. Equal texts are one content first. Contents that share a band are candidates. A bucket
doesn't yield all its pairs: contents are held against representatives of their buckets. At first
that is one centre of each bucket; then, for ``ROUNDS`` rounds at most or until one links nothing,
contents outside of the largest component of a bucket meet one random member of that component, a fresh one
by bucket and round. So a content meets up to ``bands`` members a round, whatever a bucket's size; of
these the ``NEAREST`` by parity (below) are verified by the exact similarity of their shingles. What is still
apart in a common bucket then meets once more, exactly: by the prefixes of the shingles, rare ones first,
with the position and parity filters, so that only pairs of different components that share a
shingle rare enough are made. So a bucket of thousands of copies costs about one comparison a copy, no candidate is
dropped, and every similar pair that shares a bucket ends in one component. A parity has a bit for
each of 512 classes of shingles: whether an odd number of the set's shingles is in it; two parities
differ in no more bits than the sets in shingles, so a pair whose parities are too far apart can't be similar.

Components are found by alternating large-star and small-star
steps over the roots that new links connect. Links, labels and signatures stay distributed and are
written to the shared folder between rounds. With 32 bands of 5 a pair of similarity 0.8 shares no
bucket with probability 3e-6.

Defined cases: null, empty and wordless texts have no shingles; they are near nothing but equal
texts (null equals empty); the class of one is its own doc_id; null ids come last in the choice of a
class id, which is null only if all its ids are; repeated rows share a class; an empty table gives
an empty result; texts are taken whole. Other columns are not read by ``classes`` and kept by
``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import discard, materialize
from .wordarrays import LOWER, grams, mix, pieces, word_table, words_of


#: Rounds in which contents are held against members of a larger component.
ROUNDS = 2
#: Of the members that a content meets in a round, so many are verified.
NEAREST = 3
PARITY_BITS = 512


@dataclass(frozen=True)
class NearRules:
    """Five-word shingles, similarity of 0.8 or more, 32 bands of 5 coordinates; weights: set or count."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    weights: str = "set"


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by text) of many texts' bytes."""
    _, _, words, bounds = words_of(LOWER[data], offsets, word_table("alnum"))
    n = np.diff(bounds)
    out = np.empty(int(np.where(n >= size, n - size + 1, np.minimum(n, 1)).sum()), np.uint64)
    many = n >= size
    full = grams(words, size)
    last = np.repeat(bounds[1:], n)
    starts = np.flatnonzero(np.arange(len(words)) + size <= last)
    counts = np.where(many, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    where = np.ones(len(out), bool)
    short = np.flatnonzero(~many & (n > 0))
    where[ends[short]] = False
    out[where] = full[starts]
    for i in short:
        out[ends[i]] = grams(words[bounds[i] : bounds[i + 1]], int(n[i]))[0]
    return out, ends


def weigh(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, weights by count, bounds) of each text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h))).astype(float)
    return h[first], weight, np.searchsorted(d[first], np.arange(len(bounds)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def dart_signatures(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart, named by its rank, by text and coordinate; texts without elements get zeros."""
    n_docs = len(bounds) - 1
    signatures = np.zeros((n_docs, k), np.uint64)
    total = np.concatenate([[0.0], np.cumsum(weights)])
    mass = total[bounds[1:]] - total[bounds[:-1]]
    left = np.flatnonzero(mass > 0)
    reach = k * (np.log(k) + 3)
    at_once = max(1, (1 << 16) // k - 1)  # a cell (text, coordinate) has 16 bits
    while len(left):
        missed = []
        for i in range(0, len(left), at_once):
            some = left[i : i + at_once]
            grid = _thrown(hashes, weights, bounds, some, reach / mass[some], k)
            full = (grid > 0).all(axis=1)
            signatures[some[full]] = grid[full]
            missed.append(some[~full])
        left, reach = np.concatenate(missed), 2 * reach
    return signatures


def _thrown(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, some: np.ndarray, limits: np.ndarray, k: int) -> np.ndarray:
    """The earliest rank by text and coordinate among darts below the texts' limits; zero where there is none."""
    sizes = bounds[some + 1] - bounds[some]
    doc = np.repeat(np.arange(len(some)), sizes)
    at = np.arange(len(doc)) + np.repeat(bounds[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    weight = weights[at]
    plain = bool((weight == 1).all())  # one whole strip each: every dart counts
    seed = hashes[at]
    room = weight
    if not plain:  # a row for each strip of each element
        strips = np.ceil(weight).astype(np.int64)
        number = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
        doc, seed, room = np.repeat(doc, strips), np.repeat(seed, strips) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.repeat(weight, strips) - number
    seed = mix(seed)
    rank = np.zeros(len(doc))
    found = []
    while len(doc):
        seed = mix(seed + np.uint64(0xA0761D6478BD642F))
        rank = rank - np.log(_uniform(seed))
        on = np.flatnonzero(rank < limits[doc])
        doc, seed, rank = doc[on], seed[on], rank[on]
        # ranks are positive doubles, whose bits are in their order; the seed's low bits, unused so far, give the coordinate
        cell = doc * k + (((seed & np.uint64(2047)) * np.uint64(k)) >> np.uint64(11)).astype(np.int64)
        dart = (cell.astype(np.uint64) << np.uint64(48)) | (rank.view(np.uint64) >> np.uint64(16))
        if not plain:
            room = room[on]
            dart = dart[_uniform(mix(seed ^ np.uint64(0xE7037ED1A0B428DB))) <= room]
        found.append(dart)
    darts = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
    cell = (darts >> np.uint64(48)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    grid = np.zeros(len(some) * k, np.uint64)
    grid[cell[first]] = darts[first] & np.uint64((1 << 48) - 1)
    return grid.reshape(len(some), k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash by text and band, different bands never meeting."""
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), len(signatures), axis=0)
    grid = signatures.reshape(len(signatures), bands, rows)
    for j in range(rows):
        keys = mix(keys + grid[:, :, j])
    return keys.view(np.int64)


def _bands(docs: DataFrame, rules: NearRules) -> DataFrame:
    """(content, bands array<long>) from (content, text); texts without shingles have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(1)):
                hashes, bounds = shingles_of(data, offsets, rules.shingle)
                weights = np.ones(len(hashes))
                if rules.weights == "count":
                    hashes, weights, bounds = weigh(hashes, bounds)
                keys = band_keys(dart_signatures(hashes, weights, bounds, rules.bands * rules.rows), rules.bands, rules.rows)
                some = np.diff(bounds) > 0
                cut = np.concatenate([[0], np.cumsum(some * rules.bands)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), bands], names=["content", "bands"])

    return docs.select("content", "text").mapInArrow(run, "content binary, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two sorted (distinct hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return least / (a[1].sum() + b[1].sum() - least) if len(common) else 0.0


def _verified(pairs: DataFrame, rules: NearRules) -> DataFrame:
    """The rows of (a, b, text_a, text_b) whose similarity suffices, as (a, b)."""

    def sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, data, offsets in pieces(column):
            hashes, weights, bounds = weigh(*shingles_of(data, offsets, rules.shingle))
            if rules.weights == "set":
                weights = np.ones(len(weights))
            for x, y in zip(bounds[:-1], bounds[1:]):
                yield hashes[x:y], weights[x:y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                good = [similarity(x, y) >= rules.similarity for x, y in zip(sets(part.column(2)), sets(part.column(3)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _elements(column: pa.Array, rules: NearRules) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct elements, bounds): shingles or, with counts, one element for each occurrence."""
    for first, end, data, offsets in pieces(column):
        hashes, weights, bounds = weigh(*shingles_of(data, offsets, rules.shingle))
        if rules.weights == "count":
            n = weights.astype(np.int64)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bounds = np.concatenate([[0], np.cumsum(n)])[bounds]
            hashes = mix(np.repeat(hashes, n) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield first, end, hashes, bounds


def _sketched(texts: DataFrame, rules: NearRules) -> DataFrame:
    """(content, text, size, parity binary) of (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, bounds in _elements(batch.column(1), rules):
                rows = len(bounds) - 1
                cell = np.repeat(np.arange(rows), np.diff(bounds)) * PARITY_BITS + (mix(hashes) % np.uint64(PARITY_BITS)).astype(np.int64)
                odd = (np.bincount(cell, minlength=rows * PARITY_BITS) & 1).astype(np.uint8)
                words = pa.array(np.packbits(odd).view(np.int64))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (PARITY_BITS // 64)), words)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds).astype(np.int32)), parity], names=["content", "text", "size", "parity"])

    return texts.select("content", "text").mapInArrow(run, "content binary, text string, size int, parity array<long>")


def _sets(texts: DataFrame, rules: NearRules) -> DataFrame:
    """(content, shingles array<long>) of (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, bounds in _elements(batch.column(1), rules):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], names=["content", "shingles"])

    return texts.select("content", "text").mapInArrow(run, "content binary, shingles array<long>")


def _apart(x: str, y: str) -> Column:
    """In how many bits two parities differ."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))


def _may_be_near(apart: Column, sizes: Column, rules: NearRules) -> Column:
    """Whether two sets of so many elements in all may be similar enough."""
    return apart <= (1 - rules.similarity) / (1 + rules.similarity) * sizes + 1e-9


def _prefix_pairs(sets: DataFrame, marks: DataFrame, labels: DataFrame, rules: NearRules) -> DataFrame:
    """(a, b): all pairs of different components that may be similar enough, by prefix, position and parity.

    Shingles are put in order, rare ones first. Two sets that are similar enough have their first common shingle
    so early in both that what follows can still make up the overlap: sets meet only where they
    share such a shingle, which for copies of one text are those that few copies have. Both filters are exact.
    """
    tokens = sets.select("content", F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("s", "k")
    shared = tokens.join(often, F.col("s") == F.col("k")).groupBy("content").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("t"))
    marked = shared.join(marks.select(F.col("content").alias("c"), "size", "parity"), F.col("content") == F.col("c")).join(labels, F.col("content") == F.col("node"))
    # shingles of this set alone come first in its order and meet nothing
    alone = F.col("size") - F.size("t")
    reach = F.col("size") - F.ceil(rules.similarity * F.col("size") - 1e-9).cast("int") + 1 - alone
    early = marked.where(reach > 0).select("content", "root", "size", "parity", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), reach)).alias("place", "x"))
    early = early.select("content", "root", "size", "parity", (F.col("alone") + F.col("place")).alias("place"), F.col("x.s").alias("s"))
    x, y = early.alias("x"), early.alias("y")
    sizes = F.col("x.size") + F.col("y.size")
    enough = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= rules.similarity / (1 + rules.similarity) * sizes - 1e-9
    meet = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.content") > F.col("y.content")) & enough & _may_be_near(_apart("x.parity", "y.parity"), sizes, rules)
    return x.join(y, meet).select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()


def _counted(df: DataFrame, name: str, *columns: str) -> tuple[DataFrame, str, tuple]:
    """A written table, its path, and (rows, sum of hashes), observed while writing."""
    seen = Observation()
    digest = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("digest")
    out, path = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), digest), name)
    return out, path, (seen.get["rows"], seen.get["digest"])


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root), root the least node of the component, for all nodes in links (a, b); and its path."""
    spark = links.sparkSession
    edges, path, mark = _counted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", "u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, after, mark_after = _counted(small.where("u <> v").distinct(), "edges", "u", "v")
        discard(spark, path)
        path = after
        if mark == mark_after:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
            return roots, path
        mark = mark_after


def content_roots(spark: SparkSession, docs: DataFrame, rules: NearRules) -> DataFrame:
    """(node, root) of all contents that share a bucket with another, from (content, text)."""
    spent: list[str] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        out, path = materialize(df, name)
        spent.append(path)
        return out

    signed = written(_bands(docs, rules).groupBy("content").agg(F.any_value("bands").alias("bands")), "bands")
    members = signed.select(F.explode("bands").alias("key"), "content")
    shared = members.groupBy("key").agg(F.min("content").alias("centre"), F.max("content").alias("high")).where("centre <> high").select(F.col("key").alias("k"), "centre")
    # groups are written before they are joined: Spark splits a hot key's rows only between plain exchanges
    first, rest_path = materialize(members.join(written(shared, "shared"), F.col("key") == F.col("k")).select("key", "content", "centre"), "buckets")
    rest = first.select("key", "content")
    needed = rest.select(F.col("content").alias("c")).distinct()
    one_text = docs.groupBy("content").agg(F.any_value("text").alias("text"))
    texts = written(_sketched(one_text.join(needed, F.col("content") == F.col("c"), "left_semi"), rules), "texts")
    marks = texts.select("content", "size", "parity")
    labels, labels_path = materialize(texts.select(F.col("content").alias("node"), F.col("content").alias("root")), "labels")

    def nearest(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) that may be similar enough, for each a the NEAREST ones; an a has at most one b by band."""
        ends = [marks.select(F.col("content").alias(f"c{x}"), F.col("size").alias(f"s{x}"), F.col("parity").alias(f"p{x}")) for x in "ab"]
        held = pairs.distinct().join(ends[0], F.col("a") == F.col("ca")).join(ends[1], F.col("b") == F.col("cb"))
        sizes = F.col("sa") + F.col("sb")
        held = held.withColumn("apart", _apart("pa", "pb")).where(_may_be_near(F.col("apart"), sizes, rules))
        best = F.slice(F.sort_array(F.collect_list(F.struct((F.col("apart") / sizes).alias("far"), "b"))), 1, NEAREST)
        return held.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))

    def verify(pairs: DataFrame) -> tuple[DataFrame, int]:
        """Pairs whose texts are similar enough, and their number."""
        pairs = written(pairs, "pairs")
        held = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
        links, path, (n, _) = _counted(_verified(held, rules), "links", "a", "b")
        spent.append(path)
        return links, n

    def merged(links: DataFrame) -> None:
        """labels after the components that links connect are one."""
        nonlocal labels, labels_path
        ends = [labels.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab"]
        between = links.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        roots, path = components(between)
        moved = roots.select(F.col("node").alias("old"), F.col("root").alias("new"))
        after, after_path = materialize(labels.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        discard(spark, path, labels_path)
        labels, labels_path = after, after_path

    links, n = verify(nearest(first.where("content <> centre").select(F.col("content").alias("a"), F.col("centre").alias("b"))))
    for turn in range(ROUNDS + 1):
        if n:
            merged(links)
        # what is left: buckets that still hold several components
        rows = rest.join(labels, F.col("content") == F.col("node")).select("key", "content", "root")
        by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select(F.col("key").alias("k"), "largest")
        rows, path, (left, _) = _counted(rows.join(written(largest, "largest"), F.col("key") == F.col("k")).drop("k"), "buckets", "key")
        discard(spark, rest_path)
        rest, rest_path = rows.select("key", "content"), path
        if not left:
            break
        if n and turn < ROUNDS:
            inside = rows.where("root = largest").groupBy("key").agg(F.min_by("content", F.xxhash64("content", "key", F.lit(turn))).alias("b")).select(F.col("key").alias("k"), "b")
            met = rows.where("root <> largest").join(written(inside, "inside"), F.col("key") == F.col("k")).select(F.col("content").alias("a"), "b")
            links, n = verify(nearest(met))
            continue
        open_ones = rest.select(F.col("content").alias("c")).distinct()
        sets = written(_sets(texts.join(open_ones, F.col("content") == F.col("c"), "left_semi"), rules), "sets")
        links, n = verify(_prefix_pairs(sets, marks, labels, rules))
        if n:
            merged(links)
        break
    discard(spark, rest_path, *spent)
    return labels


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with ``root``: the component's, else the content itself."""
    return rows.join(roots, F.col("content") == F.col("node"), "left").withColumn("root", F.coalesce("root", "content")).drop("node")


def _content(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))).alias("content")


def classes(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, class_id (the least id of its class), class_size (documents)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _content(text), F.col(f"`{text}`").alias("text"))
    roots = content_roots(docs.sparkSession, rows, rules)
    contents = rows.groupBy("content").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    labelled, _ = materialize(_labelled(contents, roots), "labelled")
    by_root, _ = materialize(labelled.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")).withColumnRenamed("root", "r"), "classes")
    by_content = labelled.join(by_root, F.col("root") == F.col("r")).select(F.col("content").alias("c"), "class_id", "class_size")
    return rows.select("id", "content").join(by_content, F.col("content") == F.col("c")).select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_first(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of least id of each class, with all its columns."""
    spark = docs.sparkSession
    numbered, _ = materialize(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], _content(text), F.monotonically_increasing_id().alias("row")), "numbered")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = numbered.select("content", F.col(names[text]).alias("text"))
    roots = content_roots(spark, rows, rules)
    place = F.struct(F.col(names[id_col]).isNull().alias("last"), F.col(names[id_col]).alias("id"), F.col("row"))
    best = numbered.groupBy("content").agg(F.min(place).alias("best"))
    winners = _labelled(best, roots).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("winner"))
    kept = numbered.join(winners, F.col("row") == F.col("winner"), "left_semi")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
