"""Spelling variants of words, by pivotal grams.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Bigrams are put in
one order, rare ones first. A word's prefix are its three rarest bigrams (and what ties with the third); its pivots
are two of them that share no code point, chosen by dynamic programming for the least sum of ranks. One edit leaves one of two disjoint bigrams whole, so of two near words the one whose prefix
ends earlier in the order has a pivot in the other's prefix. It also hardly moves it, and leaves the word whole on
one side of it. If the edit comes after the bigram, this stands at the same place and the words are alike up to its end; if
before, it stands as many places further as the other word is longer, and they are alike from it on. So pivots meet
prefixes in an equi-join on place, length and the hash of the whole side, bigram included. What meets is verified by edit
distance, after a look at which letters each word has an odd number of times: one edit changes two of these at most.

Bigrams of the alphabet are 8,100 at most, so their frequencies are broadcast. All else is joined and counted by key.

Defined cases: null, empty and wordless texts have no words; a null id is written as nothing before the colon;
repeated rows count as often as they occur; a run of any length is one word; an empty table gives an empty result;
further columns are not read. A word without near words has n_near 0, no form, and itself as its root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

_BASE, _PRIME = 1_000_003, (1 << 61) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class VariantRules:
    """Words of 7 code points and 2 occurrences at least; a form occurs 10 times as often; one run in 31 loses a code point."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10
    noise: int = 31


def _without(word: Column, at: Column) -> Column:
    """word less its code point number at, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def word_counts(docs: DataFrame, rules: VariantRules = VariantRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: distinct words that are long and frequent enough, after the noise."""
    # a run only loses code points, so shorter ones never matter; the match is greedy, so it is a whole run
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{rules.least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    words = hashed.select(F.when(F.col("h") % rules.noise == 0, _without(F.col("run"), place)).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= rules.least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rules.least_count)


def choose_pivots(places: list[int], costs: list[int], count: int, width: int = 2) -> list[int]:
    """Of grams at ascending places, count ones that don't overlap and cost least in all, as indexes.

    best[k][i]: the least cost of k disjoint grams among the first i; the last is either left out or
    taken with k - 1 of those that end before it begins.
    """
    ends_before = [sum(p + width <= q for p in places[:i]) for i, q in enumerate(places)]
    best: list[list[tuple[int, ...] | None]] = [[(0,)] * (len(places) + 1)]
    for k in range(1, count + 1):
        row: list[tuple[int, ...] | None] = [None]
        for i, cost in enumerate(costs):
            shorter = best[k - 1][ends_before[i]]
            taken = (shorter[0] + cost, *shorter[1:], i) if shorter else None
            row.append(min((x for x in (row[i], taken) if x), key=lambda x: x[0], default=None))
        best.append(row)
    return list((best[count][-1] or (0,))[1:])


def _signed(grams: DataFrame) -> DataFrame:
    """(word, odd, last, left, right, place, pivot) of prefix grams; odd: letters by the parity of their number; last: rank of the prefix's last gram; left, right: hashes of the word up to the gram's end and from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, ranks, places in zip(*(c.to_pylist() for c in batch.columns)):
                order = sorted(range(len(ranks)), key=ranks.__getitem__)
                last = ranks[order[2]]
                prefix = sorted((i for i in order if ranks[i] <= last), key=places.__getitem__)
                odd = 0
                for c in word:
                    odd ^= 1 << ord(c) % 63
                left, right = _sides(word, [places[i] for i in prefix])
                pivots = set(choose_pivots([places[i] for i in prefix], [ranks[i] for i in prefix], 2)) if len(prefix) < 1000 else _far_apart(places, prefix, order)
                rows += ((word, odd, last, left[j], right[j], places[i], j in pivots) for j, i in enumerate(prefix))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return grams.select("word", "ranks", "places").mapInArrow(run, "word string, odd long, last int, left long, right long, place int, pivot boolean")


def _sides(word: str, places: list[int]) -> tuple[list[int], list[int]]:
    """Hashes of word up to the end of the bigram at each place (from 1), and from its start on."""
    sums = [0]
    for c in word:
        sums.append((sums[-1] * _BASE + ord(c)) % _PRIME)
    n = len(word)
    return [sums[p + 1] for p in places], [(sums[n] - sums[p - 1] * pow(_BASE, n - p + 1, _PRIME)) % _PRIME for p in places]


def _far_apart(places: list[int], prefix: list[int], order: list[int]) -> set[int]:
    """Pivots of a word with very many ties: its rarest gram and the next rare one that doesn't overlap it."""
    first = order[0]
    second = next(i for i in order if abs(places[i] - places[first]) >= 2)
    return {j for j, i in enumerate(prefix) if i in (first, second)}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "odd", "last", "left", "right", "place", "pivot"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of words one edit apart, from distinct words of five code points or more."""
    pairs_of = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring("word", i, F.lit(2)).alias("g"), i.alias("p")))
    grams = words.select("word", F.explode(pairs_of).alias("x")).select("word", "x.g", "x.p")
    often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    # 90 letters make 8,100 bigrams at most: one task numbers them, and all tasks get them
    rank = often.select(F.col("g").alias("gram"), F.row_number().over(_by("often", "g")).alias("rank"))
    ranked = grams.join(F.broadcast(rank), F.col("g") == F.col("gram")).groupBy("word").agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("place"), "rank"))).alias("r"))
    signed, path = materialize(_signed(ranked.select("word", F.col("r.rank").alias("ranks"), F.col("r.place").alias("places"))), "pivots")
    length = F.length("word")
    shifts = [("left", 0, 0), ("right", 0, 0), ("left", 1, 0), ("right", 1, 1), ("left", -1, 0), ("right", -1, -1)]
    key = lambda side, longer, moved: F.xxhash64(F.lit(side), side, length + longer, F.col("place") + moved)
    x = signed.where("pivot").select("word", "odd", "last", F.explode(F.array(*[key(*s) for s in shifts])).alias("key")).alias("x")
    y = signed.select("word", "odd", "last", F.explode(F.array(key(*shifts[0]), key(*shifts[1]))).alias("key")).alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.last") <= F.col("y.last"))
    meet = meet & (F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= 2)
    one_edit = F.levenshtein("x.word", "y.word", 1) == 1
    found = x.join(y, meet & one_edit).select(F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b")).distinct()
    out, _ = materialize(found, "near")
    discard(words.sparkSession, path)
    return out


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, from (word, form). Every step at least doubles what was walked; forms are ever more frequent, so there are no circles."""
    at, path = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("w"), F.col("root").alias("further"))
        moved = at.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after, after_path = materialize(moved, "roots")
        discard(forms.sparkSession, path)
        at, path = after.select("word", "root"), after_path
        if after.where("moved").isEmpty():
            return at


def group(docs: DataFrame, rules: VariantRules = VariantRules(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs."""
    words, _ = materialize(word_counts(docs, rules, id_col, text), "words")
    near = near_words(words)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("o"), F.col("n").alias("other_n"))
    # the most frequent, of these the least word
    best = both.join(other, F.col("b") == F.col("o")).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    known = words.join(best, F.col("word") == F.col("a"), "left")
    has_form = -F.col("best.less") >= rules.ratio * F.col("n")
    told, _ = materialize(known.select("word", F.when(has_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(told.where("form is not null")).select(F.col("word").alias("w"), "root")
    return told.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
