"""Phrases of two and three words that stand together more often than their parts explain, by language.

Best-first branch and bound over prefixes. Words grow to pairs and pairs to triples; what a node's counts say bounds
the score of all that grows from it. No phrase is more frequent than its parts, so pairs of rare words are
never counted. A triple x y z occurs at most m times, the lesser of how often x y does and how often the most frequent pair
after y does; its cut after x then scores at most m / f(x), for the rest of a phrase is as frequent as the phrase. Pairs
are settled first, the best ones: a language's threshold is the score that enough of its pairs reach. All nodes whose bound reaches it are grown, and
all triples that hold a pair which reaches it are counted, since they may drop it. Then every score from the threshold up
is known. Where fewer than ``first`` phrases survive there, the threshold falls and the frontier grows, until
they do (ties included) or the whole tree is grown.

Every growth is one pass over the texts; pairs are counted by hash first, then only the frequent ones by their text. A task counts its own grams before anything is shuffled, so a word of every line costs
a few rows a task. Which grams are worth counting is told by bitmaps of fixed size; they may let a gram through
for nothing, never miss one, and counts are always of the text itself.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they occur; texts are taken
whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, frequent, may_have
from .store import discard, materialize
from .wordarrays import LOWER, grams, mix, pieces, words_of

#: Scores are shares of so much.
SCALE = 1_000_000
#: Grams that a task holds before it hands them on.
HELD = 100_000
#: Rows of texts taken at once.
ROWS = 200
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


@dataclass(frozen=True)
class PhraseRules:
    """Phrases of 10 occurrences at least; each language's first 2,000; one inside a longer one of 50 % of its occurrences goes."""

    least_count: int = 10
    first: int = 2000
    inside_percent: int = 50


Chooser = Callable[[np.ndarray, np.uint64], np.ndarray]


def _salt(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, number of its piece) of the words of texts that each end in a line feed."""
    data = LOWER[data]
    start, end, hashes, _ = words_of(data, offsets, _WORD)
    return start, end, hashes, np.cumsum(_BREAK[data])[start]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of a batch (lang, text), a few rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        codes = part.column(0).dictionary_encode()
        for code, lang in enumerate(codes.dictionary.to_pylist()):
            yield lang, part.column(1).take(pa.array(np.flatnonzero(codes.indices.to_numpy() == code)))


def _grams_of(data: np.ndarray, offsets: np.ndarray, size: int, choose: Chooser, salt: np.uint64) -> pa.Array:
    """Chosen grams of consecutive words of a piece, space-joined. Every text ends in a line feed."""
    data = LOWER[data]
    start, end, hashes, part = _words(data, offsets)
    if len(start) < size:
        return pa.array([], pa.large_string())
    last = len(start) - size + 1
    at = np.flatnonzero((part[:last] == part[size - 1 :]) & choose(hashes, salt))
    kept = _WORD[data]
    kept[end] = True  # one space after every word
    data[end] = 0x20
    joined = data[kept]
    length = end - start
    begins = np.cumsum(length + 1) - (length + 1)
    first, sizes = begins[at], begins[at + size - 1] + length[at + size - 1] - begins[at]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    bytes_ = joined[np.repeat(first - cuts[:-1], sizes) + np.arange(cuts[-1])]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(bytes_))


def _counted(docs: DataFrame, size: int, choose: Chooser, least: int) -> DataFrame:
    """(lang, gram, n) of chosen grams that occur often enough, from (lang, text); with size 1 also the number of all words, as gram ''."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for lang, texts in (x for batch in batches for x in _by_lang(batch)):
            for _, _, data, offsets in pieces(texts):
                found = pc.value_counts(_grams_of(data, offsets, size, choose, _salt(lang)))
                gram, n = found.field(0).cast(pa.string()), found.field(1)
                if size == 1:
                    gram, n = pa.concat_arrays([gram, pa.array([""], pa.string())]), pa.concat_arrays([n, pa.array([pc.sum(n).as_py() or 0], pa.int64())])
                held.append(pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(gram)), gram, n], ["lang", "gram", "n"]))
                rows += len(gram)
            if rows > HELD:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    each = docs.mapInArrow(run, "lang string, gram string, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("gram") == ""))


def _hashes(table: DataFrame) -> DataFrame:
    """h, as the texts' grams are hashed, of (lang, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = np.array([_salt(x) for x in batch.column(0).to_pylist()], np.uint64)
            for first, end, data, offsets in pieces(batch.column(1)):
                _, _, words, bounds = words_of(data, offsets, _WORD)
                size = np.diff(bounds)
                for k in np.unique(size[size > 0]):
                    some = np.flatnonzero(size == k)
                    h = _hash(words, int(k))[bounds[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(mix(h ^ salts[first:end][some]).view(np.int64))], names=["h"])

    return table.select("lang", "gram").mapInArrow(run, "h long")


def _hash(words: np.ndarray, size: int) -> np.ndarray:
    return words if size == 1 else grams(words, size)


def _all(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    return np.ones(len(hashes), bool)


def _often_pairs(texts: DataFrame, words: Broadcast, least: int) -> Broadcast:
    """The bitmap of pairs of frequent words that occur often enough."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for lang, some in _by_lang(batch):
            for _, _, data, offsets in pieces(some):
                _, _, words_, part = _words(data, offsets)
                often = may_have(words.value, mix(words_ ^ _salt(lang)))
                yield mix(_hash(words_, 2) ^ _salt(lang))[often[:-1] & often[1:] & (part[:-1] == part[1:])]

    return frequent(texts.select("lang", "text"), hashes, least)


def _of_pairs(often: Broadcast) -> Chooser:
    def choose(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
        return may_have(often.value, mix(_hash(hashes, 2) ^ salt))

    return choose


def _of_frontier(often: Broadcast, prefixes: Broadcast, suffixes: Broadcast) -> Chooser:
    def choose(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
        pairs = mix(_hash(hashes, 2) ^ salt)
        known = may_have(often.value, pairs)
        return known[:-1] & known[1:] & (may_have(prefixes.value, pairs[:-1]) | may_have(suffixes.value, pairs[1:]))

    return choose


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), in 38 digits."""
    return F.expr(f"cast({SCALE}BD * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) as decimal(38,0)) div cast(cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)) as decimal(38,0))")


def _known(rows: DataFrame, table: DataFrame, gram: str, name: str) -> DataFrame:
    """rows with the count of what column gram holds."""
    there = table.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("n").alias(name))
    return rows.join(there, (F.col("lang") == F.col("_lang")) & (F.col(gram) == F.col("_gram"))).drop("_lang", "_gram")


def _thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, least): a score that wanted pairs of the language reach; 0 if it has no more."""
    step = F.floor(50 * F.log2(F.col("score") + 1)).alias("step")
    steps = pairs.groupBy("lang", step).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))  # 1,000 steps at most
    reached = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.withColumn("reached", reached).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= wanted, F.col("least"))), F.lit(0).cast("long")).alias("least"))


def _first(rows: DataFrame, first: int) -> DataFrame:
    """Each language's first rows, ranked; first among parts of a language, so no task gets all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= first).drop("rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)


def mine(docs: DataFrame, rules: PhraseRules = PhraseRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("\n")).alias("text"))
    all_words, words_path = materialize(_counted(texts, 1, _all, rules.least_count), "words")
    words = all_words.where("gram <> ''")
    often = _often_pairs(texts, bitmap(_hashes(words)), rules.least_count)
    counted, path = materialize(_counted(texts, 2, _of_pairs(often), rules.least_count), "pairs")
    first_word, last_word = F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1)
    parted = counted.withColumns({"x": first_word, "y": last_word})
    after = parted.groupBy("lang", "x").agg(F.max("n").alias("most")).select(F.col("lang").alias("_lang"), F.col("x").alias("_x"), "most")
    scored = _known(_known(parted, words, "x", "l"), words, "y", "r").withColumn("score", _score("n", "l", "r"))
    bound = F.expr(f"cast({SCALE}BD * cast(least(n, most) as decimal(18,0)) as decimal(38,0)) div cast(l as decimal(38,0))")
    pairs, pairs_path = materialize(scored.join(after, (F.col("lang") == F.col("_lang")) & (F.col("y") == F.col("_x")), "left").select("lang", "gram", "n", "l", "r", "score", bound.alias("bound")), "nodes")
    discard(spark, path)
    often_pairs = bitmap(_hashes(pairs))
    open_langs = pairs.select("lang").distinct()
    done: list[DataFrame] = []
    spent: list[str] = []
    wanted = 2 * rules.first
    while True:
        here = pairs.join(open_langs, "lang", "left_semi")
        least, least_path = materialize(_thresholds(here, wanted).select(F.col("lang").alias("_l"), "least"), "thresholds")
        nodes = here.join(least, F.col("lang") == F.col("_l"))
        shown = nodes.where(F.col("score") >= F.col("least"))
        grown = nodes.where((F.col("score") >= F.col("least")) | (F.col("bound") >= F.col("least")))
        chooser = _of_frontier(often_pairs, bitmap(_hashes(grown)), bitmap(_hashes(shown)))
        triples, triples_path = materialize(_counted(texts, 3, chooser, rules.least_count), "triples")
        cut = triples.withColumns({"x": first_word, "z": last_word, "xy": F.substring_index("gram", " ", 2), "yz": F.substring_index("gram", " ", -2)})
        cut = _known(_known(_known(_known(cut, words, "x", "f_x"), pairs, "yz", "f_yz"), pairs, "xy", "f_xy"), words, "z", "f_z")
        cut = cut.withColumns({"s1": _score("n", "f_x", "f_yz"), "s2": _score("n", "f_xy", "f_z")}).withColumn("early", F.col("s1") <= F.col("s2"))
        triple_rows = cut.select("lang", "gram", "n", F.when(F.col("early"), F.col("f_x")).otherwise(F.col("f_xy")).alias("l"), F.when(F.col("early"), F.col("f_yz")).otherwise(F.col("f_z")).alias("r"), F.least("s1", "s2").alias("score"))
        holds = cut.select("lang", F.explode(F.array("xy", "yz")).alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("longer")).select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "longer")
        kept = shown.join(holds, (F.col("lang") == F.col("_lang")) & (F.col("gram") == F.col("_gram")), "left").where(F.col("longer").isNull() | (100 * F.col("longer") < rules.inside_percent * F.col("n")))
        good = triple_rows.join(least, F.col("lang") == F.col("_l")).where(F.col("score") >= F.col("least"))
        settled, settled_path = materialize(kept.select("lang", "gram", "n", "l", "r", "score", "least").unionByName(good.select("lang", "gram", "n", "l", "r", "score", "least")), "settled")
        by_lang = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state, state_path = materialize(least.join(by_lang, F.col("_l") == F.col("lang"), "left").select(F.col("_l").alias("lang"), ((F.col("least") == 0) | (F.coalesce("found", F.lit(0)) >= rules.first)).alias("over")), "state")
        done.append(settled.join(state.where("over").select("lang"), "lang", "left_semi"))
        spent += [least_path, triples_path, state_path]
        open_langs = state.where(~F.col("over")).select("lang")
        if open_langs.isEmpty():
            break
        wanted *= 4
    total = all_words.where("gram = ''").select(F.col("lang").alias("_lang"), F.col("n").alias("n_words"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ranked = _first(found.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "l", "r", "score"), rules.first)
    return ranked.join(total, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
