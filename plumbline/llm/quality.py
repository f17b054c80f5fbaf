"""Quality rules by distribution divergence, in DataFrame operations only.

Every document gets a histogram of character classes and one of the common words of its language,
found whatever their case and the punctuation beside them. Each is compared with its language's reference by
the Jensen-Shannon distance (base 2, so 0 to 1), rounded to six digits.

A reference can be given, so that no other row moves a verdict. Else it is, bin by bin, the median of
the shares of all distinct texts of the language that pass the base rules and reach the length guard,
in steps of 1 / ``STEPS``, divided by their sum. The median of steps is found by counting, so it
is exact, the same in whatever order rows come, and of bounded size; neither copies nor a third of junk move it far.
Languages outside ``COMMON_WORDS``, null included, share one reference, so there are five whatever the input.

Defined cases: a null text is the empty text and fails the word-count rule; an empty table gives
an empty result; repeated rows are judged alike and all returned; texts below ``guard_words``
words are judged by the base rules alone, since short histograms are noise. Other columns,
whatever their names, neither enter the result of ``assess`` nor change in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import NOT_SPACE, SPACE, let, whole, words_of
from .store import materialize

# Common function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are with be at as by this from or an not have which but his they had were you all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par avec sur pas au plus ce il sont ou aux se son cette ne sa mais".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre".split(),
}
#: Signs that part words when common ones are looked for.
MARKS = ".,;:!?()\"'«»“”"
STEPS = 10_000
OTHER = "other"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Distances above the maxima reject; see README for how they were set."""

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 100
    max_class_distance: float = 0.28
    max_word_distance: float = 0.27


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def language(lang: Column) -> Column:
    """The reference a document is held against."""
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def class_counts(text: Column) -> Column:
    """Code points by class: a-z, A-Z, beyond ASCII, digits, white space, sentence marks, the rest."""

    def rest(left: Column) -> Column:
        size = F.length(left)
        upper = size - _length_without(left, "[A-Z]+")
        far = size - _length_without(left, r"[\x{80}-\x{10FFFF}]+")
        digits = size - _length_without(left, "[0-9]+")
        space = size - _length_without(left, SPACE + "+")
        marks = size - _length_without(left, r"[.,;:!?'\"()-]+")
        return F.array(F.length(text) - size, upper, far, digits, space, marks, size - upper - far - digits - space - marks)

    return let(F.regexp_replace(text, "[a-z]+", ""), rest)


def common_word_counts(text: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, then of all other words."""
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    size = len(COMMON_WORDS["en"])
    chosen = F.coalesce(F.element_at(lists, lang), F.array_repeat(F.lit(""), size))
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    words = words_of(F.translate(F.lower(text), MARKS, " " * len(MARKS)))

    def counts(w: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(*every)), "  "), F.lit(" "))

        def count(padded: Column) -> Column:
            def one(word: Column) -> Column:
                gone = F.octet_length(padded) - F.octet_length(F.replace(padded, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
                return F.when(word == "", F.lit(0)).otherwise((gone / (F.octet_length(word) + 2)).cast("int"))

            return F.transform(chosen, one)

        return let(let(padded, count), lambda c: F.concat(c, F.array(F.size(w) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))

    return let(words, counts)


def shares(counts: Column) -> Column:
    """Counts divided by their sum; all zero if that is zero."""

    def divided(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        return let(total, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return let(counts, divided)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two aligned histograms of shares."""

    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_window_words(words: Column) -> Column:
    """Words inside windows of three that the text holds twice or more.

    Windows are compared by a 64-bit hash within one text. Few repeated windows are found by
    membership; many by sorting (hash, position), so no text costs the square of its length.
    """
    none = F.array().cast("array<bigint>")

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.get(starts, i + 1) - p))
        return F.aggregate(steps, F.lit(0).cast("int"), lambda a, x: a + x)

    def few(hashes: Column, twice: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i).otherwise(F.lit(-1)))
        return let(F.filter(marked, lambda p: p >= 0), covered)

    def many(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def marked(x: Column) -> Column:
            beside = lambda v, i: (v["h"] == F.get(x, i - 1)["h"]) | (v["h"] == F.get(x, i + 1)["h"])
            return F.sort_array(F.transform(F.filter(x, beside), lambda v: v["p"]))

        return let(let(pairs, marked), covered)

    def by_hash(hashes: Column) -> Column:
        def sorted_(x: Column) -> Column:
            return F.array_distinct(F.filter(x, lambda h, i: (i > 0) & (h == F.get(x, F.greatest(i - 1, F.lit(0))))))

        return let(
            let(F.sort_array(hashes), sorted_),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 16, few(hashes, twice)).otherwise(many(hashes)),
        )

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashed = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, hashed).otherwise(none)

    return let(let(words, windows), by_hash)


def _measure(text: Column, lang: Column) -> Column:
    """One struct with the base counts and both histograms as counts; text is whole, lang the reference's name."""

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _length_without(text, SPACE + "+").cast("long").alias("word_chars"),
            (F.length(text) - _length_without(text, "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
            repeated_lines(text).cast("long").alias("n_dup_lines"),
            repeated_window_words(w).cast("long").alias("n_repeat_words"),
            class_counts(text).alias("c"),
            common_word_counts(text, lang).alias("w"),
            F.xxhash64(text).alias("h"),
        )

    return let(words_of(text), of)


def _base_failed(m: Column, rules: QualityRules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def references(rows: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``ref_lang``, ``ref_c``, ``ref_w``: median histograms by language over measured rows (``__l``, ``__m``), at most five rows."""
    m = F.col("__m")

    def steps(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, F.floor((x.cast("long") * (2 * STEPS) + n) / (2 * n)).cast("int")).otherwise(F.lit(0))))

    good = rows.where((m["n_words"] >= rules.guard_words) & ~_base_failed(m, rules))
    texts = good.groupBy(F.col("__l").alias("l"), m["h"].alias("h")).agg(F.any_value(F.concat(steps(m["c"]), steps(m["w"]))).alias("q"))
    counted = texts.select("l", F.posexplode("q").alias("i", "q")).groupBy("l", "i", "q").agg(F.count(F.lit(1)).alias("n"))
    bins = Window.partitionBy("l", "i")
    counted = counted.select("l", "i", "q", F.sum("n").over(bins.orderBy("q")).alias("upto"), F.sum("n").over(bins).alias("all"))
    medians = counted.where(2 * F.col("upto") >= F.col("all")).groupBy("l", "i").agg(F.min("q").alias("q"))
    listed = medians.groupBy("l").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    n_classes, n_words = 7, len(COMMON_WORDS["en"]) + 1
    return listed.select(F.col("l").alias("ref_lang"), shares(F.slice("q", 1, n_classes)).alias("ref_c"), shares(F.slice("q", n_classes + 1, n_words)).alias("ref_w"))


def _verdict(m: Column, rules: QualityRules) -> Column:
    """Base counts, distances from ``ref_c`` and ``ref_w``, base_failed and kept."""
    guarded = m["n_words"] >= rules.guard_words
    far = {k: F.when(guarded, F.coalesce(F.round(js_distance(shares(m[k]), F.col(f"ref_{k}")), 6), F.lit(0.0))).otherwise(F.lit(0.0)) for k in "cw"}
    failed = _base_failed(m, rules)
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    judged = F.struct(*counts, failed.alias("base_failed"), far["c"].alias("class_distance"), far["w"].alias("word_distance"))

    def kept(q: Column) -> Column:
        good = ~q["base_failed"] & (q["class_distance"] <= rules.max_class_distance) & (q["word_distance"] <= rules.max_word_distance)
        return F.struct(*[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance")], good.alias("kept"))

    return let(judged, kept)


def _measured(docs: DataFrame, keep: list[str], rules: QualityRules, text: str, lang: str, refs: DataFrame | None) -> DataFrame:
    """Columns keep as c0, c1 .., ``__m``, ``ref_c``, ``ref_w``. Measures are written once: the references need all before the first verdict."""
    t, of = whole(F.col(f"`{text}`")), language(F.col(f"`{lang}`"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], of.alias("__l"), _measure(t, of).alias("__m"))
    if refs is None:
        rows, _ = materialize(rows, "quality")
        refs, _ = materialize(references(rows, rules), "references")
    return rows.join(F.broadcast(refs), F.col("__l") == F.col("ref_lang"), "left")


def assess(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text: str = "text", lang: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """One row a document: id_col, the base counts, both distances, base_failed and kept.

    refs: references (``ref_lang``, ``ref_c``, ``ref_w``: shares) that hold instead of those of docs.
    """
    rows = _measured(docs, [id_col], rules, text, lang, refs)
    return rows.select("c0", _verdict(F.col("__m"), rules).alias("q")).select(F.col("c0").alias(id_col), "q.*")


def keep(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """The documents that pass, with all their columns unchanged. refs: as for assess."""
    rows = _measured(docs, docs.columns, rules, text, lang, refs)
    # unwritten measures are one expression, so that a filter pushed about evaluates it once
    kept = _verdict(F.col("__m"), rules)["kept"] if refs is None else let(F.col("__m"), lambda m: _verdict(m, rules)["kept"])
    return rows.where(kept).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
