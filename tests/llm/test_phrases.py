"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import pytest

from plumbline.llm import phrases


def brute(docs, rules):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    rows = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= rules.least_count:
            cuts = [(phrases.SCALE * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    gone = {(lang, q) for (lang, p), row in rows.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * row[0] >= rules.inside_percent * rows[lang, q][0]}
    out = set()
    for lang in total:
        mine = [(" ".join(p), *row) for (x, p), row in rows.items() if x == lang and (x, p) not in gone]
        mine.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out |= {(lang, i + 1, *r[:4], total[lang], r[4]) for i, r in enumerate(mine[: rules.first])}
    return out


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "Ünd", "x y"]
    fixed = ["New York City", "of the", "ad hoc", "a b c d"]
    docs = []
    for i in range(n):
        lang = rnd.choice(["en", "en", "en", "fr", None])
        said = [rnd.choice(fixed) if rnd.random() < 0.1 else vocabulary[min(int(rnd.expovariate(0.12)), 42)] for _ in range(rnd.randint(0, 90))]
        docs.append(("".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in said), lang))
    return docs


@pytest.mark.parametrize("rules", [phrases.PhraseRules(), phrases.PhraseRules(first=5), phrases.PhraseRules(least_count=3, first=20, inside_percent=90), phrases.PhraseRules(least_count=1, first=7)])
def test_phrases_equal_brute_force(spark, rules):
    docs = [*made(1, 150), (None, "en"), ("", None), ("one", "single"), (" ".join(["again"] * 300), "same")]
    docs += docs[:10]
    found = phrases.mine(spark.createDataFrame(docs, "text string, lang string"), rules)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(docs, rules)


def test_dropped_pairs_lower_the_threshold(spark):
    # all good pairs lie inside triples, so the first threshold settles too few
    docs = [(f"t{i} u{i} v{i}. " * 12, "en") for i in range(30)] + [(f"p{i} q{i}. p{i} r{i}. " * 11, "en") for i in range(30)]
    rules = phrases.PhraseRules(first=40)
    found = phrases.mine(spark.createDataFrame(docs, "text string, lang string"), rules)
    assert {tuple(r) for r in found.collect()} == brute(docs, rules)


def test_columns_of_clashing_names_and_empty_tables(spark):
    schema = "text string, lang string, gram string, n long, least int, x string"
    rows = [("a b. " * 10, "en", "g", 1, 2, "x")]
    found = phrases.mine(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in found] == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]
    assert phrases.mine(spark.createDataFrame([], schema)).collect() == []


def test_scores_pass_64_bits(spark):
    n = 10**12
    row = spark.createDataFrame([(n, n, n + 7)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * n * n // (n * (n + 7))
