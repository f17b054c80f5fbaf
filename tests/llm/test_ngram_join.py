"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import ngram_join, wordarrays
from plumbline.llm.bitmaps import bitmap, may_have


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), 1 << 60), d)
    return {(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


def made(seed, n, groups, edits):
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 220))] for _ in range(groups)]
    line = [rnd.choice(vocabulary) for _ in range(60)]
    docs = [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a"), (9006, "b"), (9007, "a b c d"), (9008, "a b c")]
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((i, " ".join(w + line if rnd.random() < 0.4 else w)))
    return docs


@pytest.mark.parametrize(("seed", "frequent", "groups", "edits"), [(1, 100, 14, 6), (2, 2, 6, 9), (3, 100, 2, 12), (4, 5, 40, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent, groups, edits):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = made(seed, 250, groups, edits)
    docs += [(10_000 + d, t) for d, t in docs[:20]]  # copies
    found = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(docs)
    assert set(rows) == brute(docs)


def test_very_long_text_nulls_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    schema = "doc_id long, text string, content binary, s long, root int"
    docs = [(5, long, None, 1, 1), (4, long + " end", None, 1, 1), (None, long, None, 1, 1), (None, "x y", None, 1, 1), (7, "x y", None, 1, 1)]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, schema)).collect()}
    assert found == {(5, 149_997, 4), (4, 149_998, 4), (None, 149_997, 4), (None, 1, 7), (7, 1, 7)}
    assert ngram_join.join(spark.createDataFrame([], schema)).collect() == []


def test_frequent_grams_are_exactly_those_of_many(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9)))) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bits = ngram_join._frequent(frame, ngram_join.JoinRules()).value
    counts = {}
    for _, text in docs:
        _, _, data, offsets = next(wordarrays.pieces(pa.array([text])))
        for h in set(ngram_join.shingles_of_words(data, offsets, 4)[0].tolist()):
            counts[h] = counts.get(h, 0) + 1
    hashes = np.array(list(counts), np.uint64)
    assert may_have(bits, hashes).tolist() == [n > ngram_join.FREQUENT for n in counts.values()]


def test_bitmap_has_all_its_hashes(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = bitmap(spark.createDataFrame([(int(h),) for h in hashes], "h long")).value
    assert may_have(bits, hashes.view(np.uint64)).all()
    assert may_have(bits, np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64)).sum() < 20


def test_parities_never_rule_out_a_link(spark):
    rnd = random.Random(7)
    vocabulary = [f"v{i}" for i in range(50)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 5, 30, 31, 33, 34, 66, 130]))) for _ in range(60)]
    texts += [" ".join((t + " tail").split()[rnd.randrange(2) :]) for t in texts]
    frame = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "content binary, text string")
    held = {r.content[0]: (r.size, r.parity) for r in ngram_join._prefixes(frame, ngram_join._frequent(frame, ngram_join.JoinRules()), ngram_join.JoinRules()).collect()}
    pairs = [(i, j, held[i][1], held[j][1]) for i in held for j in held if i < j and max(len(held[i][1]), len(held[j][1])) <= 2 * min(len(held[i][1]), len(held[j][1]))]
    found = spark.createDataFrame(pairs, "i int, j int, x array<long>, y array<long>").select("i", "j", ngram_join._apart("x", "y").alias("d")).collect()
    assert len(found) == len(pairs)
    for r in found:
        assert r.d <= len(shingles(texts[r.i]) ^ shingles(texts[r.j]))
    assert any(r.d > 0 for r in found)
