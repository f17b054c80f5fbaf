"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import variants

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, noise=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def made(seed, alphabet, lengths, n_docs):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths))) for _ in range(25)]
    docs = []
    for i in range(n_docs):
        said = []
        for _ in range(rnd.randint(0, 60)):
            w = list(base[min(int(rnd.expovariate(0.3)), 24)])
            if rnd.random() < 0.25:
                at = rnd.randrange(len(w))
                how = rnd.randrange(3)
                w[at : at + (how > 0)] = rnd.choice(alphabet) if how < 2 else []
            said.append("".join(w).upper() if rnd.random() < 0.1 and "é" not in w else "".join(w))
        docs.append((i, rnd.choice([" ", ". ", "1", "\n"]).join(said)))
    return docs


@pytest.mark.parametrize(("seed", "alphabet", "lengths"), [(1, "abcdefghijé", (7, 8, 9, 12)), (2, "ab", (7, 8, 9)), (3, "aÿÀ×b", (7, 20))])
def test_variants_equal_brute_force(spark, seed, alphabet, lengths):
    docs = [*made(seed, alphabet, lengths, 80), (None, "leastword leastword"), (900, None), (901, ""), (902, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999 + "b")]
    docs += docs[:5]  # repeated rows
    found = variants.group(spark.createDataFrame(docs, "doc_id long, text string"), variants.VariantRules(noise=7))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(docs, 7)


def test_roots_follow_forms_to_the_last(spark):
    docs = [(1, " ".join(["abcdefgh"] * 400 + ["abcdefgx"] * 30 + ["abcdefyx"] * 2 + ["zzzzzzzzz"] * 3))]
    found = {r.word: r for r in variants.group(spark.createDataFrame(docs, "doc_id long, text string"), variants.VariantRules(noise=10**9)).collect()}
    assert (found["abcdefyx"].form, found["abcdefyx"].root, found["abcdefyx"].form_n) == ("abcdefgx", "abcdefgh", 30)
    assert (found["zzzzzzzzz"].form, found["zzzzzzzzz"].root, found["zzzzzzzzz"].n_near) == (None, "zzzzzzzzz", 0)


def test_columns_of_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "wordword wordword wordwort wordwort", 5, "x", 1)], "doc_id long, text string, n long, word string, gram int")
    assert {r.word: r.n_near for r in variants.group(docs, variants.VariantRules(noise=10**9)).collect()} == {"wordword": 1, "wordwort": 1}
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rnd = random.Random(4)
    for _ in range(300):
        places = sorted(rnd.sample(range(12), rnd.randint(3, 6)))
        costs = [rnd.randrange(50) for _ in places]
        found = variants.choose_pivots(places, costs, 2)
        pairs = [(i, j) for i, j in itertools.combinations(range(len(places)), 2) if places[j] - places[i] >= 2]
        assert tuple(found) in pairs
        assert sum(costs[i] for i in found) == min(costs[i] + costs[j] for i, j in pairs)
