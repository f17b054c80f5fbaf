"""Near-duplicate classes, repeated byte strings and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from plumbline.llm import decontaminate, minhash, suffix_dedup, wordarrays

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def near_classes(docs):
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (docs[i][1] or "") == (docs[j][1] or "") or common and common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), 1 << 60), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(docs)}


def test_classes_equal_brute_force(spark):
    rnd = random.Random(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 200))] for _ in range(12)]
    docs = [(900, None), (901, ""), (902, "a b"), (903, "A, b"), (904, "same"), (905, "same")]
    for i in range(300):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(w) // 40))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((i, " ".join(w)))
    found = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == near_classes(docs)


def test_keep_first_edges(spark):
    schema = "doc_id long, text string, content string, row long, root int"
    rows = [(1, "a b c d e f", "x", 1, None), (1, "a b c d e f", "x", 1, None), (None, "x", None, 1, 2), (3, None, "y", None, 1)]
    kept = minhash.keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "content", "row", "root"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    assert minhash.keep_first(spark.createDataFrame([], schema)).collect() == []


def test_darts_estimate_weighted_similarity():
    def signature(text, weights):
        _, _, data, offsets = next(wordarrays.pieces(pa.array([text])))
        hashes, counts, bounds = minhash.weigh(*minhash.shingles_of(data, offsets, 1))
        return minhash.dart_signatures(hashes, counts if weights == "count" else np.ones(len(hashes)), bounds, 2000)[0]

    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(20, 120))
    assert abs((signature(a, "set") == signature(b, "set")).mean() - 80 / 120) < 0.04
    a, b = " ".join(["x"] * 6 + ["y"] * 2 + ["z"]), " ".join(["x"] * 3 + ["y"] * 4 + ["q"])
    assert abs((signature(a, "count") == signature(b, "count")).mean() - 5 / 12) < 0.04


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(links, "a long, b long"))[0].collect()}
    assert found == {x: root(x) for x in parent}


def stripped(docs, size):
    seen = defaultdict(int)
    for _, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            seen[b[p : p + size]] += 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_bytes_equal_brute_force(spark):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(60, 600))) for _ in range(8)]
    make = lambda: "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 300)))]) for _ in range(rnd.randint(0, 6)))
    docs = [(i, make()) for i in range(80)] + [(996, None), (997, ""), (1000, "a" * 900), (1001, "ab" * 300), (1002, passages[0] * 3)]
    docs += docs[:10]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as t", "3 as runs")
    for group in (2_000, 2):  # also with anchors that are counted window by window
        found = suffix_dedup.strip_repeats(frame, 200, digests=True, group=group)
        assert sorted(map(tuple, found.collect())) == stripped(docs, 200)
    assert suffix_dedup.strip_repeats(frame.limit(0)).collect() == []


def test_first_occurrence_is_kept(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(400))
    docs = [(1, "q" * 5 + passage + "z"), (2, "r" + passage + "s"), (3, "r" + passage + "s"), (4, passage[:49])]
    rows = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 50, "first").collect()}
    assert rows[3] == "" and rows[4] == docs[3][1]
    assert sorted(len(rows[i]) - (len(docs[i - 1][1]) - 400) for i in (1, 2)) == [0, 400]


def decontaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, owners = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    owners |= windows[k]
        out[d] = (len(w), len(hit), sorted(owners))
    return out


def test_winnowing_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    make = lambda n, v: " ".join(rnd.choice(v) + rnd.choice(["", ".", ", "]) for _ in range(n))
    v = ["a", "b", "Cé", "d1", "Ü"]
    docs = [(i, make(rnd.randint(0, 200), v) if i % 9 else None) for i in range(150)]
    items = [(i, make(rnd.choice([0, 3, 9, 10, 11, 12, 15]), v)) for i in range(40)] + [(99, None), (3, "a b")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 3_000, 1_000):  # one block, several, and more than one stage takes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find(*frames).collect()}
        assert found == decontaminated(docs, items)
    kept = {r.doc_id for r in decontaminate.remove(*frames).collect()}
    assert decontaminate._items(frames[1], "item_id", "text")[1] > decontaminate.BLOCKS
    assert kept == {d for d, (_, n, _) in decontaminated(docs, items).items() if not n}
    assert decontaminate.find(frames[0].limit(0), frames[1]).collect() == []
    assert decontaminate.find(frames[0], frames[1].limit(0)).where("n_hit > 0").collect() == []


def test_a_built_block_is_no_larger_than_counted():
    rnd = random.Random(4)
    items = [(str(i), " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 400)))) for i in range(200)]
    block = decontaminate.Benchmark(items, decontaminate.WinnowRules())
    assert block.nbytes() <= sum(len(words(t)) * decontaminate.BYTES_A_WORD + len(i) for i, t in items)


def test_longest_previous_factors_equal_brute_force():
    rnd = random.Random(9)
    for _ in range(12):
        size = rnd.choice([16, 24, 40])
        bodies = ["".join(rnd.choice("ab") if rnd.random() < 0.3 else "a" for _ in range(rnd.randint(size, 3 * size))) for _ in range(8)]
        groups = np.array([rnd.randint(0, 1) for _ in bodies])
        data, bounds = "".join(bodies), np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        which = np.repeat(np.arange(8), [len(b) for b in bodies])
        starts, factor, source = suffix_dedup.previous_factors(np.frombuffer(data.encode(), np.uint8), bounds, groups, size)
        places = [p for p in range(len(data)) if p + size <= bounds[which[p] + 1]]
        assert starts.tolist() == places
        for p, length, q in zip(places, factor.tolist(), source.tolist()):
            common = lambda x, y: next((i for i in range(size) if data[x + i] != data[y + i]), size)
            want = max([common(p, x) for x in places if x < p and groups[which[x]] == groups[which[p]]], default=0)
            assert length == want and (length == 0 or q < p and common(p, q) == length)


def test_a_hot_anchor_is_split(spark):
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = make(260)
    docs = [(i, make(rnd.randint(0, 250)) + passage[rnd.choice([0, 0, 0, 5]) :] + make(rnd.randint(0, 250))) for i in range(2400)]
    found = suffix_dedup.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 200, digests=True)
    assert sorted(map(tuple, found.collect())) == stripped(docs, 200)


def test_edges_of_pairs_and_benchmark(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(empty).collect() == []
    rows = [(None, None), (None, None), (7, ""), (8, "one"), (8, "one"), (9, " , ")]
    found = sorted([tuple(r) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert found == [(7, 7, 3), (8, 8, 2), (8, 8, 2), (9, 9, 1), (None, 7, 3), (None, 7, 3)]
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, 2, 3, 4)], "doc_id long, text string, __items int, __n int, n_hit int, c0 int")
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "z")], "item_id long, text string")
    assert decontaminate.find(docs, items).first()["n_hit"] == 10
    assert decontaminate.remove(docs, items.where("item_id = 2")).columns == docs.columns


def test_very_long_texts(spark):
    rnd = random.Random(13)
    text = " ".join(rnd.choice("abcdefghijkl") + str(rnd.randint(0, 999)) for _ in range(150_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short"), (4, "x" * 1_000_000), (5, text[:400_000] + "y")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    items = spark.createDataFrame([(1, text[-200_000:]), (2, text[:100])], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert found[1]["items"] == ["1", "2"] and found[5]["items"] == ["2"] and found[4].n_hit == 0
    rows = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs, 200).collect()}
    assert bytes(rows[1].kept) == b"" and bytes(rows[2].kept) == b" more" and bytes(rows[4].kept) == b"" and bytes(rows[5].kept) == b"y" and bytes(rows[3].kept) == b"short"
