"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random

import pytest

from plumbline.llm import bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "Hello  world\n\n it's 1234\t", "é😀ﷺ" * 5, "x" * 5000, "ab" * 3000, "<|endoftext|> a<|endoftext|>", "same", "same"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.load_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(library):
    encoder = bpe.Encoder(bpe.load_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    rnd = random.Random(0)
    texts = ["".join(rnd.choice('aaabcé \n😀ﷺ<|"') for _ in range(rnd.randint(0, 80))) for _ in range(500)] + [t or "" for t in TEXTS]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
    assert not encoder.queue.buckets and not any(encoder.queue.low)


def test_encode_rows(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    for row in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = TEXTS[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text) and bytes(row.decoded).decode() == text
    for row in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect():
        ids = library.encode_ordinary(TEXTS[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice(["a", "'s", "<|endoftext|>", " ", "\n", "é", "|>", "<|", "1"]) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = token_counts.count_tokens(docs, path).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(docs.limit(0), path).collect() == []


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_frequent_pieces_come_from_all_rows(spark):
    rows = [(" often" + " some" * (i % 2) + f" once{i}",) for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    assert token_counts.frequent_table(docs, summary=200, sent=60)[:2] == [" often", " once"]
    assert {" often", " some"} <= set(token_counts.frequent_table(docs, summary=200, sent=60)[:3])
    assert token_counts.frequent_table(docs.limit(0)) == []


def test_long_texts_and_clashing_names(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(3)
    text = " ".join(rnd.choice("abcdefg") * rnd.randint(1, 9) for _ in range(100_000)) + "x" * 300_000
    docs = spark.createDataFrame([(1, text, 5, 6, 7)], "doc_id long, text string, id int, n_tokens int, piece int")
    row = token_counts.count_tokens(docs, path).first()
    assert (row.n_bytes, row.n_tokens) == (len(text), len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids))
