"""The pipeline against its stages' brute-force versions on a small table, and the registered queries."""

import pytest

import corpus_pipeline
from plumbline.llm import bpe, pii, queries, quality
from tests.llm.test_dedup import decontaminated, near_classes

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality.assess(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    docs = [(d, t) for d, t in docs if d in kept]
    classes = near_classes(docs)
    docs = [(d, t) for d, t in docs if classes[d] == d]
    hits = decontaminated(docs, items)
    docs = [(d, t) for d, t in docs if not hits[d][1]]
    encoder = bpe.Encoder(bpe.load_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()), public_tokenizers.PATTERN)
    want = {}
    for d, t in docs:
        out, at = "", 0
        for kind, a, b in pii.all_spans(t, pii.fit())[1]:
            if a >= at:
                out, at = out + t[at:a] + f"[{kind.upper()}]", b
        want[d] = out + t[at:]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.ids == encoder.encode(r.text) and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty benchmark, an empty table."""
    pytest.importorskip("public_tokenizers")
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(1, text(1), "en", "s", 9), (1, text(1), "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text(4), None, None, None), (5, text(5) + " a@b.co", "xx", "s", 1), (6, text(6), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, " ".join(text(6).split()[5:20])), (2, None)], "item_id long, text string")
    for name, documents, benchmark, want in (("some", docs, items, {(1, text(1)), (None, text(4)), (5, text(5) + " [EMAIL]")}), ("open", docs, items.limit(0), {(1, text(1)), (None, text(4)), (5, text(5) + " [EMAIL]"), (6, text(6))}), ("none", docs.limit(0), items, set())):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {(r.doc_id, r.text) for r in found} == want and len(found) == len(want)
