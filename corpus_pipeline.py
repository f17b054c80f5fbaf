"""From raw documents to token ids: quality, near-duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined cases: null and empty texts have too few words and go with the first stage; of rows alike in every
column one stays, as of any near-duplicates; a null id is kept, last in the choice of a group's document; a
null language has the reference of other languages; an empty benchmark removes nothing; an empty table gives an
empty result; texts are taken whole. Further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, minhash, pii, quality
from plumbline.llm.queries import tokenizer_path, workers_find_us
from plumbline.llm.store import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each near-duplicate group."""
    return minhash.keep_first(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and text as decoded from the ids."""
    import public_tokenizers

    columns = ["doc_id", "lang", "source"]
    encoded = bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=columns)
    return encoded.select(*columns, F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_clean_of_benchmark),
    ("pii", redact_personal_data),
    ("encode", encode),
]

#: Hashing, a trained model and byte-pair merges are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    workers_find_us(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
