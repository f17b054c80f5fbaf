"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a broadcast table of the lengths of frequent pre-tokens: keys joined in one buffer, one
byte a length, ``TABLE_ENTRIES`` entries of at most ``KEY_LENGTH`` characters, so under 10 MB. It comes from
all documents: every task keeps a summary of ``SUMMARY`` counters of its rows (when it is full, the
rarer half goes), sends its ``SENT`` most frequent, and these are added up. So what is frequent anywhere is
known whatever the size, and what is shuffled is bounded by task. The table saves work and never changes a count. Tier two is
each worker's cache of what it has encoded itself. Misses are encoded by the tokenizer library, a
batch of distinct ones at a time.

Special strings of the file (its added tokens) inside a text count as one token, as the library
does by default. Only byte-level pre-tokenization without a normalizer is supported; other files
raise ValueError.

Defined cases: a null text is the empty text: 0 bytes, 0 tokens; repeated rows are each counted; an
empty table gives an empty result; texts are taken whole. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_file

TABLE_ENTRIES = 65_536
SUMMARY = 50_000
SENT = 8_192
KEY_LENGTH = 48
CACHE_ENTRIES = 500_000
#: How byte-level pre-tokenization splits a text (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def check_kind(spec: dict) -> None:
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("only byte-level pre-tokenization without a normalizer is supported")


class PieceCounter(dict):
    """pre-token -> tokens: the frequent table, then what this worker has met."""

    def __init__(self, spec: str, frequent: tuple[str, bytes]) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        loaded = json.loads(spec)
        check_kind(loaded)
        special = sorted((t["content"] for t in loaded["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_str(spec)
        self.split = regex.compile(BYTE_LEVEL).findall
        keys, lengths = frequent
        self.frequent = dict(zip(keys.split("\0"), lengths)) if lengths else {}
        self.update(self.frequent)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings between them."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        new = {p for pieces, _ in split for p in pieces if p not in self}
        long = {}
        if new:
            if len(self) + len(new) > CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
                new = {p for pieces, _ in split for p in pieces if p not in self}
            asked = list(new)
            for piece, found in zip(asked, self.library.encode_batch_fast(asked, add_special_tokens=False)):
                self[piece] = len(found)
                if len(piece) > 4 * KEY_LENGTH:
                    long[piece] = None
        of = self.__getitem__
        counts = [sum(map(of, pieces)) + special for pieces, special in split]
        for piece in long:
            del self[piece]
        return counts


_counters: dict[str, PieceCounter] = {}


def _counter(key: str, spec, frequent) -> PieceCounter:
    """The worker's counter, made once for each call on the driver."""
    if key not in _counters:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _counters.clear()
        _counters[key] = PieceCounter(spec.value, frequent.value)
    return _counters[key]


def frequent_table(docs: DataFrame, text: str = "text", summary: int = SUMMARY, sent: int = SENT) -> list[str]:
    """The most frequent pre-tokens of all texts, by bounded summaries of each task."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(BYTE_LEVEL).findall
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(split(value.as_py() or ""))
                if len(seen) > summary:
                    seen = Counter(dict(seen.most_common(summary // 2)))
        most = [(p, n) for p, n in seen.most_common(sent) if len(p) <= KEY_LENGTH and "\0" not in p]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in most], pa.string()), pa.array([n for _, n in most], pa.int64())], names=["piece", "n"])

    counted = rows.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in counted.where("n > 1").orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id_col, n_bytes (UTF-8), n_tokens."""
    sc = docs.sparkSession.sparkContext
    spec = read_file(docs.sparkSession, tokenizer_path).decode()
    common = frequent_table(docs, text)
    measured = PieceCounter(spec, ("", b""))
    lengths = [(p, n) for p in common for n in measured.count([p]) if 0 < n < 256]
    key, shared = uuid.uuid4().hex, sc.broadcast(spec)
    table = sc.broadcast(("\0".join(p for p, _ in lengths), bytes(n for _, n in lengths)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, shared, table)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [v.as_py() or "" for v in part.column(1)]
                n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(counter.count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
