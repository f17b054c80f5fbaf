"""Benchmark decontamination by winnowing.

Texts become words (A-Z lowered; runs of digits, letters a-z and anything beyond ASCII). The
fingerprints of a text are the least of each ``window - k + 1`` consecutive hashes of k words, so any
shared span of ``window`` words has a common fingerprint, found by joining those of documents with
those of the benchmark. Around every hit the match is extended: each run of ``window`` words that
covers the hit is held against the benchmark's own runs, word by word, and the runs found are
united. An item shorter than a window is one window by itself, found by the hashes of as many words.

The benchmark side is broadcast in blocks of proven size: its words are counted first, and items are
dealt to as many blocks as keep each, as built, under ``BLOCK_BYTES`` (on average, and a single item is never cut). Documents
pass by ``BLOCKS`` blocks in one stage; where there are more, what has been found is written and the next
blocks follow, so that neither the driver nor a worker ever holds more. Documents are never shuffled.

Defined cases: null texts have no words, are clean and, as items, match nothing; items without words
match nothing; a null item_id counts as "null"; repeated items of one id count once; repeated
documents are each judged; an empty table of either kind gives all clean or no rows. Hits never
cross documents. Other columns are not read by ``find`` and kept as they are by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize
from .wordarrays import LOWER, grams, pieces, window_minimum, word_table, words_of

BLOCK_BYTES = 32 << 20
#: Blocks of one stage.
BLOCKS = 4
#: Of a built block: a word's hash, and the key, place and item of the run that begins with it.
BYTES_A_WORD = 32


@dataclass(frozen=True)
class WinnowRules:
    """Words of a window, and of the hashed k-grams."""

    window: int = 10
    k: int = 5


class Benchmark:
    """One block: the hashes of all words, sorted fingerprints, and sorted hashes of all runs with their places and items."""

    def __init__(self, items: list[tuple[str, str]], rules: WinnowRules) -> None:
        self.rules = rules
        texts = pa.array([t for _, t in items], pa.large_string())
        words: list[np.ndarray] = [np.empty(0, np.uint64)]
        runs: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        prints = []
        base = 0
        for first, _, data, offsets in pieces(texts):
            _, _, hashes, bounds = words_of(LOWER[data], offsets, word_table("alnum"))
            words.append(hashes)
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                size = min(b - a, rules.window)
                if not size:
                    continue
                own = hashes[a:b]
                n = b - a - size + 1
                runs.setdefault(size, []).append((grams(own, size), np.arange(base + a, base + a + n, dtype=np.int32), np.full(n, first + i, np.int32)))
                if size == rules.window:
                    prints.append(window_minimum(grams(own, rules.k), rules.window - rules.k + 1))
            base += len(hashes)
        self.words = np.concatenate(words)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.ids = [i for i, _ in items]
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in runs.items():
            keys, place, owner = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((owner, keys))
            self.runs[size] = keys[order], place[order], owner[order]

    def nbytes(self) -> int:
        """Bytes of the arrays and ids."""
        return self.words.nbytes + self.prints.nbytes + sum(a.nbytes for r in self.runs.values() for a in r) + sum(map(len, self.ids))

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words of matching runs, index of the first entry of an equal run), over words of many texts."""
        out = []
        last = np.repeat(bounds[1:], np.diff(bounds))  # end of the text that a word is of
        k, window = self.rules.k, self.rules.window
        for size, (keys, place, _) in self.runs.items():
            if len(hashes) < size:
                continue
            if size == window:
                starts = self._near(hashes, k, window)
            else:
                starts = np.arange(len(hashes) - size + 1)
            starts = starts[starts + size <= last[starts]]
            found = grams(hashes, size)[starts]
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            same = keys[at] == found
            starts, at = starts[same], at[same]
            same = (hashes[starts[:, None] + np.arange(size)] == self.words[place[at][:, None] + np.arange(size)]).all(axis=1)
            if same.any():
                out.append((size, starts[same], at[same]))
        return out

    def owners(self, size: int, at: int) -> list[str]:
        """Ids of the items that have the run of that entry."""
        keys, _, owner = self.runs[size]
        return [self.ids[o] for o in owner[at : np.searchsorted(keys, keys[at], "right")]]

    def _near(self, hashes: np.ndarray, k: int, window: int) -> np.ndarray:
        """Starts of the windows that cover a k-gram whose fingerprint the block has, if it is theirs."""
        kgrams = grams(hashes, k)
        least = window_minimum(kgrams, window - k + 1)
        at = np.minimum(np.searchsorted(self.prints, least), len(self.prints) - 1)
        return np.flatnonzero(self.prints[at] == least)


def _items(items: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """(i, t) of items with a text, and how many blocks they make."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    words = F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = rows.agg(F.coalesce(F.sum(words * BYTES_A_WORD + F.octet_length("i")), F.lit(0))).first()[0]
    return rows, max(1, -(-size // BLOCK_BYTES))


def _attach(docs: DataFrame, items: DataFrame, rules: WinnowRules, text: str, item_id: str, item_text: str, keep: list[str]) -> DataFrame:
    """The columns of keep as c0, c1 .., then ``__n`` words, ``__spans`` hit runs of words [start, end), ``__items`` ids."""
    sc = docs.sparkSession.sparkContext
    made = "array<struct<start:int,end:int>>"
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("string").alias("__t"), F.lit(0).cast("long").alias("__n"), F.array().cast(made).alias("__spans"), F.array().cast("array<string>").alias("__items"))
    parts, n_blocks = _items(items, item_id, item_text)
    own = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    passed = None
    for b in range(n_blocks):
        if b and b % BLOCKS == 0:
            after, path = materialize(rows, "passed")
            for shared in held:
                shared.destroy()
            if passed:
                discard(docs.sparkSession, passed)
            rows, passed = after, path
        if b % BLOCKS == 0:
            held = []
        block = sc.broadcast(Benchmark([tuple(r) for r in parts.where(own == b).collect()], rules))
        held.append(block)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _run(block.value, batch)

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*names, "__n", "__spans", "__items")


def _run(block: Benchmark, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    table = word_table("alnum")
    where = {name: i for i, name in enumerate(batch.schema.names)}
    for first, end, data, offsets in pieces(batch.column(where["__t"])):
        part = batch.slice(first, end - first)
        _, _, hashes, bounds = words_of(LOWER[data], offsets, table)
        marks = np.zeros(len(hashes) + 1, np.int32)
        owners: dict[int, set[str]] = {}
        for size, starts, at in block.hits(hashes, bounds):
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + size, -1)
            doc = np.searchsorted(bounds, starts, "right") - 1
            for d, a in np.unique(np.stack([doc, at]), axis=1).T:
                owners.setdefault(int(d), set()).update(block.owners(size, a))
        hit = np.cumsum(marks[:-1]) > 0
        spans, ids = part.column(where["__spans"]).to_pylist(), part.column(where["__items"]).to_pylist()
        for d, found in owners.items():
            a, b = bounds[d], bounds[d + 1]
            own = hit[a:b].copy()
            for s in spans[d]:
                own[s["start"] : s["end"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])]
            ids[d] = sorted(found.union(ids[d]))
        new = {"__n": np.diff(bounds), "__spans": spans, "__items": ids}
        columns = [pa.array(new[f.name], f.type) if f.name in new else part.column(i) for i, f in enumerate(batch.schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def find(docs: DataFrame, items: DataFrame, rules: WinnowRules = WinnowRules(), id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_hit (words in spans), spans (of words), items (ids as strings, sorted)."""
    rows = _attach(docs, items, rules, text, item_id, item_text, [id_col])
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(F.col("c0").alias(id_col), F.col("__n").alias("n_words"), n_hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def remove(docs: DataFrame, items: DataFrame, rules: WinnowRules = WinnowRules(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    rows = _attach(docs, items, rules, text, item_id, item_text, docs.columns)
    return rows.where(F.size("__items") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
