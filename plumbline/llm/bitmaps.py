"""Sets of 64-bit hashes as bitmaps of one fixed size: 8 MB, whatever the input.

A bitmap may say yes for a hash that isn't in the set, never no for one that is. It is read by every
task, so its size is proven; what is right never hangs on it, only how much work is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
#: Hashes that a task holds before it hands a sorted block on, and about so many does one task count.
HELD = PART = 2_000_000


def bitmap(hashes: DataFrame, column: str = "h") -> Broadcast[np.ndarray]:
    """The bitmap of a column of hashes, merged by words of 64 bits, as a broadcast."""
    bits = hashes.select(F.shiftrightunsigned(F.col(column), 64 - BITS).alias("bit"))
    words = bits.select(F.shiftright("bit", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2 ** 20 rows at most
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def may_have(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set."""
    at = hashes >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def frequent(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int) -> Broadcast[np.ndarray]:
    """The bitmap of hashes that occur least times or more over all rows; rows have a column ``text``.

    A task sorts its hashes and deals them out in ranges, as blocks of four bytes a hash, which compress; a range's
    blocks are counted together. Ranges are as many as the texts' bytes ask for, so that each fits a task.
    """
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = 1 << max(8, int(total / 6 / PART).bit_length())
    bits = parts.bit_length() - 1

    def blocks(held: np.ndarray) -> pa.RecordBatch:
        held.sort()
        if len(held) > least:  # what a block says least times is frequent whatever the others say
            held = held[np.concatenate([np.ones(least, bool), held[least:] != held[:-least]])]
        cut = np.searchsorted(held, np.arange(parts, dtype=np.uint64) << np.uint64(64 - bits))
        low = ((held << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        ends = np.append(cut[1:], len(held))
        some = np.flatnonzero(ends > cut)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_packed(low[cut[i] : ends[i]]) for i in some], pa.binary())], names=["part", "block"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for some in hashes(batch):
                held.append(some)
                n += len(some)
                if n > HELD:
                    yield blocks(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield blocks(np.concatenate(held))

    def count(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py())
        low = np.sort(np.concatenate([_unpacked(b) for b in table.column("block").to_pylist()]))
        later = low[least - 1 :]
        often = np.unique(later[later == low[: len(later)]])
        h = (part << np.uint64(64 - bits)) | (often.astype(np.uint64) << np.uint64(32 - bits))
        return pa.table([pa.array(h.view(np.int64))], ["h"])

    return bitmap(rows.mapInArrow(sort, "part int, block binary").groupBy("part").applyInArrow(count, "h long"))


def _packed(ascending: np.ndarray) -> bytes:
    """Steps between sorted numbers, first all lowest bytes, then the next: the high ones are nearly all zero and compress."""
    return np.diff(ascending, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(block: bytes) -> np.ndarray:
    steps = np.frombuffer(block, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)
