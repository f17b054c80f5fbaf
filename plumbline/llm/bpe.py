"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that is in the vocabulary waits in the
bucket of its merge rank, by position; a bitmap of two levels of 256-way words tells which buckets
have entries, so find-first-set yields the lowest rank in constant time. A popped entry whose pair
has changed since is stale and skipped. The work is n log n in the pre-token's length whatever its
content (the log for leftmost-first order inside a bucket), so a pre-token of a million bytes is no
special case.

Encoded pre-tokens are kept in a worker's cache of two generations of ``CACHE_ENTRIES`` entries: a
full one becomes the old one, from which what is met again comes back. That bounds memory and never
changes a result.

Defined cases: a null text is the empty text, with no tokens; texts of any length are taken whole;
repeated rows are each encoded; an empty table gives an empty result; columns other than id and
text are not read. Rank files are read once on the driver and broadcast (under 2 MB).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000
#: Longer pre-tokens aren't cached.
CACHE_LENGTH = 64


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers, one a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


BIT = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank, lowest rank first, leftmost first within a rank.

    buckets has the positions of a rank (a heap once there are two), low a bit for each rank in
    words of 256, and the local ``top`` of merge a bit for each word of low. The loops of ``merge``
    work on these directly, since a call for each push and pop would cost more than the work itself.
    pairs has the ranks of two bytes.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.low = [0] * ((max(ranks.values()) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.pairs = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Token ids of one pre-token. queue is empty before and after."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    ends = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n))  # start of the part before the one that starts here
    get, buckets, low, pairs, top = ranks.get, queue.buckets, queue.low, queue.pairs, 0
    waiting = [pairs[a][b] for a, b in zip(piece, piece[1:])]  # the rank that a start's pair has now
    waiting.append(-1)
    for i, rank in enumerate(waiting):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)  # in order, so it is a heap
            else:
                buckets[rank] = [i]
                word = rank >> 8
                top |= BIT[word]
                low[word] |= BIT[rank & 255]
    while top:
        # the lowest rank that has entries, by find-first-set
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if waiting[i] != rank:
            continue  # stale
        gone = ends[i]
        end = ends[i] = ends[gone]
        waiting[gone] = -1
        if end < n:
            before[end] = i
            waiting[i] = new = get(piece[i : ends[end]], -1)
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    word = new >> 8
                    top |= BIT[word]
                    low[word] |= BIT[new & 255]
        else:
            waiting[i] = -1
        left = before[i]
        if left >= 0 and (new := get(piece[left:end], -1)) != waiting[left]:
            waiting[left] = new
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], left)
                else:
                    buckets[new] = [left]
                    word = new >> 8
                    top |= BIT[word]
                    low[word] |= BIT[new & 255]
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Pieces(dict):
    """pre-token -> what make says of it, kept in two generations: what is met again comes back from the older one."""

    def __init__(self, make: Callable[[str], tuple]) -> None:
        super().__init__()
        self.make = make
        self.old: dict[str, tuple] = {}

    def __missing__(self, piece: str) -> tuple:
        found = self.old.pop(piece, None)
        if found is None:
            found = self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Ids of texts and texts of ids; pre-tokens are merged where they are met first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.queue = RankQueue(ranks)
        self.vocabulary = {i: token for token, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.vocabulary}
        self.ids = Pieces(self.ids_of)
        self.written = Pieces(self.written_of)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else tuple(merge(data, self.ranks, self.queue))

    def written_of(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal, and the bytes that they decode to."""
        ids = self.ids_of(piece)
        return len(ids), " ".join(map(self.decimal.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids; SHA-256 of the ids in decimal, joined by a space, and of what they decode to."""
        found = [self.written[p] for p in self.split(text)]
        ids, decoded = " ".join([x[1] for x in found]), b"".join([x[2] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def read_file(spark: SparkSession, path: str) -> bytes:
    """A small file of the driver's machine."""
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared, pattern: str) -> Encoder:
    """The worker's encoder, made once for each call on the driver."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(shared.value), pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, text: str = "text", digests: bool = False) -> DataFrame:
    """One row a document: the columns of keep (doc_id unless given), then ids array<int> and decoded binary;
    with digests, instead of these, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256."""
    keep = ["doc_id"] if keep is None else keep
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(read_file(docs.sparkSession, ranks_path))
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept)], F.col(f"`{text}`").alias("text"))
    made = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())] if digests else [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "binary", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared, pattern)
        for batch in batches:
            # small pieces, so that a batch of long documents takes little memory
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in made]
                for value in part.column(len(kept)):
                    whole = value.as_py() or ""
                    if digests:
                        out = encoder.digests(whole)
                    else:
                        ids = encoder.encode(whole)
                        out = (ids, encoder.decode(ids))
                    for column, x in zip(columns, out):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *[pa.array(c, t) for c, (_, _, t) in zip(columns, made)]], names=[*kept, *[n for n, _, _ in made]])

    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept] + [f"{n} {t}" for n, t, _ in made]
    out = rows.mapInArrow(run, ", ".join(kinds))
    return out.select(*[F.col(n).alias(c) for n, c in zip(kept, keep)], *[n for n, _, _ in made])
