"""Words and their hashes as numpy arrays, over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once; a longer text is taken alone.
PIECE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first n powers of the multiplier (or of its inverse) modulo 2**64."""
    have = _powers[sign]
    if len(have) < n:
        size = max(n, 2 * len(have), PIECE_BYTES + 1024)
        steps = np.full(size, _MULTIPLIER if sign > 0 else _INVERSE, np.uint64)
        steps[0] = 1
        have = _powers[sign] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): rows in pieces of about PIECE_BYTES. Null rows are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:  # a null's slot may hold bytes
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        if (sizes != np.diff(offsets)).any():
            held = np.concatenate([held[offsets[i] : offsets[i] + k] for i, k in enumerate(sizes)])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        yield at, end, held[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_table(words: str) -> np.ndarray:
    """A table by byte: whether it belongs to a word. words: 'alnum' (0-9, a-z, beyond ASCII) or 'space' (all but white space)."""
    table = np.zeros(256, bool)
    table[128:] = True
    if words == "alnum":
        for a, b in (("0", "9"), ("a", "z")):
            table[ord(a) : ord(b) + 1] = True
    else:
        table[:] = True
        table[[32, *range(9, 14)]] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of the word, first word of each text and their number at last). data is as hashed: lower it first if case doesn't count."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:]
    start = np.flatnonzero(begins)
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    end = np.flatnonzero(ends)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(n + 1, -1)[start] + (end - start).astype(np.uint64))
    return start, end, hashes, np.searchsorted(start, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words from each word on that has k - 1 after it, whatever text they are of."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
