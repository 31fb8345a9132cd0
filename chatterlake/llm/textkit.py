"""Whole-batch text work in numpy: words, their hashes and runs of words.

A batch of texts is one byte buffer with offsets (Arrow's own layout), so every
step below is a handful of array passes over the batch, never a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the polynomial hashes, and a random value for each byte.
BASE, STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
BYTE_VALUE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=U64)
#: Texts are worked on in slices of about this many bytes (a longer text alone).
SLICE_BYTES = 2 << 20

_powers: dict[int, np.ndarray] = {}


def inverse(odd: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2^64."""
    return U64(pow(int(odd), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and grown between batches."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that all 64 bits depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each (one row at least)."""
    offsets = text_buffer(texts)[1]
    row, n = 0, len(texts)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if big else np.int32
    offsets = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the place of each text's first word (n + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end]; equal runs have equal hashes wherever they stand."""
    if not len(values):
        return np.zeros(len(starts), U64)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts]
    return mix(out ^ ((ends - starts).astype(U64) * STEP))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(BYTE_VALUE[raw], starts, ends, BASE)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words, and each one's text; a shorter text that has words is one run."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), runs)
    before = np.concatenate([[0], np.cumsum(runs)])
    starts = first[:-1][owner] + (np.arange(before[-1]) - before[:-1][owner])
    ends = np.minimum(starts + width, first[1:][owner])
    return span_hashes(words, starts, ends, STEP), owner


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each owner, their owners, and the places where an owner's begin."""
    if not len(values):
        return values, owner, np.zeros(0, np.int64)
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return values, owner, begin
