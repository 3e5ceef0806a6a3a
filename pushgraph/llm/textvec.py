"""Words, shingles and windows of Arrow string batches as numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+``, found in the UTF-8 bytes (white space is ASCII there). Memory is
bounded: bytes are hashed in pieces of about PIECE bytes, whatever the batch or text size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U, endpoint=False)
_STEP = _rng.integers(0, 2**64, 64, dtype=U, endpoint=False) | U(1)
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place where h is writeable)."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): ranges of the bytes marked inside, none across texts, and the first of each text (n + 1)."""
    n = len(inside)
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and the first word of each text (n + 1)."""
    return spans(~SPACE[data], offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word, from sums of byte codes times powers over PIECE bytes at a time."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        part = data[a:b]
        size = b - a
        powers = np.cumprod(np.full(size, _R, U)) if size > PIECE else _POW[:size]
        sums = np.empty(size + 1, U)
        sums[0] = 0
        np.cumsum(_BYTE[LOWER[part] if lower else part] * powers, out=sums[1:])
        lo = starts[i:j] - a
        inverse = np.cumprod(np.full(size, _R_INV, U)) if size > PIECE else _INV[:size]
        h = (sums[ends[i:j] - a] - sums[lo]) * inverse[lo]
        out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(U))
        i = j
    return out


_POW = np.cumprod(np.full(PIECE, _R, U))
_INV = np.cumprod(np.full(PIECE, _R_INV, U))


def runs(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive values (len - k + 1, at least 0)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, seed, U)
    for j in range(k):
        out += hashes[j : j + n] * _STEP[(j + 7 * seed) % 64]
    return mix(out)


def doc_pieces(batch: pa.RecordBatch, text_col: str, most: int = 4 * PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes; one long text alone."""
    data, offsets = batch_bytes(batch.column(text_col))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
