"""CRC-32 of many words and word runs at once.

A checksum is linear: that of two strings joined is the first one's, moved on by the second's length, xor the second's. So a run's
checksum comes from its words' by table look-ups, and no run is ever written out.
"""

from __future__ import annotations

import zlib

import numpy as np

TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    TABLE = np.where(TABLE & 1, np.uint32(0xEDB88320) ^ (TABLE >> 1), TABLE >> 1)  # the polynomial of CRC-32, reflected
#: Words up to SHORT bytes are moved on by a table of their length, longer ones by the bits of it.
SHORT = 64
ONES = np.uint32(0xFFFFFFFF)


def _zero(c: np.ndarray) -> np.ndarray:
    """A checksum's register after one more zero byte."""
    return TABLE[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """(by length up to SHORT, by powers of two): images of each byte of a register, four tables of 256 a length."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    short = [unit]
    for _ in range(SHORT):
        short.append(_zero(short[-1]))
    power = [short[1]]
    for _ in range(31):
        power.append(_apply(power[-1][None], np.zeros(4 * 256, np.intp), power[-1].ravel()).reshape(4, 256))
    return np.stack(short), np.stack(power)


def _apply(tables: np.ndarray, which: np.ndarray, c: np.ndarray) -> np.ndarray:
    flat, base = tables.reshape(-1), which * 1024
    out = flat[base + (c & np.uint32(0xFF))]
    for b in range(1, 4):
        out = out ^ flat[base + 256 * b + ((c >> np.uint32(8 * b)) & np.uint32(0xFF))]
    return out


MOVE, POWER = _moves()


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums moved on by length bytes each."""
    out = _apply(MOVE, np.minimum(length, SHORT), crc)
    for i in np.flatnonzero(length > SHORT):
        c, n, bit = crc[i : i + 1], int(length[i]), 0
        while n >> bit:
            if n >> bit & 1:
                c = _apply(POWER, np.array([bit]), c)
            bit += 1
        out[i] = c[0]
    return out


def spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums with a space behind."""
    c = crc ^ ONES
    return TABLE[(c ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (c >> np.uint32(8)) ^ ONES


def of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksum of each range of bytes: all of them a byte further at a time, the longest first."""
    size = ends - starts
    order = np.argsort(SHORT + 1 - np.minimum(size, SHORT + 1).astype(np.int16), kind="stable")
    short = np.minimum(size[order], SHORT + 1)
    at = starts[order]
    crc = np.full(len(at), ONES, np.uint32)
    for k in range(int(short[0]) if len(short) else 0):
        if k >= SHORT:
            break
        m = len(short) - int(np.searchsorted(short[::-1], k, "right"))
        crc[:m] = TABLE[(crc[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (crc[:m] >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[order] = crc ^ ONES
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out
