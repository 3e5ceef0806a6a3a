"""Count-min sketches of 64-bit keys that tell which keys may stand in two places or more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pushgraph.llm import textvec as V
from pushgraph.session import forget, written

BLOCK = 1 << 16
#: Blocks whose bits the driver takes in one piece: 32 MB.
PIECE_BLOCKS = 1 << 12
#: Cells of a piece above which it goes as bits.
SPARSE = BLOCK // 16


def _piece(cells: np.ndarray, of: int) -> bytes:
    """The cells of a block: their numbers, or a bit for each of the block's where the piece has more than SPARSE."""
    if of <= SPARSE:
        return cells.tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[cells] = True
    return np.packbits(bits).tobytes()


def _folded(pieces: DataFrame, dtype: type, add: Callable, told: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """(block, name): all pieces (block, ..) of each block added up. Pieces come sorted by block and are read as a stream: a task holds a
    batch of them and one block's sums."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, dtype)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([told(total)], pa.binary())], ["block", name])
        for batch in batches:
            columns = [batch.column(c) for c in batch.schema.names[1:]]
            for r, block in enumerate(batch.column("block").to_pylist()):
                if block != at:
                    if at is not None:
                        yield row()
                    at, total = block, np.zeros(BLOCK, dtype)
                total = add(total, *(c[r].as_buffer() if pa.types.is_binary(c.type) else c[r].as_py() for c in columns))
        if at is not None:
            yield row()

    return pieces.repartition("block").sortWithinPartitions("block").mapInArrow(fold, f"block int, {name} binary")


def cells(keys: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The cell of each key in each of the sketch's rows, numbered through all rows."""
    return [(V.mix(keys * V._STEP[40 + d] + V.U(d)) >> V.U(64 - bits)).astype(np.int64) + (d << bits) for d in range(depth)]


def repeated_bits(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], *, depth: int, bits: int) -> bytes:
    """A bit for each cell, set where it counts 2 or more over all of keys_of's arrays.

    Every partition counts its own keys; the counts (0, 1, 2 or more) of its cells are added on the
    executors, a block of cells at a time. Between them go two bytes a key, or two bits a cell where a block of a million keys' cells
    is fuller than that; a task that adds holds one block, whatever the number of keys. The result has depth * 2**bits / 8 bytes, of
    which the driver's JVM holds PIECE_BLOCKS blocks at a time.
    """
    # Above 2**28 cells a block's part of a million keys is small beside what a row costs.
    most_held = 1_000_000 * min(4, max(1, (depth << bits) >> 28))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cell = np.concatenate([c for keys in waiting for c in cells(keys, depth, bits)])
            waiting.clear()
            cell, n = np.unique(cell, return_counts=True)
            block = cell // BLOCK
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
            low, twice = (cell % BLOCK).astype(np.uint16), n > 1
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[a]) for a, _ in parts], pa.int32()), pa.array([_piece(low[a:b], b - a) for a, b in parts], pa.binary()), pa.array([_piece(low[a:b][twice[a:b]], b - a) for a, b in parts], pa.binary()), pa.array([b - a > SPARSE for a, b in parts], pa.bool_())],
                ["block", "once", "more", "dense"],
            )

        for keys in keys_of(batches):
            waiting.append(keys)
            held += len(keys)
            if held > most_held:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    def add(total: np.ndarray, once: memoryview, more: memoryview, dense: bool) -> np.ndarray:
        for x in (once, more):
            if dense:
                total = np.minimum(total + np.unpackbits(np.frombuffer(x, np.uint8)), 2)
            else:
                cell = np.frombuffer(x, np.uint16)
                total[cell] = np.minimum(total[cell] + 1, 2)  # the cells of one piece are distinct
        return total

    pieces = rows.mapInArrow(count, "block int, once binary, more binary, dense boolean")
    merged = _folded(pieces, np.uint8, add, lambda total: np.packbits(total > 1).tobytes(), "bits")
    out, blocks = np.zeros((depth << bits) // 8, np.uint8), (depth << bits) // BLOCK
    many = blocks > PIECE_BLOCKS
    if many:
        merged = written(merged)
    for first in range(0, blocks, PIECE_BLOCKS):
        some = merged.filter(f"block >= {first} and block < {first + PIECE_BLOCKS}") if many else merged
        for r in some.collect():  # each piece in one job
            out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    if many:
        forget(merged)
    return out.tobytes()


def maybe_repeated(keys: np.ndarray, sketch: bytes, *, depth: int, bits: int) -> np.ndarray:
    """Whether each key's estimate is 2 or more; true for every key that was counted twice."""
    packed = np.frombuffer(sketch, np.uint8)
    hit = np.ones(len(keys), bool)
    for c in cells(keys, depth, bits):
        hit &= (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return hit


def count_levels(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], *, bits: int) -> bytes:
    """A byte for each of 2**bits cells: the logarithm (base 2, rounded down) of its keys' number over all arrays.

    Counts are added on the executors, a block of cells at a time; a partition's count of a cell stops at 255.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([cells(k, 1, bits)[0] for k in waiting]), return_counts=True)
            waiting.clear()
            block = cell // BLOCK
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
            low, n = (cell % BLOCK).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([int(block[a]) for a, _ in parts], pa.int32()), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in parts], pa.binary())],
                ["block", "cell", "n"],
            )

        for keys in keys_of(batches):
            waiting.append(keys)
            held += len(keys)
            if held > 1_000_000:
                yield flush()
                held = 0
        if held:
            yield flush()

    def add(total: np.ndarray, cell: memoryview, n: memoryview) -> np.ndarray:
        total[np.frombuffer(cell, np.uint16)] += np.frombuffer(n, np.uint8)
        return total

    level = lambda total: np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()
    merged = _folded(rows.mapInArrow(count, "block int, cell binary, n binary"), np.int64, add, level, "level")
    out = np.zeros(1 << bits, np.uint8)
    for r in merged.collect():  # at most the size of the result, in one job
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["level"]), np.uint8)
    return out.tobytes()


def levels_of(keys: np.ndarray, levels: bytes, bits: int) -> np.ndarray:
    """The level of each key's cell."""
    return np.frombuffer(levels, np.uint8)[cells(keys, 1, bits)[0]]
