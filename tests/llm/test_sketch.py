"""Sketches against exact counts; components around hubs."""

import numpy as np
import pytest

from pushgraph.llm import components, sketch
from pushgraph.llm import textvec as V


@pytest.mark.parametrize("bits,distinct", [(16, 300_000), (18, 40_000), (20, 5_000)])
def test_merged_counts(spark, bits, distinct):
    """Sparse pieces and dense ones: a cell's bit is set where two keys or more fall into it, a level is the logarithm of its keys."""
    rows = spark.range(60).repartition(6)

    def keys_of(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                yield np.random.default_rng(i).integers(0, distinct, 30_000).astype(V.U)

    every = np.concatenate([np.random.default_rng(i).integers(0, distinct, 30_000).astype(V.U) for i in range(60)])
    got = np.unpackbits(np.frombuffer(sketch.repeated_bits(rows, keys_of, depth=2, bits=bits), np.uint8))
    want = sum(np.bincount(c, minlength=2 << bits) for c in sketch.cells(every, 2, bits)) > 1
    assert (got.astype(bool) == want).all()
    levels = np.frombuffer(sketch.count_levels(rows, keys_of, bits=bits), np.uint8)
    n = np.bincount(sketch.cells(every, 1, bits)[0], minlength=1 << bits)
    assert n.max() < 255 * 6 and (levels <= np.floor(np.log2(np.maximum(n, 1)))).all()
    assert (levels[n < 255] == np.floor(np.log2(np.maximum(n[n < 255], 1)))).all()


def test_a_fold_holds_one_block(spark):
    """Ten times the pieces of a block are added in the room of one block."""
    import tracemalloc

    import pyarrow as pa

    held = []
    for n in (20, 200):
        pieces = [pa.RecordBatch.from_pydict({"block": pa.array([0] * 10, pa.int32()), "cell": pa.array([np.arange(100, dtype=np.uint16).tobytes()] * 10)}) for _ in range(n)]
        seen = {}

        class Rows:
            def repartition(self, *_):
                return self

            sortWithinPartitions = repartition

            def mapInArrow(self, fold, schema):
                tracemalloc.start()
                seen["out"] = list(fold(iter(pieces)))  # noqa: B023
                seen["peak"] = tracemalloc.get_traced_memory()[1]  # noqa: B023
                tracemalloc.stop()

        def add(total, cell):
            total[np.frombuffer(cell, np.uint16)] += 1
            return total

        sketch._folded(Rows(), np.int64, add, lambda t: t.tobytes(), "level")
        total = np.frombuffer(seen["out"][0].column("level")[0].as_py(), np.int64)
        assert total[:100].tolist() == [10 * n] * 100 and not total[100:].any()
        held.append(seen["peak"])
    assert held[1] < 1.2 * held[0]


@pytest.mark.parametrize("hub_rows", [1 << 16, 100])
def test_hubs(spark, monkeypatch, hub_rows):
    """Stars whose middle is the least, the greatest or any node, linked into one chain."""
    monkeypatch.setattr(components, "HUB_ROWS", hub_rows)
    star = [(1, x) for x in range(10, 5000)] + [(9000, x) for x in range(5000, 6000)] + [(7000, x) for x in range(8000, 8200)]
    chain = [(20, 5100), (9000, 9001), (50_000, 50_001)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*star, *chain, (3, 3), (None, 4)], "u long, v long")).collect()}
    want = {x: 1 for e in [*star[:5990], (20, 5100), (9000, 9001)] for x in e} | {x: 7000 for e in star[5990:] for x in e} | {50_000: 50_000, 50_001: 50_000}
    assert got == want


def test_a_sketch_in_pieces(spark, monkeypatch):
    """What the driver takes piece by piece is what it takes at once."""
    rows = spark.range(8).repartition(2)

    def keys_of(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                yield np.random.default_rng(i).integers(0, 200_000, 30_000).astype(V.U)

    whole = sketch.repeated_bits(rows, keys_of, depth=1, bits=19)
    monkeypatch.setattr(sketch, "PIECE_BLOCKS", 3)
    assert any(whole) and sketch.repeated_bits(rows, keys_of, depth=1, bits=19) == whole


@pytest.mark.parametrize("shingles", [25_000_000, 250_000_000, 1_500_000_000])
def test_the_sketch_grows_with_the_shingles(shingles):
    """Of a set whose shingles stand alone more are proven than its prefix holds, at 0.1, 1 and 6 GB."""
    from pushgraph.llm import ngram_join

    on_a_cell = shingles / 2 / 2 ** ngram_join._sketch_bits(shingles, 28)
    assert 0.5 * np.exp(-on_a_cell) > 0.2
