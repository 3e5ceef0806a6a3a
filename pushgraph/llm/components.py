"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pushgraph.session import forget, written

#: A node with more edges than HUB_ROWS, and more than one in HUB of all, is joined by broadcast.
HUB, HUB_ROWS = 4096, 1 << 16


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges, written, with their number and a hash of them all, which are told while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) -> (node, component): component is the least node that is reachable; nodes of edges only.

    Nulls and loops are ignored, repeated edges count once. Each round is two joins on a node with
    its least neighbour, which is aggregated before the shuffle; no neighbourhood is collected, nor does that of a hub meet in one task. The
    number of rounds is about the logarithm of the longest path.
    """

    def met(rows: DataFrame, n: int, hubs: bool, least: Column) -> DataFrame:
        """rows (u, v) with m, the least v of their u."""
        found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), least.alias("m"), "n")
        if not hubs:
            return rows.join(found.drop("n"), F.col("u") == F.col("k"))
        hot = (F.col("n") > HUB_ROWS) & (F.col("n") * HUB > n)
        told = F.broadcast(found.filter(hot).select("k", "m"))  # HUB rows at most
        others = rows.join(told, F.col("u") == F.col("k"), "left_anti").join(found.filter(~hot).drop("n"), F.col("u") == F.col("k"))
        return rows.join(told, F.col("u") == F.col("k")).unionByName(others)

    now, state = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct())
    for _ in range(max_rounds):
        if not state[0]:
            break
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Neither step below gives a node more edges than it has here.
        hubs = state[0] > HUB_ROWS and sym.groupBy("u").count().agg(F.max("count")).first()[0] > HUB_ROWS
        large = met(sym, 2 * state[0], hubs, F.least("u", "m")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = met(down, state[0], hubs, F.col("m")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before = now
        now, new = _written(small.filter(F.col("u") != F.col("v")).distinct())
        forget(before)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
