"""Facts that arrive over time: edges appended by a stream extend a closure without starting anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.plans.fixpoint import Growing
from pushgraph.session import written

PAIR = ["qid", "src", "dst"]


class IncrementalClosure:
    """Transitive closure of (qid, src, dst) edges that only ever grow.

    add() joins the new edges with the closure so far on both sides, to a fixpoint; listeners get each batch's new
    pairs, and when they register, all pairs that are there already.
    """

    def __init__(self) -> None:
        self.pairs: DataFrame | None = None
        self.listeners: list[Callable[[DataFrame], None]] = []

    def listen(self, callback: Callable[[DataFrame], None]) -> None:
        self.listeners.append(callback)
        if self.pairs is not None:
            callback(self.pairs)

    def add(self, edges: DataFrame) -> None:
        new = edges.select(*PAIR).distinct()
        if self.pairs is None:
            state, known = Growing(new, PAIR), None
        else:
            known = self.pairs
            state = Growing(known, PAIR)
            if not state.grow(new):
                return
        while state.grow(self._pairs(state.delta, state.total).unionByName(self._pairs(state.total, state.delta))):
            pass
        self.pairs = written(state.total)
        fresh = self.pairs if known is None else self.pairs.join(known, PAIR, "left_anti")
        for callback in self.listeners:
            callback(fresh)

    @staticmethod
    def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(F.col("qid").alias("r_qid"), F.col("src").alias("r_src"), F.col("dst").alias("r_dst"))
        return left.join(r, (F.col("qid") == F.col("r_qid")) & (F.col("dst") == F.col("r_src"))).select("qid", "src", F.col("r_dst").alias("dst"))

    def attach(self, stream: DataFrame, checkpoint: str):
        """Starts a query that feeds every micro-batch of a streaming edge table to add()."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: self.add(batch)).start()
