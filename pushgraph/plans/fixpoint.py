"""The semi-naive loop that every recursive operator runs on.

A relation has key columns and perhaps one weight column. Each round derives candidates from the last
round's changes; what is new, or has a new merged weight, is the next round's change. Rounds are cut off
from each other by tables in the shared checkpoint folder, so plans stay flat and a lost executor costs a
round's task at most. All queries of a batch (``qid``) run in the same rounds.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.semiring import Semiring
from pushgraph.session import forget, shuffled, together, written, written_counted

COMPACT = 4


@dataclass
class Relation:
    """total: all rows; delta: those that the last round added or changed."""

    total: DataFrame
    delta: DataFrame
    rounds: int = 0
    timed_out: bool = False

    def whole(self) -> DataFrame:
        """total, where the loop ended by itself; an error where a budget ended it."""
        if self.timed_out:
            raise RuntimeError(f"no fixpoint after {self.rounds} rounds: the budget is used up and rows are missing")
        return self.total


class Growing:
    """A set of rows that only grows, or a weighted one whose weights are merged.

    It is kept as a few tables: what was there and what each round added. A weighted one holds a key's earlier weights beside
    its last until they are merged, which costs nothing but their room: what follows from an earlier weight is a part of what
    follows from the last. Nothing but the rows of a round is written in it; every COMPACT rounds the tables become one.
    """

    def __init__(self, start: DataFrame, keys: list[str], weight: str | None = None, semiring: Semiring | None = None) -> None:
        if semiring is not None and not semiring.idempotent:
            raise ValueError(f"weights of {semiring.name} change when they are combined with themselves: no fixpoint is told by them")
        self.keys, self.weight, self.semiring = keys, weight, semiring
        self.delta = written(self._merged(start))
        self.total, self.grown = self.delta, 0
        self._parts, self._loose = [self.delta], []

    def _merged(self, rows: DataFrame) -> DataFrame:
        if self.weight is None:
            return rows.select(*self.keys).distinct()
        return rows.groupBy(*self.keys).agg(self.semiring.combine(F.col(self.weight)).alias(self.weight))

    def _changed(self, candidates: DataFrame) -> DataFrame:
        """Rows that candidates add, or whose weight they change."""
        fresh = self._merged(candidates)
        if self.weight is None:
            return fresh.join(self.total, self.keys, "left_anti")
        # Both sides are dealt by key once, and what is merged after it stays where it is.
        w = self.weight
        old = self.total.groupBy(*self.keys).agg(self.semiring.combine(F.col(w)).alias("_was")).withColumn("_old", F.lit(True))
        met = fresh.join(old, self.keys, "left")
        both = F.when(F.col("_old"), F.array("_was", w)).otherwise(F.array(w))
        merged = met.select(*self.keys, "_was", "_old", F.explode(both).alias(w)).groupBy(*self.keys).agg(self.semiring.combine(F.col(w)).alias("_new"), F.first("_was").alias("_was"), F.first("_old").alias("_old"))
        return merged.filter(F.col("_old").isNull() | ~F.col("_new").eqNullSafe(F.col("_was"))).select(*self.keys, F.col("_new").alias(w))

    def lacking(self, candidates: DataFrame) -> tuple[DataFrame, int]:
        """What candidates would change, and its number of rows: written, but not added yet."""
        return written_counted(self._changed(candidates))

    def grow(self, candidates: DataFrame) -> bool:
        """Adds the candidates; whether anything changed. The next delta is what did."""
        return self.add(*self.lacking(candidates))

    def add(self, delta: DataFrame, n: int) -> bool:
        """Adds what lacking() has told; what was read to make it may be deleted."""
        self.delta, self.grown = delta, n
        forget(*self._loose)
        self._loose = []
        if not n:
            self._loose = [self.delta]
            return False
        self._parts.append(self.delta)
        if len(self._parts) > COMPACT:
            before = self._parts[:-1]  # the delta stays by itself
            self._parts = [written(self._merged(together(before))), self.delta]
            forget(*before[:-1])
            self._loose = [before[-1]]  # the last delta may still be read
        self.total = together(self._parts)
        return True

    def marked(self) -> DataFrame:
        """total with ``fresh``: whether the row is of the last delta."""
        old = together(self._parts[:-1]) if len(self._parts) > 1 else self.delta.limit(0)
        return old.withColumn("fresh", F.lit(False)).unionByName(self.delta.withColumn("fresh", F.lit(True)))

    def relation(self, rounds: int, timed_out: bool) -> Relation:
        total = self.total if self.weight is None or len(self._parts) == 1 else self._merged(self.total)
        return Relation(total, self.delta, rounds, timed_out)


@shuffled
def fixpoint(
    start: DataFrame,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    keys: list[str],
    weight: str | None = None,
    semiring: Semiring | None = None,
    max_rounds: int | None = None,
    budget_seconds: float | None = None,
) -> Relation:
    """Least fixpoint of ``step(total, delta)`` above start.

    It runs until nothing changes, which steps that make finitely many rows or weights come to. max_rounds and
    budget_seconds give up before, with the partial relation, marked timed_out; both are checked between rounds.
    """
    state, began = Growing(start, keys, weight, semiring), time.monotonic()
    if max_rounds is not None and max_rounds < 1:
        return state.relation(0, True)
    for n in itertools.count(1):
        if not state.grow(step(state.total, state.delta)):
            return state.relation(n, False)
        if n == max_rounds or (budget_seconds is not None and time.monotonic() - began > budget_seconds):
            return state.relation(n, True)
