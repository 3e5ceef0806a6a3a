"""Weights of pushdown transitions: a scalar product and an aggregating sum, as Column builders.

A weight column holds one value per transition. ``extend`` is applied along a path, ``combine`` over
the paths to one transition; both stay inside Catalyst (partial aggregation before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """dtype: SQL type; one: neutral of extend; extend(a, b): a then b; combine: aggregate over a column.

    idempotent: combining a weight with itself leaves it, and extend distributes over combine, so that what follows from an earlier weight is
    a part of what follows from a later one. The fixpoint loop relies on it and refuses others.
    """

    name: str
    dtype: str
    one: Callable[[], Column]
    extend: Callable[[Column, Column], Column]
    combine: Callable[[Column], Column]
    idempotent: bool = True


def _union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def _merged(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


#: Reachability only: every weight is 0.
UNWEIGHTED = Semiring("unweighted", "bigint", lambda: F.lit(0).cast("bigint"), lambda a, b: F.lit(0).cast("bigint"), F.min)

#: Shortest: sum along a path, least over paths. (110000, the conventional zero, does not annihilate.)
MIN_PLUS = Semiring("min_plus", "bigint", lambda: F.lit(0).cast("bigint"), lambda a, b: a + b, F.min)

#: Sum along a path; null where paths disagree. A disagreement absorbs, so that the sum is associative.
NUM = Semiring("num", "bigint", lambda: F.lit(0).cast("bigint"), lambda a, b: a + b, lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)))

#: Sets of names, joined along a path and over paths: methods called on an object, statements of a path.
INFERENCE = Semiring("inference", "array<string>", lambda: F.expr("cast(array() as array<string>)"), _union, _merged)
DATA_FLOW_PATH = Semiring("data_flow_path", "array<string>", lambda: F.expr("cast(array() as array<string>)"), _union, _merged)

def _then(a: Column, b: Column) -> Column:
    return F.struct(_union(a["names"], b["names"]).alias("names"), F.coalesce(b["last"], a["last"]).alias("last"))


#: Names of a path with the one that was added last: the right side's, where it has one; over paths the greatest name.
ORDERED_PATH = Semiring(
    "ordered_path",
    "struct<names:array<string>,last:string>",
    lambda: F.expr("named_struct('names', cast(array() as array<string>), 'last', cast(null as string))"),
    _then,
    lambda c: F.struct(_merged(c["names"]).alias("names"), F.max(c["last"]).alias("last")),
)

#: Sets where the empty set is one: a path keeps what its only non-empty part has, else nothing (null is zero).
SET_DOMAIN = Semiring(
    "set_domain",
    "array<string>",
    lambda: F.expr("cast(array() as array<string>)"),
    lambda a, b: F.when(F.size(a) == 0, b).when(F.size(b) == 0, a),
    lambda c: F.when(F.min(F.size(c)) == 0, F.expr("cast(array() as array<string>)")).otherwise(_merged(c)),
)

PAIRS = "array<struct<src:string,dst:string>>"
ANY = "*"


def pair(src: str, dst: str) -> Column:
    return F.struct(F.lit(src).alias("src"), F.lit(dst).alias("dst"))


def compose(a: Column, b: Column) -> Column:
    """Relation product of state changes: a, then b; the pair (*, *) is the identity on every state."""
    through = lambda x, y: F.when((x["src"] == ANY) & (x["dst"] == ANY), y).when((y["src"] == ANY) & (y["dst"] == ANY), x).when(x["dst"] == y["src"], F.struct(x["src"].alias("src"), y["dst"].alias("dst")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: through(x, y)))), lambda p: p.isNotNull())))


#: Changes of a typestate machine's state: sorted sets of (from, to); at most the square of its states.
TYPESTATE = Semiring("typestate", PAIRS, lambda: F.array(pair(ANY, ANY)), compose, _merged)

SEMIRINGS = {s.name: s for s in (UNWEIGHTED, MIN_PLUS, NUM, INFERENCE, DATA_FLOW_PATH, ORDERED_PATH, SET_DOMAIN, TYPESTATE)}
