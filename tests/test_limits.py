"""Loops end at their fixpoint, however long the chains; a budget that cuts one is an error, not a smaller result."""

import pytest
from pyspark.sql import functions as F

from pushgraph.operators import closure as C
from pushgraph.operators.sync import synchronised
from pushgraph.plans.fixpoint import fixpoint

EDGE, NODE = "qid long, src string, dst string", "qid long, node string"


def test_long_chain(spark):
    n = 205
    e, start = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(n)], EDGE), spark.createDataFrame([(1, "0")], NODE)
    assert {(r["node"], r["depth"]) for r in C.depths(e, start).collect()} == {(str(i), i) for i in range(n + 1)}


def test_budget_is_an_error(spark):
    e, start = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(6)], EDGE), spark.createDataFrame([(1, "0")], NODE)
    for cut in (lambda: C.reachable(e, start, max_rounds=3), lambda: C.depths(e, start, max_rounds=3), lambda: C.transitive_closure(e, doubling=False, max_rounds=2)):
        with pytest.raises(RuntimeError):
            cut()
    step = lambda total, delta: delta.limit(0)
    none = fixpoint(start, step, keys=["qid", "node"], max_rounds=0)
    assert none.timed_out and none.rounds == 0


def test_longest_ends_on_a_cycle(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "b"), (2, "b", "c")], EDGE)
    assert {tuple(r)[1:] for r in C.depths(e, spark.createDataFrame([(2, "a")], NODE), longest=True).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        C.depths(e, spark.createDataFrame([(1, "a")], NODE), longest=True)


def test_synchronised_budget(spark):
    seeds = spark.createDataFrame([(1, "s0", "x")], "qid long, stmt string, val string")
    flows = spark.createDataFrame([(1, "normal", f"s{i}", "x", "", f"s{i + 1}", "x") for i in range(5)], "qid long, kind string, stmt string, val string, sym string, to_stmt string, to_val string")
    assert {r["stmt"] for r in synchronised(seeds, flows)[0].collect()} == {f"s{i}" for i in range(6)}
    with pytest.raises(RuntimeError):
        synchronised(seeds, flows, max_rounds=2)


def test_rounds_send_nothing_to_the_driver(spark):
    """Within the loop no join is turned into a broadcast, however small its side; the session's threshold is back after it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, plans = spark.conf.get(name), []

    def step(total, delta):
        out = delta.join(edges, "at").select(F.col("to").alias("at"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    edges = spark.createDataFrame([(1, 2), (2, 3)], "at int, to int")
    assert fixpoint(spark.createDataFrame([(1,)], "at int"), step, keys=["at"]).whole().count() == 3
    assert plans and not any("Broadcast" in p for p in plans)
    assert spark.conf.get(name) == before
