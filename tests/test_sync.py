"""Synchronised pushdown systems: the literal vectors, all in one batch."""

from pushgraph.operators.sync import Budget, synchronised
from tests import fixtures


def test_vectors(spark):
    cases = fixtures.synchronised()
    assert len(cases) == 35
    seeds = spark.createDataFrame([(q, *c[1]) for q, c in enumerate(cases)], "qid long, stmt string, val string")
    flows = spark.createDataFrame([(q, *f) for q, c in enumerate(cases) for f in c[2]], "qid long, kind string, stmt string, val string, sym string, to_stmt string, to_val string")
    reached, _, _ = synchronised(seeds, flows)
    got = {tuple(r) for r in reached.collect()}
    for q, (name, _, _, yes, no) in enumerate(cases):
        for n in yes:
            assert (q, *n) in got, (name, n)
        for n in no:
            assert (q, *n) not in got, (name, n)


def test_budget_of_each_query(spark):
    """One long query ends by its budget, the small ones beside it are whole."""
    rows = [(q, "normal", f"s{i}", "x", "", f"s{i + 1}", "x") for q, n in ((1, 2), (2, 12), (3, 3)) for i in range(n)]
    flows = spark.createDataFrame(rows, "qid long, kind string, stmt string, val string, sym string, to_stmt string, to_val string")
    seeds = spark.createDataFrame([(q, "s0", "x") for q in (1, 2, 3)], "qid long, stmt string, val string")
    for budget in (Budget(rounds=3), Budget(rows=7)):
        told = {}
        reached, _, _ = synchronised(seeds, flows, budget=budget, listen=lambda name, rows: told.update({name: rows}))  # noqa: B023
        n = {r["qid"]: r["count"] for r in reached.groupBy("qid").count().collect()}
        assert (n[1], n[3]) == (3, 4) and 4 <= n[2] < 13
        assert [r["qid"] for r in told["exhausted"].collect()] == [2]
