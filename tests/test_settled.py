"""What a query joins to its solution is not left to the session's broadcast threshold."""

import pytest

from pushgraph.plans import queries as Q

SOLVED = "f1_points_to d24_backward_points_to f2_may_alias d20_heap_edges d18_points_of_indirection d27_call_graph e3_typestate_weights k1_to_k18_typestate_verdicts c5_calls_points_to d25_contexts_of_each_call"


def test_rows_are_joined_without_broadcasts(spark):
    seen, name = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)

    def rows(spark, sf):
        out = spark.range(50).join(spark.range(20), "id")
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    out = Q.settled(rows)(spark, "x")
    assert "Broadcast" not in seen[0] and "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20 and spark.conf.get(name) == before


@pytest.mark.parametrize("name", SOLVED.split())
def test_solved_queries_are_settled(name):
    assert Q.QUERIES[name].__wrapped__
