"""Weighted relations: what a round changes is told by dealing its candidates and what is there by key, once."""

from pushgraph.functions import semiring as S
from pushgraph.plans.fixpoint import Growing


def test_weighted_round_deals_both_sides_once(spark):
    rows = lambda *r: spark.createDataFrame(r, "k long, w long")
    g = Growing(rows((1, 5), (2, 5), (3, 5)), ["k"], "w", S.MIN_PLUS)
    plan = g._changed(rows((1, 4)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    for new, changed in ([(1, 4), (1, 7), (2, 6), (4, 1)], {(1, 4), (4, 1)}), ([(1, 5), (1, 3), (3, 5)], {(1, 3)}):
        assert g.grow(rows(*new))
        assert {tuple(r) for r in g.delta.collect()} == changed
    assert not g.grow(rows((1, 3), (2, 9), (4, 1)))
    assert {tuple(r) for r in g.relation(2, False).total.collect()} == {(1, 3), (2, 5), (3, 5), (4, 1)}


def test_null_weights_absorb(spark):
    """Weights of num that disagree become null once; null is a weight, not the lack of one."""
    rows = lambda *r: spark.createDataFrame(r, "k long, w long")
    g = Growing(rows((1, 5), (2, 5), (3, None)), ["k"], "w", S.NUM)
    assert g.grow(rows((1, 6), (2, 5), (3, 7), (4, None)))
    assert {tuple(r) for r in g.delta.collect()} == {(1, None), (4, None)}
    assert not g.grow(rows((1, 5), (3, None), (4, 2)))
