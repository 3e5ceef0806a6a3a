"""Closures over edge tables: reachability, epsilon closure, cycles, longest paths, prefix import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.semiring import MIN_PLUS
from pushgraph.operators.pds import EPS
from pushgraph.plans.fixpoint import Relation, fixpoint
from pushgraph.session import forget, written, written_counted


def _edges(edges: DataFrame) -> DataFrame:
    """Distinct (qid, src, dst), as a table: whatever they come from is computed once, not once a round."""
    return written(edges.select("qid", "src", "dst").distinct())


def reachable(edges: DataFrame, start: DataFrame, **limits) -> DataFrame:
    """(qid, node): nodes that (qid, src, dst) edges reach from (qid, node), itself included.

    A frontier join: each round reads only the nodes that the last one found.
    """
    e = _edges(edges)
    step = lambda total, delta: delta.withColumnRenamed("node", "src").join(e, ["qid", "src"]).select("qid", F.col("dst").alias("node"))
    return fixpoint(start.select("qid", "node"), step, keys=["qid", "node"], **limits).whole()


def transitive_closure(edges: DataFrame, *, doubling: bool = True, **limits) -> DataFrame:
    """(qid, src, dst): all pairs with a path of one edge or more.

    doubling joins the new pairs with all pairs on both sides: the number of rounds is the logarithm of
    the longest path. Without it, a round is a join with the edges.
    """
    e = _edges(edges)

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(F.col("qid").alias("r_qid"), F.col("src").alias("r_src"), F.col("dst").alias("r_dst"))
        return left.join(r, (F.col("qid") == F.col("r_qid")) & (F.col("dst") == F.col("r_src"))).select("qid", "src", F.col("r_dst").alias("dst"))

    if doubling:
        step = lambda total, delta: pairs(delta, total).unionByName(pairs(total, delta))
    else:
        step = lambda total, delta: pairs(delta, e)
    return fixpoint(e, step, keys=["qid", "src", "dst"], **limits).whole()


def epsilon_closure(trans: DataFrame, **limits) -> DataFrame:
    """Pairs that epsilon transitions alone connect."""
    return transitive_closure(trans.filter(F.col("label") == EPS), **limits)


def on_cycle(edges: DataFrame, **limits) -> DataFrame:
    """(qid, node): nodes that lie on a cycle (a loop is one). Only edges between cycles, or on them, are closed over."""
    return transitive_closure(cyclic_core(edges), **limits).filter(F.col("src") == F.col("dst")).select("qid", F.col("src").alias("node"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(qid, src, dst): edges on cycles or between them. Edges that nothing leads to, or that lead to nothing, are peeled off
    until there are none; a round is two semi joins with the edges left."""
    e, n = written_counted(edges.select("qid", "src", "dst").distinct())
    while n:
        fed = e.join(e.select("qid", F.col("dst").alias("src")).distinct(), ["qid", "src"], "left_semi")
        left, m = written_counted(fed.join(e.select("qid", F.col("src").alias("dst")).distinct(), ["qid", "dst"], "left_semi").select("qid", "src", "dst"))
        forget(e)
        e, n = left, 0 if m == n else m
    return e


def has_cycle(edges: DataFrame) -> DataFrame:
    """(qid, cyclic) for each qid of edges."""
    cyclic = cyclic_core(edges).select("qid").distinct().withColumn("cyclic", F.lit(True))
    return edges.select("qid").distinct().join(cyclic, "qid", "left").select("qid", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def depths(edges: DataFrame, start: DataFrame, longest: bool = False, max_rounds: int | None = None) -> DataFrame:
    """(qid, node, depth): least number of edges from start; with longest, the most, where paths end.

    longest gives up on a cycle, as a path through it has no end: after max_rounds, or as many rounds as a qid has nodes.
    """
    e = _edges(edges)
    if longest and max_rounds is None:
        nodes = e.select("qid", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("qid").count()
        max_rounds = nodes.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] + 1
    first = start.select("qid", "node", F.lit(0).alias("depth"))
    step = lambda total, delta: delta.withColumnRenamed("node", "src").join(e, ["qid", "src"]).select("qid", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    agg = F.max if longest else F.min
    found: Relation = fixpoint(first, step, keys=["qid", "node", "depth"] if longest else ["qid", "node"], weight=None if longest else "depth", semiring=None if longest else MIN_PLUS, max_rounds=max_rounds)
    if longest and found.timed_out:
        raise ValueError(f"a path has more than {max_rounds} edges; is there a cycle?")
    return found.whole().groupBy("qid", "node").agg(agg("depth").alias("depth"))


def longest_label_path(trans: DataFrame, start: DataFrame, **limits) -> DataFrame:
    """(qid, labels): the largest set of labels on a path without repeated labels from (qid, node); ties by order."""
    t = written(trans.select("qid", "src", "label", "dst").distinct())
    first = start.select("qid", F.col("node"), F.expr("cast(array() as array<string>)").alias("labels"))

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        hit = delta.withColumnRenamed("node", "src").join(t, ["qid", "src"]).filter(~F.array_contains("labels", F.col("label")))
        return hit.select("qid", F.col("dst").alias("node"), F.array_sort(F.array_append("labels", F.col("label"))).alias("labels"))

    found = fixpoint(first, step, keys=["qid", "node", "labels"], **limits).whole()
    return found.groupBy("qid").agg(F.max_by("labels", F.struct(F.size("labels"), F.array_join("labels", ","))).alias("labels"))


def prefix_import(base: DataFrame, flow: DataFrame, at: DataFrame, **limits) -> DataFrame:
    """Transitions (qid, src, label, dst) that flow's automaton takes over from base's.

    at: (qid, src, label, dst) of base. From its target and that of flow's transition with the same start and label,
    both automata are followed along equal labels; base's transitions into a state that is met lead into
    its partner, and what leads into those sources comes along.
    """
    a = base.select("qid", F.col("src").alias("a_src"), F.col("label").alias("a_label"), F.col("dst").alias("a_dst"))
    b = flow.select("qid", F.col("src").alias("b_src"), F.col("label").alias("b_label"), F.col("dst").alias("b_dst"))
    first = at.join(b, (at["qid"] == b["qid"]) & (at["src"] == F.col("b_src")) & (at["label"] == F.col("b_label"))).select(at["qid"], F.col("dst").alias("left"), F.col("b_dst").alias("right"))

    def follow(total: DataFrame, delta: DataFrame) -> DataFrame:
        hit = delta.join(a.withColumnRenamed("qid", "a_qid"), (F.col("qid") == F.col("a_qid")) & (F.col("left") == F.col("a_src")))
        hit = hit.join(b.withColumnRenamed("qid", "b_qid"), (F.col("qid") == F.col("b_qid")) & (F.col("right") == F.col("b_src")) & (F.col("a_label") == F.col("b_label")))
        return hit.select("qid", F.col("a_dst").alias("left"), F.col("b_dst").alias("right"))

    met = fixpoint(first, follow, keys=["qid", "left", "right"], **limits).whole()
    taken = a.withColumnRenamed("qid", "a_qid")
    into = met.join(taken, (F.col("qid") == F.col("a_qid")) & (F.col("left") == F.col("a_dst"))).select("qid", F.col("a_src").alias("src"), F.col("a_label").alias("label"), F.col("right").alias("dst"))
    new = into.join(at.select("qid", "src", "label"), ["qid", "src", "label"], "left_anti").join(flow.select("qid", "src", "label", "dst"), ["qid", "src", "label", "dst"], "left_anti").distinct()

    def come_along(total: DataFrame, delta: DataFrame) -> DataFrame:
        hit = delta.select("qid", F.col("src").alias("to")).join(taken, (F.col("qid") == F.col("a_qid")) & (F.col("to") == F.col("a_dst")))
        return hit.select("qid", F.col("a_src").alias("src"), F.col("a_label").alias("label"), F.col("to").alias("dst"))

    return fixpoint(new, come_along, keys=["qid", "src", "label", "dst"], **limits).whole()


def label(edges: DataFrame, name: Column) -> DataFrame:
    """Edges as transitions with one label."""
    return edges.select("qid", "src", name.alias("label"), "dst")
