"""Weighted pushdown systems: post* and pre* saturation of P-automata.

rule:  qid, kind ('normal', 'push', 'pop', 'open'), s1, l1, s2, l2, site, w
trans: qid, src, label, dst, w

l1 '*' matches every label. l2 '*' (normal) and site '*' (push) copy the label read; l2 'not:f' copies it
unless it is f. A copy never copies an epsilon. A push makes the state gen(s2, l2), which alone may begin with '<': rules
that name such a state are refused. 'open' is a pop off an empty stack that goes on at (s2, l2): a return to any caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.semiring import UNWEIGHTED, Semiring
from pushgraph.plans.fixpoint import Relation, fixpoint
from pushgraph.session import shuffled, written

EPS, EMPTY, ANY, NOT = "eps", "{}", "*", "not:"
KEYS = ["qid", "src", "label", "dst"]


def gen(state: Column, label: Column) -> Column:
    """The state that a push of label onto state makes."""
    return F.concat(F.lit("<"), state, F.lit("|"), label, F.lit(">"))


def is_gen(state: Column) -> Column:
    return state.startswith("<")


def own_state(state: Column) -> Column:
    """state, or an error where its name is kept for states that pushes make."""
    return F.when(is_gen(state), F.raise_error(F.concat(F.lit("a state may not begin with '<': "), state)).cast("string")).otherwise(state)


def normalised_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules (weight included) without those that change nothing."""
    rules = rules.withColumns({"s1": own_state(F.col("s1")), "s2": own_state(F.col("s2"))})
    return rules.filter(~((F.col("kind") == "normal") & (F.col("s1") == F.col("s2")) & (F.col("l1") == F.col("l2")))).distinct()


def rule_step(trans: DataFrame, rules: DataFrame, semiring: Semiring, unbalanced: DataFrame | None = None) -> DataFrame:
    """Transitions that one application of the rules to trans gives; one join of the two.

    Pops apply where the target was made by a push, or is one of unbalanced (qid, state). Where both have a column ``fresh``, only with
    a fresh one of the two.
    """
    marked = "fresh" in trans.columns and "fresh" in rules.columns
    t = trans.select(*KEYS, F.col("w").alias("t_w"), *([F.col("fresh").alias("t_fresh")] if marked else []))
    r = rules.select(F.col("qid").alias("r_qid"), "kind", "s1", "l1", "s2", "l2", "site", F.col("w").alias("r_w"), *([F.col("fresh").alias("r_fresh")] if marked else []))
    hit = t.join(r, (F.col("qid") == F.col("r_qid")) & (F.col("src") == F.col("s1")) & ((F.col("l1") == ANY) | (F.col("l1") == F.col("label"))))
    if marked:
        hit = hit.filter(F.col("t_fresh") | F.col("r_fresh"))
    if unbalanced is not None:
        u = unbalanced.select(F.col("qid").alias("u_qid"), F.col("state").alias("u_state")).distinct()
        hit = hit.join(u, (F.col("qid") == F.col("u_qid")) & (F.col("dst") == F.col("u_state")), "left")
        open_end = F.col("u_state").isNotNull()
    else:
        open_end = F.lit(False)
    w = semiring.extend(F.col("t_w"), F.col("r_w"))
    row = lambda src, label, dst, w: F.struct(src.alias("src"), label.alias("label"), dst.alias("dst"), w.alias("w"))
    src, label, dst, kind, s2, l2, site = map(F.col, ("src", "label", "dst", "kind", "s2", "l2", "site"))
    copies = (l2 == ANY) | l2.startswith(NOT)
    blocked = (copies & (label == EPS)) | (l2 == F.concat(F.lit(NOT), label))
    made = gen(s2, l2)
    out = (
        F.when((kind == "normal") & ~blocked, F.array(row(s2, F.when(copies, label).otherwise(l2), dst, w)))
        .when((kind == "push") & ~((site == ANY) & (label == EPS)), F.array(row(made, F.when(site == ANY, label).otherwise(site), dst, w), row(s2, l2, made, semiring.one())))
        .when((kind == "open") & ~is_gen(dst), F.array(row(s2, l2, dst, w)))
        .when((kind == "pop") & (is_gen(dst) | open_end), F.array(row(s2, F.lit(EPS), dst, w)))
    )
    return hit.select("qid", F.explode(out).alias("o")).select("qid", "o.*")


def epsilon_step(total: DataFrame, delta: DataFrame, semiring: Semiring) -> DataFrame:
    """Closure of epsilons: (p, eps, q, w1) and (q, g, r, w2) give (p, g, r, w2 * w1); one side is new."""

    def closed(eps: DataFrame, edges: DataFrame) -> DataFrame:
        e = eps.filter(F.col("label") == EPS).select("qid", "src", F.col("dst").alias("mid"), F.col("w").alias("e_w"))
        g = edges.filter(F.col("label") != EPS).select(F.col("qid").alias("g_qid"), F.col("src").alias("g_src"), "label", "dst", F.col("w").alias("g_w"))
        hit = e.join(g, (F.col("qid") == F.col("g_qid")) & (F.col("mid") == F.col("g_src")))
        return hit.select("qid", "src", "label", "dst", semiring.extend(F.col("g_w"), F.col("e_w")).alias("w"))

    return closed(delta, total).unionByName(closed(total, delta)).filter(~((F.col("src") == F.col("dst")) & (F.col("label") == EPS)))


def marked_epsilon_step(trans: DataFrame, semiring: Semiring) -> DataFrame:
    """epsilon_step() of transitions with a column ``fresh``: one join of the epsilons with the others, of which one is fresh."""
    e = trans.filter(F.col("label") == EPS).select("qid", "src", F.col("dst").alias("mid"), F.col("w").alias("e_w"), F.col("fresh").alias("e_fresh"))
    g = trans.filter(F.col("label") != EPS).select(F.col("qid").alias("g_qid"), F.col("src").alias("g_src"), "label", "dst", F.col("w").alias("g_w"), "fresh")
    hit = e.join(g, (F.col("qid") == F.col("g_qid")) & (F.col("mid") == F.col("g_src"))).filter(F.col("e_fresh") | F.col("fresh"))
    return hit.select("qid", "src", "label", "dst", semiring.extend(F.col("g_w"), F.col("e_w")).alias("w"))


def through_empty_step(total: DataFrame, delta: DataFrame, rules: DataFrame, semiring: Semiring) -> DataFrame:
    """Pops that look through the empty stack's label: (p, {}, q) and (q, l, r) with a pop of l at p give (s2, eps, r)."""
    pops = rules.filter("kind = 'pop'").select(F.col("qid").alias("r_qid"), "s1", "l1", "s2", F.col("w").alias("r_w"))

    def popped(empty: DataFrame, edges: DataFrame) -> DataFrame:
        e = empty.filter(F.col("label") == EMPTY).select("qid", F.col("src").alias("p"), F.col("dst").alias("mid"), F.col("w").alias("e_w"))
        e = e.join(pops, (F.col("qid") == F.col("r_qid")) & (F.col("p") == F.col("s1")))
        g = edges.select(F.col("qid").alias("g_qid"), F.col("src").alias("g_src"), "label", "dst", F.col("w").alias("g_w"))
        hit = e.join(g, (F.col("qid") == F.col("g_qid")) & (F.col("mid") == F.col("g_src")) & ((F.col("l1") == ANY) | (F.col("l1") == F.col("label"))))
        w = semiring.extend(semiring.extend(F.col("g_w"), F.col("e_w")), F.col("r_w"))
        return hit.filter(F.col("label") != EPS).select("qid", F.col("s2").alias("src"), F.lit(EPS).alias("label"), "dst", w.alias("w"))

    return popped(delta, total).unionByName(popped(total, delta))


def _least(start: DataFrame, step, semiring: Semiring, limits: dict) -> Relation:
    if semiring is UNWEIGHTED:  # a constant weight: rows are a plain set
        return fixpoint(start.select(*KEYS, "w"), step, keys=[*KEYS, "w"], **limits)
    return fixpoint(start.select(*KEYS, "w"), step, keys=KEYS, weight="w", semiring=semiring, **limits)


@shuffled
def post_star(rules: DataFrame, initial: DataFrame, semiring: Semiring = UNWEIGHTED, *, unbalanced: DataFrame | None = None, through_empty: bool = False, **limits) -> Relation:
    """All transitions of the automaton of configurations reachable from initial (qid, src, label, dst, w).

    through_empty: pops are also tried behind a transition with the empty stack's label.
    """
    rules = written(normalised_rules(rules))

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        out = rule_step(delta, rules, semiring, unbalanced).unionByName(epsilon_step(total, delta, semiring))
        return out.unionByName(through_empty_step(total, delta, rules, semiring)) if through_empty else out

    return _least(initial, step, semiring, limits)


@shuffled
def pre_star(rules: DataFrame, initial: DataFrame, semiring: Semiring = UNWEIGHTED, **limits) -> Relation:
    """All transitions of the automaton of configurations from which initial can be reached.

    Wildcards stand for the labels that the rules and initial name.
    """
    named = rules.select("qid", F.explode(F.array("l1", "l2", "site")).alias("label")).unionByName(initial.select("qid", "label")).distinct()
    named = named.filter(F.col("label").isNotNull() & ~F.col("label").isin("", EPS, ANY) & ~F.col("label").startswith(NOT))
    r = written(instantiated(normalised_rules(rules), named).select(F.col("qid").alias("r_qid"), "kind", "s1", "l1", "s2", "l2", "site", F.col("w").alias("r_w")))

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        normal = delta.withColumnRenamed("w", "t_w").join(r.filter("kind = 'normal'"), (F.col("qid") == F.col("r_qid")) & (F.col("src") == F.col("s2")) & (F.col("label") == F.col("l2")))
        out = normal.select("qid", F.col("s1").alias("src"), F.col("l1").alias("label"), "dst", semiring.extend(F.col("r_w"), F.col("t_w")).alias("w"))
        for first, second in ((delta, total), (total, delta)):
            a = first.select("qid", "src", "label", F.col("dst").alias("mid"), F.col("w").alias("a_w"))
            b = second.select(F.col("qid").alias("b_qid"), F.col("src").alias("b_src"), F.col("label").alias("b_label"), "dst", F.col("w").alias("b_w"))
            push = a.join(r.filter("kind = 'push'"), (F.col("qid") == F.col("r_qid")) & (F.col("src") == F.col("s2")) & (F.col("label") == F.col("l2")))
            hit = push.join(b, (F.col("qid") == F.col("b_qid")) & (F.col("mid") == F.col("b_src")) & (F.col("site") == F.col("b_label")))
            w = semiring.extend(F.col("r_w"), semiring.extend(F.col("a_w"), F.col("b_w")))
            out = out.unionByName(hit.select("qid", F.col("s1").alias("src"), F.col("l1").alias("label"), "dst", w.alias("w")))
        return out

    pops = r.filter("kind = 'pop'").select(F.col("r_qid").alias("qid"), F.col("s1").alias("src"), F.col("l1").alias("label"), F.col("s2").alias("dst"), F.col("r_w").alias("w"))
    return _least(initial.unionByName(pops), step, semiring, limits)


def unbalanced_pops(trans: DataFrame, rules: DataFrame, unbalanced: DataFrame, semiring: Semiring = UNWEIGHTED) -> DataFrame:
    """(qid, state, label, target, w): pops that leave the automaton at an unbalanced state, merged."""
    t = trans.join(unbalanced.select("qid", F.col("state").alias("dst")).distinct(), ["qid", "dst"]).select("qid", "src", "label", "dst", F.col("w").alias("t_w"))
    r = rules.filter("kind = 'pop'").select("qid", F.col("s1").alias("src"), "l1", "s2", F.col("w").alias("r_w"))
    hit = t.join(r, ["qid", "src"]).filter((F.col("l1") == ANY) | (F.col("l1") == F.col("label")))
    hit = hit.select("qid", F.col("s2").alias("state"), "label", F.col("dst").alias("target"), semiring.extend(F.col("t_w"), F.col("r_w")).alias("w"))
    return hit.groupBy("qid", "state", "label", "target").agg(semiring.combine(F.col("w")).alias("w"))


def matched_calls(trans: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, call_site, return_site, fact): returns matched to the pushes that they return from."""
    pushes = rules.filter("kind = 'push'").select("qid", F.col("l1").alias("call_site"), F.col("site").alias("return_site"), gen(F.col("s2"), F.col("l2")).alias("dst"))
    returns = trans.filter((F.col("label") == EPS) & is_gen(F.col("dst"))).select("qid", F.col("src").alias("fact"), "dst")
    reached = trans.filter(is_gen(F.col("src")) & (F.col("label") != EPS)).select("qid", F.col("src").alias("dst"), F.col("label").alias("return_site"))
    return returns.join(pushes, ["qid", "dst"]).join(reached, ["qid", "dst", "return_site"], "left_semi").select("qid", "call_site", "return_site", "fact").distinct()


def summaries(trans: DataFrame) -> DataFrame:
    """(qid, aut_id, n, returns): transitions and epsilons of each procedure's own automaton, keyed by its target."""
    return trans.filter(is_gen(F.col("dst"))).groupBy("qid", F.col("dst").alias("aut_id")).agg(F.count("*").alias("n"), F.sum((F.col("label") == EPS).cast("bigint")).alias("returns"))


def instantiated(rules: DataFrame, labels: DataFrame) -> DataFrame:
    """Wildcard rules as plain ones, one for each label of (qid, label) that they match."""
    names = labels.select(F.col("qid").alias("n_qid"), F.col("label").alias("name")).distinct()
    copy = (F.col("l2") == ANY) | F.col("l2").startswith(NOT)
    plain = rules.filter((F.col("l1") != ANY) & ~F.coalesce(F.col("l2") == F.concat(F.lit(NOT), "l1"), F.lit(False)))
    plain = plain.withColumns({"l2": F.when(copy, F.col("l1")).otherwise(F.col("l2")), "site": F.when(F.col("site") == ANY, F.col("l1")).otherwise(F.col("site"))})
    wild = rules.filter(F.col("l1") == ANY).join(names, (F.col("qid") == F.col("n_qid")) & (F.col("l2").isNull() | (F.col("l2") != F.concat(F.lit(NOT), F.col("name")))))
    l2 = F.when((F.col("l2") == ANY) | F.col("l2").startswith(NOT), F.col("name")).otherwise(F.col("l2"))
    site = F.when(F.col("site") == ANY, F.col("name")).otherwise(F.col("site"))
    wild = wild.withColumns({"l1": F.col("name"), "l2": l2, "site": site}).select(*rules.columns)
    return plain.unionByName(wild).distinct()


def values_to_final(trans: DataFrame, final: DataFrame, semiring: Semiring, **limits) -> Relation:
    """(qid, src, label, dst, w): weight of each transition times that of the rest of its way to a final state.

    final: (qid, state). Values start at the final states and follow edges backwards.
    """
    t = trans.select("qid", "src", "label", "dst", F.col("w").alias("t_w"))
    f = final.select("qid", F.col("state").alias("dst")).distinct()
    start = t.join(f, ["qid", "dst"]).select(*KEYS, F.col("t_w").alias("w"))

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        out = delta.select("qid", F.col("src").alias("dst"), F.col("w").alias("v"))
        return t.join(out, ["qid", "dst"]).select(*KEYS, semiring.extend(F.col("v"), F.col("t_w")).alias("w"))

    return fixpoint(start, step, keys=KEYS, weight="w", semiring=semiring, **limits)
