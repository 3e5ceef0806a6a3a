"""Weighted results of solved programs: what a value went through on its way to a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.semiring import DATA_FLOW_PATH, INFERENCE, TYPESTATE, Semiring
from pushgraph.operators import language
from pushgraph.operators.alias import Solution, backward_solve, contexts, points_to
from pushgraph.operators.closure import has_cycle
from pushgraph.operators.flows import FLOW, Options, forward, own_facts
from pushgraph.operators.pds import EPS, is_gen, post_star, values_to_final
from pushgraph.operators.sync import CALL_END, FIELD_END, NODE, node_id, rules_of
from pushgraph.operators.typestate import changes, matched_calls
from pushgraph.plans.fixpoint import fixpoint
from pushgraph.session import written
from pushgraph.sources.ir import Program, end_points, start_points, used_values


def flow_rows(s: Solution, options: Options = Options()) -> DataFrame:
    """Flow rows between reached nodes."""
    flow = forward(s.program, options)
    rows = written(flow(s.reached).unionByName(flow.returns(ended=s.reached)))
    flow.release()
    return rows.join(s.reached.select("qid", F.col("stmt").alias("to_stmt"), F.col("val").alias("to_val")), ["qid", "to_stmt", "to_val"], "left_semi")


def path_weight(p: Program) -> Column:
    """A statement for each flow that changes the value; the call site for a call."""
    none = DATA_FLOW_PATH.one()
    return F.when(F.col("kind") == "call_push", F.array("sym")).when(F.col("val") != F.col("to_val"), F.array("to_stmt")).otherwise(none)


def call_weights(s: Solution, flow: DataFrame, weight: Column, semiring: Semiring) -> DataFrame:
    """(qid, stmt, val, w): the merged weight of every way from the allocation to each reached fact.

    The call system is saturated with the flows' weights; its rules are those of reached nodes only.
    """
    with_weight = flow.withColumn("w", weight)
    _, rules = rules_of(flow, unbalanced=True)
    # A rule carries the weights of the flow rows that make it.
    key = with_weight.select("qid", F.col("val").alias("s1"), F.col("stmt").alias("l1"), F.col("to_val").alias("s2"), F.when(F.col("kind") == "call_pop", F.lit("")).otherwise(F.col("to_stmt")).alias("l2"), "w")
    merged = key.groupBy("qid", "s1", "l1", "s2", "l2").agg(semiring.combine(F.col("w")).alias("w"))
    opened = rules.filter("kind = 'open'").drop("w").join(merged.filter("l2 = ''").drop("l2"), ["qid", "s1", "l1", "s2"])
    closed = rules.filter("kind <> 'open'").drop("w").join(merged, ["qid", "s1", "l1", "s2", "l2"])
    rules = closed.unionByName(opened.select(*closed.columns))
    start = s.seeds.select("qid", F.col("val").alias("src"), F.col("stmt").alias("label"), F.lit(CALL_END).alias("dst"), semiring.one().alias("w"))
    stack = post_star(rules, start, semiring).total.filter(F.col("label") != EPS)
    # A pushed frame starts anew with weight one: what came before lies below it on the stack.
    final = s.seeds.select("qid", F.lit(CALL_END).alias("state"))
    found = values_to_final(stack, final, semiring).total.filter(~is_gen(F.col("src")))
    facts = found.groupBy("qid", F.col("label").alias("stmt"), F.col("src").alias("val")).agg(semiring.combine(F.col("w")).alias("w"))
    return facts.join(s.reached, NODE, "left_semi")


def data_flow_paths(s: Solution) -> DataFrame:
    """(qid, stmt, val, w): statements that a value passed on its ways to each fact that its statement uses."""
    found = call_weights(s, flow_rows(s), path_weight(s.program), DATA_FLOW_PATH)
    return found.join(used_values(s.program), ["stmt", "val"], "left_semi")


def called_on_the_way(s: Solution) -> DataFrame:
    """(qid, stmt, val, w): methods with a body that were entered with the value as receiver."""
    receivers = s.program.param.filter("pos = -1").select(F.col("val").alias("to_val"), F.col("method").alias("entered"))
    flow = flow_rows(s).join(receivers, "to_val", "left")
    weight = F.when((F.col("kind") == "call_push") & F.col("entered").isNotNull(), F.array("entered")).otherwise(INFERENCE.one())
    return call_weights(s, flow, weight, INFERENCE)


def state_changes(s: Solution, moves: DataFrame) -> DataFrame:
    """(qid, stmt, val, w): for one machine's moves, the relation of states from the allocation to each fact."""
    flow = state_flows(s, moves)
    return call_weights(s, flow, F.col("change"), TYPESTATE)


def state_flows(s: Solution, moves: DataFrame) -> DataFrame:
    """flow_rows() with ``change``, the state changes that each flow brings: those of the call at its end, for the value that the
    call acts on; one elsewhere."""
    hit = matched_calls(s.program, moves).groupBy(F.col("stmt").alias("to_stmt"), "val").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("hit"))
    flow = flow_rows(s).join(hit, ["to_stmt", "val"], "left")
    return flow.withColumn("change", F.when(F.col("kind") != "call_push", F.coalesce("hit", TYPESTATE.one())).otherwise(TYPESTATE.one())).drop("hit")


def non_one_flows(flow: DataFrame, weight: Column, semiring: Semiring) -> DataFrame:
    """(qid, stmt, val): the nodes where a flow with another weight than one arrives: potential strong updates."""
    return flow.filter(weight != semiring.one()).select("qid", F.col("to_stmt").alias("stmt"), "val").distinct()


def indirect_flows(s: Solution, nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """(qid, stmt, val, alias): for each node of a change, the other values that hold the object there, by a backward query at the
    node; and the same at the calls open on the node's stack, where the callers' aliases change with it."""
    p = s.program
    before = p.cfg_edge.select(F.col("dst").alias("stmt"), F.col("src").alias("pred")).distinct()
    asked = nodes.join(before, "stmt").select(F.concat_ws("|", "stmt", "val").alias("query"), F.col("pred").alias("stmt"), "val").distinct()
    back = backward_solve(p, asked, options)
    same = back.points.select(F.col("qid").alias("object"), "stmt", "val")
    here = nodes.join(before, "stmt").join(same.withColumnRenamed("stmt", "pred"), ["pred", "val"]).select("qid", "stmt", "val", "object", "pred").filter(F.col("qid") == F.col("object"))
    others = s.points.select("qid", F.col("stmt").alias("pred"), F.col("val").alias("alias"))
    direct = here.join(others, ["qid", "pred"]).filter(F.col("alias") != F.col("val")).select("qid", "stmt", "val", "alias")
    sites = contexts(s, nodes.select(F.struct("qid", "stmt", "val").alias("query"), "stmt", "val")).select(F.col("query.qid").alias("qid"), F.col("query.val").alias("val"), F.col("call_site").alias("stmt"))
    up = sites.join(s.points.select("qid", "stmt", F.col("val").alias("alias")), ["qid", "stmt"]).select("qid", "stmt", "val", "alias")
    return direct.unionByName(up).distinct()


def with_indirect(flow: DataFrame, indirect: DataFrame, one: Column, weight: str = "change") -> DataFrame:
    """Flow rows of the second phase: those of the first, and a plain flow with weight one from each changed node to its aliases."""
    more = indirect.select("qid", F.lit("normal").alias("kind"), "stmt", "val", F.lit("").alias("sym"), F.col("stmt").alias("to_stmt"), F.col("alias").alias("to_val"), one.alias(weight))
    return flow.select(*FLOW, weight).unionByName(more)


def second_phase(s: Solution, moves: DataFrame, options: Options = Options()) -> DataFrame:
    """(qid, stmt, val, w): state_changes() where a change to an object is carried to all its aliases at the node that changes it.

    A strong update, on a value that holds the one object alone in its contexts, leaves the aliases no other way past its statement: the
    flows by which they would keep their old state are taken out of the system before it is saturated.
    """
    flow = written(state_flows(s, moves))
    changed = non_one_flows(flow, F.col("change"), TYPESTATE)
    strong = changes(s, moves).groupBy("qid", "stmt").agg(F.bool_and("strong").alias("strong")).filter("strong")
    values = changed.select("qid", F.col("stmt").alias("to_stmt"), "val").distinct()
    kept = flow.join(strong.select("qid", F.col("stmt").alias("to_stmt"), F.lit(True).alias("_strong")), ["qid", "to_stmt"], "left")
    kept = kept.join(values.withColumn("_changed", F.lit(True)), ["qid", "to_stmt", "val"], "left")
    bypass = (F.col("kind") == "normal") & (F.col("val") == F.col("to_val")) & F.col("_strong").isNotNull() & F.col("_changed").isNull()
    kept = kept.filter(~bypass).select(*flow.columns)
    return call_weights(s, with_indirect(kept, indirect_flows(s, changed, options), TYPESTATE.one()), F.col("change"), TYPESTATE)


def statement_weights(facts: DataFrame, semiring: Semiring) -> DataFrame:
    """(qid, stmt, w): the merged weight of all facts (qid, stmt, val, w) at each statement."""
    return facts.groupBy("qid", "stmt").agg(semiring.combine(F.col("w")).alias("w"))


def result_table(s: Solution) -> DataFrame:
    """(qid, stmt, val): reached facts without those of another method's locals."""
    return own_facts(s.program, s.reached)


def is_empty(s: Solution, queries: DataFrame) -> DataFrame:
    """queries (query, stmt, val) with ``empty``: whether nothing is pointed to."""
    some = points_to(s, queries).select("query").distinct().withColumn("_some", F.lit(True))
    return queries.join(some, "query", "left").select(*queries.columns, F.col("_some").isNull().alias("empty"))


def shared_allocations(s: Solution, pairs: DataFrame) -> DataFrame:
    """pairs (query, other) of queries, each as (query, stmt, val) in a and b of points_to(): allocations that both point to."""
    a = points_to(s, pairs.select("query", "stmt", "val"))
    b = points_to(s, pairs.select("query", F.col("other_stmt").alias("stmt"), F.col("other").alias("val")))
    return a.intersect(b)


def propagation_types(s: Solution) -> DataFrame:
    """(qid, type): declared types of the values that each query has passed through."""
    return s.reached.select("qid", "val").distinct().join(s.program.local.select("val", "type"), "val").filter("type is not null").select("qid", "type").distinct()


def possible_constants(s: Solution, queries: DataFrame) -> DataFrame:
    """queries (query, stmt, val) -> (query, type, const): the constants that a value may be, where alloc rows tell them."""
    known = s.program.alloc.filter("const is not null").select(F.col("stmt").alias("alloc_stmt"), F.col("val").alias("alloc_val"), "const")
    return points_to(s, queries).join(known, ["alloc_stmt", "alloc_val"]).select("query", "type", "const").distinct()


def destructing_statements(s: Solution) -> DataFrame:
    """(qid, stmt, val): where an object ends: from the exits of methods that it does not leave by, the last statements that use it.

    An object leaves a method where a value that holds it at the exit is returned, or is a parameter, to a caller that it has reached too.
    The walk goes back from an exit until a statement uses a value held at the exit, and not beyond a method's first statement.
    """
    p = s.program
    methods = s.reached.join(p.stmt.select("stmt", "method"), "stmt").select("qid", "method").distinct()
    exits = methods.join(end_points(p).select("method", F.col("stmt").alias("exit")), "method")
    held = exits.join(s.reached.withColumnRenamed("stmt", "exit"), ["qid", "exit"]).select("qid", "method", "exit", "val")
    callers = p.call_edge.select(F.col("callee").alias("method"), "caller", "site")
    out = p.ret.select(F.col("stmt").alias("exit"), "val").join(p.stmt.select(F.col("stmt").alias("exit"), "method"), "exit").select("method", "val")
    out = out.unionByName(p.param.select("method", "val")).distinct()
    leaves = held.join(out, ["method", "val"]).join(callers, "method").join(methods.withColumnRenamed("method", "caller"), ["qid", "caller"], "left_semi").select("qid", "exit").distinct()
    inside = held.join(leaves, ["qid", "exit"], "left_anti")
    uses = used_values(p)
    values = inside.select("qid", "exit", "val").distinct()
    back = p.cfg_edge.select(F.col("dst").alias("stmt"), F.col("src").alias("pred")).distinct()
    firsts = start_points(p).select("stmt")

    def used_at(at: DataFrame) -> DataFrame:
        return at.join(values, ["qid", "exit"]).join(uses, ["stmt", "val"], "left_semi")

    def step(total: DataFrame, delta: DataFrame) -> DataFrame:
        going = delta.join(used_at(delta).select("qid", "exit", "stmt").distinct(), ["qid", "exit", "stmt"], "left_anti").join(firsts, "stmt", "left_anti")
        return going.join(back, "stmt").select("qid", "exit", F.col("pred").alias("stmt"))

    seen = fixpoint(inside.select("qid", "exit", F.col("exit").alias("stmt")).distinct(), step, keys=["qid", "exit", "stmt"]).whole()
    return used_at(seen).select("qid", "stmt", "val").distinct()


def access_path_languages(s: Solution, queries: DataFrame) -> DataFrame:
    """queries (query, qid, stmt, val) -> (query, qid, regex): the language of the fields in which val holds the query's object."""
    node = queries.withColumn("start", node_id(F.col("stmt"), F.col("val")))
    ends = node.select("qid", "start", F.lit(FIELD_END).alias("final")).distinct()
    found = language.languages(s.fields.filter(F.col("label") != EPS), ends).filter("regex is not null")
    return node.join(found.select("qid", "start", "regex"), ["qid", "start"]).select("query", "qid", "regex")


def visited_methods(s: Solution) -> DataFrame:
    return s.reached.join(s.program.stmt.select("stmt", "method"), "stmt").select("qid", "method").distinct()


def values_at(s: Solution, stmts: DataFrame) -> DataFrame:
    """(qid, stmt, val): facts at the statements (stmt)."""
    return s.reached.join(stmts.select("stmt").distinct(), "stmt", "left_semi").select(*NODE)


def rule_counts(s: Solution, options: Options = Options()) -> DataFrame:
    """(qid, field_rules, call_rules) of each query."""
    field, call = rules_of(flow_rows(s, options), unbalanced=True)
    n = lambda r, name: r.groupBy("qid").agg(F.count("*").alias(name))
    return n(field, "field_rules").join(n(call, "call_rules"), "qid", "full")


def statistics(s: Solution) -> DataFrame:
    """One row for each query: facts, methods, transitions, states made by pushes, whether its stacks loop."""
    methods = s.reached.join(s.program.stmt.select("stmt", "method"), "stmt").groupBy("qid").agg(F.count_distinct("method").alias("methods"))
    facts = s.reached.groupBy("qid").agg(F.count("*").alias("facts"), F.count_distinct("stmt").alias("statements"))
    out = s.seeds.select("qid", "stmt", "val", "type").join(facts, "qid", "left").join(methods, "qid", "left")
    for name, trans in (("field", s.fields), ("call", s.calls)):
        per = trans.groupBy("qid").agg(F.count("*").alias(f"{name}_transitions"), F.count_distinct(F.when(is_gen(F.col("dst")), F.col("dst"))).alias(f"{name}_states"))
        loops = has_cycle(trans.filter(is_gen(F.col("src")) & is_gen(F.col("dst"))).select("qid", "src", "dst")).withColumnRenamed("cyclic", f"{name}_loop")
        out = out.join(per, "qid", "left").join(loops, "qid", "left").withColumn(f"{name}_loop", F.coalesce(f"{name}_loop", F.lit(False)))
    return out


def type_filter(facts: DataFrame, types: DataFrame, subtypes: DataFrame) -> DataFrame:
    """facts (qid, stmt, val) of allocations types (qid, type), and declared types (val, declared): those that can be.

    facts carry ``declared`` (null: unknown, passes). An allocation passes into its own type, a supertype, or an
    interface above it, by subtypes (sub, sup), reflexive and transitive.
    """
    with_type = facts.join(types, "qid", "left")
    known = with_type.join(subtypes.select(F.col("sub").alias("type"), F.col("sup").alias("declared"), F.lit(True).alias("fits")), ["type", "declared"], "left")
    return known.filter(F.col("declared").isNull() | F.col("type").isNull() | (F.col("type") == F.col("declared")) | F.coalesce("fits", F.lit(False))).select(*facts.columns)


def null_branches_cut(cfg: DataFrame, branches: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, src, dst, val): edges that null facts (qid, stmt, val) still take: not those into a branch (src, dst, val)
    where the value can't be null."""
    at = facts.join(cfg.select(F.col("src").alias("stmt"), "dst"), "stmt").select("qid", F.col("stmt").alias("src"), "dst", "val")
    return at.join(branches.select("src", "dst", "val"), ["src", "dst", "val"], "left_anti")


def callers(known: DataFrame, precomputed: DataFrame, unbalanced: DataFrame) -> DataFrame:
    """(site, callee): known callers; for unbalanced (method) without any, the precomputed ones."""
    open_ones = unbalanced.select(F.col("method").alias("callee")).join(known.select("callee"), "callee", "left_anti")
    return known.select("site", "callee").unionByName(precomputed.select("site", "callee").join(open_ones, "callee", "left_semi")).distinct()
