"""Synchronised pushdown systems: what both a field stack and a call stack can reach.

flow: qid, kind, stmt, val, sym, to_stmt, to_val. Kinds: ``normal``; ``exclude`` (all field stacks but those that
start with sym); ``field_push``, ``field_pop`` of field sym; ``call_push`` with return site sym; ``call_pop``, to
val ``to_val`` at whatever return site is on the stack (to_stmt names the one the flow is for).

Field states are nodes (stmt, val) and field labels are fields; call states are values and call labels
are statements. A node is reached if both automata hold it; only reached nodes have rules.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.semiring import UNWEIGHTED
from pushgraph.operators.pds import EMPTY, EPS, KEYS, gen, is_gen, marked_epsilon_step, own_state, rule_step
from pushgraph.plans.fixpoint import COMPACT, Growing
from pushgraph.session import forget, shuffled, together, written

SEP = "\u0001"
FIELD_END, CALL_END = "field_end", "call_end"
FIELD, CALL = "field", "call"
NODE = ["qid", "stmt", "val"]


def node_id(stmt, val):
    return F.concat(stmt, F.lit(SEP), val)


def _tagged_rules(flow: DataFrame, unbalanced: bool) -> DataFrame:
    """Rules of both systems, told apart by ``of``: those of a flow row come together, so that flow is read once."""
    flow = flow.withColumns({c: own_state(F.col(c)) for c in ("stmt", "val", "to_stmt", "to_val")})
    node, to_node, kind, sym, none = node_id(F.col("stmt"), F.col("val")), node_id(F.col("to_stmt"), F.col("to_val")), F.col("kind"), F.col("sym"), F.lit("")
    rule = lambda of, kind, s1, l1, s2, l2, site: F.struct(F.lit(of).alias("of"), F.lit(kind).alias("kind"), s1.alias("s1"), l1.alias("l1"), s2.alias("s2"), l2.alias("l2"), site.alias("site"), F.lit(0).cast("bigint").alias("w"))
    star = F.lit("*")
    field = (
        F.when(kind == "field_push", rule(FIELD, "push", node, star, to_node, sym, star))
        .when(kind == "field_pop", rule(FIELD, "pop", node, sym, to_node, none, none))
        .when(kind == "exclude", rule(FIELD, "normal", node, star, to_node, F.concat(F.lit("not:"), sym), none))
        .otherwise(rule(FIELD, "normal", node, star, to_node, star, none))
    )
    call = (
        F.when(kind == "call_push", rule(CALL, "push", F.col("val"), F.col("stmt"), F.col("to_val"), F.col("to_stmt"), sym))
        .when(kind == "call_pop", rule(CALL, "pop", F.col("val"), F.col("stmt"), F.col("to_val"), none, none))
        .otherwise(rule(CALL, "normal", F.col("val"), F.col("stmt"), F.col("to_val"), F.col("to_stmt"), none))
    )
    both = F.array(field, call)
    if unbalanced:
        both = F.when(kind == "call_pop", F.array(field, call, rule(CALL, "open", F.col("val"), F.col("stmt"), F.col("to_val"), F.col("to_stmt"), none))).otherwise(both)
    return flow.select("qid", F.explode(both).alias("r")).select("qid", "r.*")


def rules_of(flow: DataFrame, unbalanced: bool = False, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """(field rules, call rules) of flow rows, a rule of each system for a row; without distinct, equal rules may be repeated."""
    rules = _tagged_rules(flow, unbalanced)
    field, call = (rules.filter(F.col("of") == name).drop("of") for name in (FIELD, CALL))
    return (field.distinct(), call.distinct()) if distinct else (field, call)


@dataclass(frozen=True)
class Budget:
    """What one query may use: rounds that bring it something, transitions, and seconds, of which a round's are dealt to the queries by
    their transitions. None: no limit."""

    rounds: int | None = None
    rows: int | None = None
    seconds: float | None = None

    def exceeded(self) -> Column:
        over = [F.col(c) > F.lit(limit) for c, limit in (("rounds", self.rounds), ("rows", self.rows), ("seconds", self.seconds)) if limit is not None]
        out = F.lit(False)
        for x in over:
            out = out | x
        return out


class BudgetExceeded(RuntimeError):
    """The time is used up: reached, fields and calls are what was found until then."""

    def __init__(self, seconds: float, reached: DataFrame, fields: DataFrame, calls: DataFrame) -> None:
        super().__init__(f"no fixpoint after {seconds} seconds: rows are missing")
        self.reached, self.fields, self.calls = reached, fields, calls


@shuffled
def synchronised(
    seeds: DataFrame,
    flows: DataFrame | Callable[[DataFrame], DataFrame],
    *,
    unbalanced: bool = False,
    more: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame | None] | None] | None = None,
    keep_field: Callable[[DataFrame], DataFrame] | None = None,
    keep_call: Callable[[DataFrame], DataFrame] | None = None,
    field_start: DataFrame | None = None,
    returns: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame] | None = None,
    listen: Callable[[str, DataFrame], None] | None = None,
    max_rounds: int | None = None,
    budget_seconds: float | None = None,
    budget: Budget | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reached, field transitions, call transitions) from seeds (qid, stmt, val).

    flows: the flow rows, or a function from newly reached nodes to theirs (the demand-driven form). All
    queries advance in the same rounds; each system joins its new transitions with all rules and all its transitions
    with new rules. unbalanced: a return that no call of the query is matched to goes to every caller.
    more(reached, field transitions, call transitions) is asked when nothing grows any more: the field and call transitions
    (qid, src, label, dst) that it returns go on from there, with further flow rows of nodes that are there already (or None); None or nothing new
    ends. keep_field, keep_call: filters of new transitions. returns(nodes, open calls (qid, to_stmt), ended): flow rows of returns, beside those of flows: from nodes
    to their queries' open calls, which may come later than the node, and from ended ones, which a stack ends at, to every caller. field_start: further field
    transitions (qid, src, label, dst) to start with. listen(name, rows) gets each round's new rows of ``reached``, ``field``,
    ``call``, ``field_rule`` and ``call_rule``, the first of them all that are there.
    budget: a query that uses more goes on no further, and is told as ``exhausted`` (qid, rounds, rows, seconds); the others go on as if alone.
    Runs until nothing grows; RuntimeError after max_rounds, BudgetExceeded (with what was found) after budget_seconds.
    """
    flow_of = flows if callable(flows) else lambda new: flows.join(new.select(*NODE), NODE, "left_semi")
    zero = F.lit(0).cast("bigint").alias("w")
    keep = (keep_field or (lambda t: t), keep_call or (lambda t: t))
    tell = listen or (lambda name, rows: None)
    field_seed = lambda n: n.select("qid", node_id(F.col("stmt"), F.col("val")).alias("src"), F.lit(EMPTY).alias("label"), F.lit(FIELD_END).alias("dst"), zero)
    call_seed = lambda n: n.select("qid", F.col("val").alias("src"), F.col("stmt").alias("label"), F.lit(CALL_END).alias("dst"), zero)
    first = field_seed(seeds) if field_start is None else field_seed(seeds).unionByName(field_start.select("qid", "src", "label", "dst", zero))
    # Both systems are one relation, told apart by their part of the query's name: a round of both is one job.
    part = lambda rows, name: rows.withColumn("qid", F.struct("qid", F.lit(name).alias("of")))
    of = lambda rows, name: rows.filter(F.col("qid.of") == name).withColumn("qid", F.col("qid.qid"))
    both_parts = lambda f, c: part(f, FIELD).unionByName(part(c, CALL))
    parted = lambda rules: rules.withColumn("qid", F.struct("qid", "of")).drop("of")
    systems = Growing(both_parts(first, call_seed(seeds)), [*KEYS, "w"])
    reached = Growing(seeds.select(*NODE), NODE)
    for name, rows in (("field", of(systems.delta, FIELD)), ("call", of(systems.delta, CALL)), ("reached", reached.delta)):
        tell(name, rows)

    def kept(rows: DataFrame) -> DataFrame:
        return both_parts(keep[0](of(rows, FIELD)), keep[1](of(rows, CALL))) if keep_field or keep_call else rows

    # Each node is new once, so its rules are new with it: they are kept, not compared.
    rules: list[DataFrame] = []
    fresh, began = reached.delta, time.monotonic()
    spent, over, lap = None, None, began
    # Calls that a query has pushed, and nodes at which a stack of its ends; fresh: not there before the last round.
    once = lambda t, *keys: t.groupBy(*keys).agg(F.bool_and("fresh").alias("fresh"))
    pushed = lambda t: once(t.filter(is_gen(F.col("src")) & (F.col("label") != EPS)).select("qid", F.col("label").alias("to_stmt"), "fresh"), "qid", "to_stmt")
    ending = lambda t: once(t.filter(~is_gen(F.col("src")) & ~is_gen(F.col("dst")) & (F.col("label") != EPS)).select("qid", F.col("label").alias("stmt"), F.col("src").alias("val"), "fresh"), *NODE)

    def returned(marked: DataFrame, nodes: DataFrame) -> DataFrame:
        """Returns of nodes and open calls that have not met before: one of the two is fresh."""
        calls, ended = of(marked, CALL), None
        if unbalanced:
            ended = nodes.join(ending(calls).withColumnRenamed("fresh", "_ends"), NODE).filter(F.col("fresh") | F.col("_ends")).select(*NODE)
        return returns(nodes, pushed(calls), ended)

    going = lambda rows, of_qid="qid": rows if over is None else rows.join(over.select(F.col("qid").alias("_over")), F.col(of_qid) == F.col("_over"), "left_anti")
    for n in itertools.count():
        if n == max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        if budget_seconds is not None and time.monotonic() - began > budget_seconds:
            raise BudgetExceeded(budget_seconds, reached.total, of(systems.total, FIELD), of(systems.total, CALL))
        marked, new = systems.marked(), None
        if fresh is not None or returns:
            rows = None if fresh is None else flow_of(fresh)
            if returns:
                back = going(returned(marked, reached.marked() if fresh is not None else reached.total.withColumn("fresh", F.lit(False))))
                rows = back if rows is None else rows.unionByName(back)
            new = written(parted(_tagged_rules(rows, unbalanced)))
            if listen:
                tell("field_rule", of(new, FIELD))
                tell("call_rule", of(new, CALL))
            if len(rules) > COMPACT:
                whole = written(together(rules))
                forget(*rules)
                rules = [whole]
        all_rules = together(rules).withColumn("fresh", F.lit(False)) if rules else None
        if new is not None:
            with_new = new.withColumn("fresh", F.lit(True))
            all_rules = with_new if all_rules is None else all_rules.unionByName(with_new)
            rules.append(new)
        step = going(rule_step(marked, all_rules, UNWEIGHTED).unionByName(marked_epsilon_step(marked, UNWEIGHTED)), "qid.qid")
        if not systems.grow(kept(step)):
            taken = more(reached.total, of(systems.total, FIELD), of(systems.total, CALL)) if more else None
            if taken is None:
                break
            candidates = both_parts(*(going(t).select(*KEYS[:4], zero) for t in taken[:2]))
            if taken[2] is not None:
                late = written(parted(_tagged_rules(taken[2], unbalanced)))
                rules.append(late)
                candidates = candidates.unionByName(rule_step(systems.total, late, UNWEIGHTED))
            if not systems.grow(kept(candidates)):
                break
        if listen:
            tell("field", of(systems.delta, FIELD))
            tell("call", of(systems.delta, CALL))
        if budget is not None:
            used, now = systems.delta.groupBy(F.col("qid.qid").alias("qid")).agg(F.count("*").alias("rows")), time.monotonic()
            used = used.select("qid", F.lit(1).cast("bigint").alias("rounds"), "rows", (F.col("rows") * F.lit((now - lap) / max(systems.grown, 1))).alias("seconds"))
            before, lap = spent, now
            spent = written((used if spent is None else spent.unionByName(used)).groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("rounds", "rows", "seconds"))))
            over = spent.filter(budget.exceeded())
            if before is not None:
                forget(before)
        # A node is one of both systems' transitions; one that the last round brought makes it new.
        live, parts, is_field = systems.marked().filter(~is_gen(F.col("src")) & (F.col("label") != EPS)), F.split("src", SEP), F.col("qid.of") == FIELD
        at = live.select(F.col("qid.qid").alias("qid"), F.when(is_field, parts[0]).otherwise(F.col("label")).alias("stmt"), F.when(is_field, parts[1]).otherwise(F.col("src")).alias("val"), is_field.alias("in_field"), "fresh")
        both = at.groupBy(*NODE).agg(F.bool_or("in_field").alias("_field"), F.bool_and("in_field").alias("_only"), F.bool_or("fresh").alias("_new")).filter("_field and not _only and _new").select(*NODE)
        fresh = reached.delta if reached.grow(going(both)) else None
        if fresh is not None:
            tell("reached", fresh)
    if over is not None:
        tell("exhausted", over)
    return reached.total, of(systems.total, FIELD), of(systems.total, CALL)


def empty_stack_nodes(reached: DataFrame, fields: DataFrame, calls: DataFrame) -> DataFrame:
    """Reached nodes that both systems reach with empty stacks."""
    parts = F.split("src", SEP)
    f = fields.filter((F.col("label") == EMPTY) & (F.col("dst") == FIELD_END)).select("qid", parts[0].alias("stmt"), parts[1].alias("val"))
    c = calls.filter((F.col("dst") == CALL_END) & ~is_gen(F.col("src"))).select("qid", F.col("label").alias("stmt"), F.col("src").alias("val"))
    return reached.join(f, NODE, "left_semi").join(c, NODE, "left_semi")


def returned_through(calls: DataFrame) -> DataFrame:
    """(qid, stmt, val): facts that a procedure's own automaton hands to its callers: an epsilon of the procedure leads into the
    state of a call, and each of that state's return sites is a node of the caller."""
    back = calls.filter((F.col("label") == EPS) & is_gen(F.col("dst"))).select("qid", F.col("src").alias("val"), F.col("dst").alias("state"))
    sites = calls.filter(is_gen(F.col("src")) & (F.col("label") != EPS)).select("qid", F.col("src").alias("state"), F.col("label").alias("stmt"))
    return back.join(sites, ["qid", "state"]).select(*NODE).distinct()


def field_seed_path(seeds: DataFrame, field: str) -> DataFrame:
    """(qid, src, label, dst): field transitions with which each seed is also found in a field of itself."""
    node = node_id(F.col("stmt"), F.col("val"))
    made = gen(node, F.lit(field))
    edges = F.array(F.struct(node.alias("src"), F.lit(field).alias("label"), made.alias("dst")), F.struct(made.alias("src"), F.lit(EMPTY).alias("label"), F.lit(FIELD_END).alias("dst")))
    return seeds.select("qid", F.explode(edges).alias("e")).select("qid", "e.*")
