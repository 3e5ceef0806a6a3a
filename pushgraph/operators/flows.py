"""Flow functions: what a fact at a statement becomes, as rows of the synchronised systems.

A node (stmt, val) says that val holds after stmt. Forward flow is evaluated at the successor statement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.session import forget, written
from pushgraph.sources.ir import ARRAY, RESULT, THIS, Program, end_points, entry_points, has, ignored_methods, initialiser_ends, instance_branches, killed_values, start_points

FLOW = ["qid", "kind", "stmt", "val", "sym", "to_stmt", "to_val"]
STATIC = "static:"
NODES = ["qid", "stmt", "val"]


@dataclass(frozen=True)
class Options:
    """Switches of the solver, with their defaults.

    type_check: facts whose allocation can't have their declared type go (where local rows tell it). on_the_fly_call_graph:
    solve() finds virtual calls' targets by itself, from the program's entry methods. timeout_seconds: a solution found within it is
    marked timed_out if it isn't whole; None: no limit.
    """

    static_flows: bool = True
    array_flows: bool = True
    track_fields: bool = True
    throw_flows: bool = False
    type_check: bool = True
    aliasing: bool = True
    on_the_fly_call_graph: bool = False
    track_strings: bool = False
    track_nulls: bool = False
    track_throwables: bool = False
    track_instance_of: bool = False
    kill_null_at_cast: bool = False
    static_fields_at_entry: bool = False
    timeout_seconds: float | None = None

    def allocation(self) -> dict:
        """The switches that tell allocations, by their names there."""
        return {"strings": self.track_strings, "nulls": self.track_nulls, "arrays": self.array_flows, "throwables": self.track_throwables}

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        """Options of a profile that names every switch; throw_flows stays off."""
        missing = set(cls.__dataclass_fields__) - set(values)
        if missing:
            raise KeyError(f"missing options: {sorted(missing)}")
        return cls(**({k: values[k] for k in cls.__dataclass_fields__} | {"throw_flows": False}))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*FLOW)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FLOW))
    return out.distinct()


def _row(df: DataFrame, kind: str, sym, to_stmt: str, to_val) -> DataFrame:
    return df.select("qid", F.lit(kind).alias("kind"), "stmt", "val", (F.lit("") if sym is None else sym).alias("sym"), F.col(to_stmt).alias("to_stmt"), to_val.alias("to_val"))


class Flow:
    """A function from new nodes to their flow rows, but those of returns, which depend on a query's calls: returns() gives them.
    release() frees the tables that it keeps."""

    def __init__(self, rows: Callable[[DataFrame], DataFrame], returns: Callable[..., DataFrame], kept: list[DataFrame], tables: list[DataFrame]) -> None:
        self.rows, self.returns, self.kept, self.tables = rows, returns, kept, tables

    def __call__(self, new: DataFrame) -> DataFrame:
        return self.rows(new)

    def release(self) -> None:
        for t in self.kept:
            t.unpersist()
        forget(*self.tables)


def models(p: Program) -> DataFrame:
    """(succ, val, to): what calls without a body copy: arraycopy its first argument to its third, others by lib_model."""
    given = p.spark.createDataFrame([("arraycopy", 0, 2)], "name string, src int, dst int")
    given = given.unionByName(p.lib_model.select("name", "src", "dst"))
    calls = p.call.select(F.col("stmt").alias("succ"), "recv", "lhs", F.regexp_extract("sig", r"^[^(]*", 0).alias("name")).join(F.broadcast(given), "name")
    with_body = p.call_edge.join(p.method.filter("has_body and not native and not phantom").select(F.col("method").alias("callee")), "callee").select(F.col("site").alias("succ"))
    calls = calls.join(with_body, "succ", "left_anti")
    at = p.arg.filter(F.col("pos") != THIS).select(F.col("stmt").alias("succ"), "pos", "val")
    at = at.unionByName(p.call.filter("recv is not null").select(F.col("stmt").alias("succ"), F.lit(THIS).alias("pos"), F.col("recv").alias("val")))
    to = at.unionByName(p.call.filter("lhs is not null").select(F.col("stmt").alias("succ"), F.lit(RESULT).alias("pos"), F.col("lhs").alias("val")))
    found = calls.select("succ", "src", "dst").join(at.withColumnRenamed("pos", "src"), ["succ", "src"])
    return found.join(to.select("succ", F.col("pos").alias("dst"), F.col("val").alias("to")), ["succ", "dst"]).select("succ", "val", "to").distinct()


def is_identity(flow: DataFrame) -> DataFrame:
    """(qid, stmt, val): nodes whose only flow leaves the value as it is, at a statement that neither calls nor touches fields."""
    one = flow.groupBy("qid", "stmt", "val").agg(F.count("*").alias("n"), F.min(F.struct("kind", "to_val")).alias("f"))
    return one.filter((F.col("n") == 1) & (F.col("f.kind") == "normal") & (F.col("f.to_val") == F.col("val"))).select("qid", "stmt", "val")


def _returns(pops: DataFrame, ends: DataFrame, sites: DataFrame, statics: bool) -> tuple[Callable[..., DataFrame], list[DataFrame]]:
    """A function from nodes (qid, stmt, val), open calls (qid, to_stmt) and ended nodes to the flow rows of returns, with the tables that it
    keeps: nodes return to their query's open calls alone, where one of the two is ``fresh`` (nodes without that column are), ended ones to every caller. pops (stmt, val, to_stmt, to_val): what a return hands over; ends (stmt,
    callee): where callees are left; sites (to_stmt, callee): where they are returned to."""
    pops, ends, sites = written(pops.distinct()), written(ends.distinct()), written(sites.distinct())

    def rows(nodes: DataFrame | None = None, open_calls: DataFrame | None = None, ended: DataFrame | None = None) -> DataFrame:
        parts = []
        if nodes is not None:
            mark = lambda df, name, known: df.withColumn(name, F.col("fresh") if "fresh" in df.columns else F.lit(known))
            left = mark(nodes, "_left", True).select(*NODES, "_left").join(ends, "stmt")
            calls = mark(open_calls, "_called", False).select("qid", "to_stmt", "_called").join(sites, "to_stmt")
            parts.append(left.join(calls, ["qid", "callee"]).filter(F.col("_left") | F.col("_called")).select(*NODES, "to_stmt"))
        if ended is not None:
            parts.append(ended.select(*NODES).join(ends, "stmt").join(sites, "callee").select(*NODES, "to_stmt"))
        at = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = at.join(pops, ["stmt", "val", "to_stmt"]).select("qid", "stmt", "val", "to_stmt", "to_val")
        if statics:
            out = out.unionByName(at.filter(F.col("val").startswith(STATIC)).select("qid", "stmt", "val", "to_stmt", F.col("val").alias("to_val")))
        return out.distinct().select("qid", F.lit("call_pop").alias("kind"), "stmt", "val", F.lit("").alias("sym"), "to_stmt", "to_val")

    return rows, [pops, ends, sites]


ROW = ["stmt", "val", "kind", "sym", "to_stmt", "to_val"]
LEAP, LEVELS = 8, 3


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (ROW) that follow one of first and then one of second: plain ones, and those with one act on a field, or with the same exclusion twice."""
    a = first.select("stmt", "val", F.col("kind").alias("_kind"), F.col("sym").alias("_sym"), F.col("to_stmt").alias("_at"), F.col("to_val").alias("_of"))
    b = second.withColumnsRenamed({"stmt": "_at", "val": "_of"})
    plain = F.col("_kind") == "normal"
    same = (F.col("kind") == "exclude") & (F.col("_kind") == "exclude") & (F.col("sym") == F.col("_sym"))
    met = a.join(b, ["_at", "_of"]).filter(plain | (F.col("kind") == "normal") | same)
    return met.select("stmt", "val", F.when(plain, F.col("kind")).otherwise(F.col("_kind")).alias("kind"), F.when(plain, F.col("sym")).otherwise(F.col("_sym")).alias("sym"), "to_stmt", "to_val")


def _leaps(one: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(rows, tables to free): rows of one (ROW), of which a node has one at most, followed 2 to LEAP - 1 times, and LEAP times as far, and so on."""
    out, tables = [], []
    for level in range(levels):
        by = {1: one}
        for n in (2, 4):
            by[n] = written(_then(by[n // 2], by[n // 2]))
            tables.append(by[n])
        by[3] = _then(by[2], by[1])
        by |= {4 + n: _then(by[4], by[n]) for n in (1, 2, 3)}
        out += [by[n] for n in range(1 if level else 2, LEAP)]
        if level + 1 == levels or by[4].isEmpty():
            break
        one = written(_then(by[4], by[4]))
        tables.append(one)
    return out, tables


def _over_calls(special: DataFrame, alone: DataFrame, pops: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(rows (ROW), tables to free): what calls of methods make of the values that they get, where the way through the method is a run of alone, one other
    step and a run again at most."""
    runs, tables = _leaps(alone, 1)
    ways = reduce(DataFrame.unionByName, runs, alone)
    begins = special.filter("kind = 'call_push'").select("stmt", "val", "sym", "to_stmt", "to_val").distinct()
    none = lambda at: at.select("stmt", "val", F.lit("normal").alias("kind"), F.lit("").alias("sym"), F.col("stmt").alias("to_stmt"), F.col("val").alias("to_val"))
    ways = written(ways.join(begins.select(F.col("to_stmt").alias("stmt")).unionByName(special.select(F.col("to_stmt").alias("stmt"))).distinct(), "stmt", "left_semi"))
    entered = begins.select(F.col("to_stmt").alias("stmt"), F.col("to_val").alias("val")).distinct()
    there = none(entered).unionByName(ways.join(entered, ["stmt", "val"], "left_semi"))
    acts = special.filter("kind in ('normal', 'field_pop') and val <> to_val").select(*ROW)
    acted = written(_then(there, acts))
    through = there.unionByName(acted).unionByName(_then(acted, ways))
    left = through.withColumnsRenamed({"stmt": "_begin", "val": "_param", "to_stmt": "_end", "to_val": "_last"})
    over = begins.withColumnsRenamed({"sym": "_site", "to_stmt": "_begin", "to_val": "_param"}).join(left, ["_begin", "_param"])
    back = pops.select(F.col("stmt").alias("_end"), F.col("val").alias("_last"), F.col("to_stmt").alias("_site"), "to_val")
    over = written(over.join(back, ["_end", "_last", "_site"]).select("stmt", "val", "kind", "sym", F.col("_site").alias("to_stmt"), "to_val").distinct())
    return over, [*tables, ways, acted, over]


def _shortened(p: Program, special: DataFrame, moved: DataFrame, edge: DataFrame, pops: DataFrame) -> DataFrame:
    """Rows like those of special for several of its steps: along straight runs on which a value stays where it is, and over calls of methods that
    a value goes through in a few steps, with one act on a field at most.

    Nothing is reached by them that is not reached step by step; what they leave out (longer or branching ways, calls within calls)
    is. A run has at most LEAP - 1 rows a level for a statement and value, so their number is in proportion to the program's.
    """
    inside = p.stmt.select("stmt", "method").distinct()
    named = special.select("stmt", "val").unionByName(special.filter("kind <> 'call_push'").select(F.col("to_stmt").alias("stmt"), F.col("to_val").alias("val"))).unionByName(moved.select("stmt", "val"))
    named = named.unionByName(special.filter("kind = 'call_push'").select(F.col("to_stmt").alias("stmt"), F.col("to_val").alias("val")))
    values = written(named.distinct().join(inside, "stmt").select("method", "val").distinct())
    below = values.filter(F.col("val").startswith(STATIC)).withColumnRenamed("method", "callee").join(p.call_edge.select("callee", "site").distinct(), "callee")
    values = values.unionByName(below.join(inside.withColumnRenamed("stmt", "site"), "site").select("method", "val")).distinct()
    steps = inside.join(edge, "stmt").join(values, "method").select("stmt", "via", "val").join(moved, ["stmt", "via", "val"], "left_anti")
    stays = steps.select("stmt", "val", F.lit("normal").alias("kind"), F.lit("").alias("sym"), F.col("via").alias("to_stmt"), F.col("val").alias("to_val"))
    stays = written(stays.unionByName(special.filter("kind = 'exclude' or kind = 'normal' and val = to_val").select(*ROW)).distinct())

    def single(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("stmt", "val").agg(F.count("*").alias("n"), F.min(F.struct("kind", "sym", "to_stmt", "to_val")).alias("r"))
        return per.filter("n = 1").select("stmt", "val", "r.*")

    alone = written(single(stays))
    over, more = None, []
    if has(p, "call_edge"):
        over, more = _over_calls(special, alone, pops)
        alike = over.filter("val = to_val and kind in ('normal', 'exclude')")
        if not alike.isEmpty():
            forget(alone)
            alone = written(single(stays.unionByName(alike).distinct()))
    runs, tables = _leaps(alone)
    out = reduce(DataFrame.unionByName, runs if over is None else [over, *runs])
    out = written(out.distinct())
    forget(values, stays, alone, *more, *tables)
    return out


def _flow(special: DataFrame, moved: DataFrame, edge: DataFrame, generic: Callable[[DataFrame], list[DataFrame]], returns, kept: list[DataFrame], blocked=None, shorten: Program | None = None) -> Flow:
    """Flow rows of nodes: those of special (stmt, val, kind, sym, to_stmt, to_val, via), which a program has for its own values; a
    plain step along every edge (stmt, via) on which moved (stmt, via, val) does not take the value; and generic(nodes) ones.

    All that depends on the program alone is joined once, so a round joins its nodes with two tables. With shorten, the program, also rows of several
    steps at once (_shortened()).
    """
    special, moved = written(special.distinct()), written(moved.distinct())
    if shorten is not None:
        whole = written(special.unionByName(_shortened(shorten, special, moved, edge, returns[1][0]).withColumn("via", F.col("to_stmt"))))
        forget(special)
        special = whole

    def rows(new: DataFrame) -> DataFrame:
        n = new.select("qid", "stmt", "val")
        own = n.join(special, ["stmt", "val"])
        stays = n.join(edge, "stmt").join(moved, ["stmt", "via", "val"], "left_anti")
        stays = stays.select("qid", F.lit("normal").alias("kind"), "stmt", "val", F.lit("").alias("sym"), F.col("via").alias("to_stmt"), F.col("val").alias("to_val"), "via")
        both = own.select(*FLOW, "via").unionByName(stays)
        if blocked is not None:
            qids, edges = blocked
            both = both.join(both.join(qids, "qid", "left_semi").join(edges, ["stmt", "via", "val"], "left_semi").select("qid", "stmt", "via", "val").distinct(), ["qid", "stmt", "via", "val"], "left_anti")
        return _union([both, *generic(n)])

    back, tables = returns
    return Flow(rows, back, kept, [special, moved, *tables])


def forward(p: Program, options: Options = Options(), nulls: DataFrame | None = None, held: DataFrame | None = None, shorten: bool = False) -> Flow:
    """Flow rows of new nodes (qid, stmt, val), forward. nulls (qid): queries of null, which take no edge that null does not. held
    (via, val): values that do not go past a statement, as its targets are not known yet. shorten: with rows of several steps at once, where all queries take
    the same edges."""
    fields = F.lit(options.track_fields) & ((F.col("field") != ARRAY) | F.lit(options.array_flows))
    edge = p.cfg_edge.select(F.col("src").alias("stmt"), F.col("dst").alias("via")).distinct().cache()
    kills = killed_values(p).select(F.col("stmt").alias("via"), "val")
    bodies = start_points(p).join(p.method.filter("has_body and not phantom and not native and not clinit"), "method", "left_semi").select(F.col("method").alias("callee"), F.col("stmt").alias("begin"))
    calls = p.call_edge.select(F.col("site").alias("via"), "callee").join(bodies, "callee").cache()
    passed = p.arg.select(F.col("stmt").alias("via"), "pos", "val").join(calls, "via").join(p.param.select(F.col("method").alias("callee"), "pos", F.col("val").alias("to")), ["callee", "pos"]).select("via", "val", "begin", "to").cache()
    exits = end_points(p).join(p.stmt.filter(F.col("kind") != "throw") if not options.throw_flows else p.stmt, ["stmt", "method"], "left_semi").select("stmt", F.col("method").alias("callee"))
    site = p.call_edge.select("site", "callee")
    returned = p.ret.join(exits, "stmt").join(site, "callee").join(p.call.filter("lhs is not null").select(F.col("stmt").alias("site"), F.col("lhs").alias("to")), "site").select("stmt", "val", "site", "to")
    given = exits.join(p.param.select(F.col("method").alias("callee"), "pos", "val"), "callee").join(site, "callee").join(p.arg.select(F.col("stmt").alias("site"), "pos", F.col("val").alias("to")), ["site", "pos"]).select("stmt", "val", "site", "to")
    gone = kills.unionByName(passed.select("via", "val"))
    gone = (gone if held is None else gone.unionByName(held.select("via", "val"))).distinct()
    overwritten = p.store.filter(fields & (F.col("field") != ARRAY)).select(F.col("stmt").alias("via"), F.col("base").alias("val"), "field")

    def along(rows: DataFrame, kind: str, sym, to) -> DataFrame:
        """Rows (via, val, ..) for every edge that leads to their statement."""
        return rows.join(edge, "via").select("stmt", "val", F.lit(kind).alias("kind"), (F.lit("") if sym is None else F.col(sym)).alias("sym"), F.col("via").alias("to_stmt"), F.col(to).alias("to_val"), "via")

    parts = [
        along(overwritten.join(gone, ["via", "val"], "left_anti"), "exclude", "field", "val"),
        along(p.assign.select(F.col("stmt").alias("via"), F.col("rhs").alias("val"), F.col("lhs").alias("to")), "normal", None, "to"),
        along(p.store.filter(fields).select(F.col("stmt").alias("via"), F.col("rhs").alias("val"), F.col("base").alias("to"), "field"), "field_push", "field", "to"),
        along(p.load.filter(fields).select(F.col("stmt").alias("via"), F.col("base").alias("val"), F.col("lhs").alias("to"), "field"), "field_pop", "field", "to"),
        # A callee without body does not take the value away; models tell what it copies.
        along(models(p).withColumnRenamed("succ", "via"), "normal", None, "to"),
        passed.join(edge, "via").select("stmt", "val", F.lit("call_push").alias("kind"), F.col("via").alias("sym"), F.col("begin").alias("to_stmt"), F.col("to").alias("to_val"), "via"),
    ]
    statics = options.static_flows and (has(p, "static_load") or has(p, "static_store"))
    if statics:
        to_static = p.static_store.select(F.col("stmt").alias("via"), F.col("rhs").alias("val"), F.concat(F.lit(STATIC), "field").alias("to"))
        from_static = p.static_load.select(F.col("stmt").alias("via"), F.concat(F.lit(STATIC), "field").alias("val"), F.col("lhs").alias("to"))
        parts.append(along(to_static.unionByName(from_static), "normal", None, "to"))
    special = parts[0]
    for x in parts[1:]:
        special = special.unionByName(x)
    begins = None
    if statics and has(p, "entry") and has(p, "method"):
        begins = initialiser_ends(p).select("stmt").crossJoin(F.broadcast(entry_points(p).select(F.col("stmt").alias("to_stmt")))).cache()  # a program's few entries

    def of_statics(n: DataFrame) -> list[DataFrame]:
        if not statics:
            return []
        s = n.filter(F.col("val").startswith(STATIC))
        into = s.join(edge, "stmt").join(calls, "via")
        out = [into.select("qid", F.lit("call_push").alias("kind"), "stmt", "val", F.col("via").alias("sym"), F.col("begin").alias("to_stmt"), F.col("val").alias("to_val"))]
        if begins is not None:
            out.append(_row(s.join(begins, "stmt"), "normal", None, "to_stmt", F.col("val")))
        return out

    blocked = None
    if nulls is not None:
        branches = p.null_branch.select("src", "dst", "val")
        if options.track_instance_of:
            branches = branches.unionByName(instance_branches(p))
        blocked = nulls.select("qid").distinct(), branches.select(F.col("src").alias("stmt"), F.col("dst").alias("via"), "val").distinct().cache()
    moved = gone.unionByName(overwritten.select("via", "val")).join(edge, "via").select("stmt", "via", "val")
    returns = _returns(returned.unionByName(given).withColumnsRenamed({"site": "to_stmt", "to": "to_val"}), exits, site.withColumnRenamed("site", "to_stmt"), statics)
    return _flow(special, moved, edge, of_statics, returns, [edge, calls, passed, *([] if begins is None else [begins]), *([] if blocked is None else [blocked[1]])], blocked, p if shorten and blocked is None else None)


def own_facts(p: Program, facts: DataFrame) -> DataFrame:
    """facts (.., stmt, val) without those of values that belong to another method than the statement; static ones and
    values that local does not list stay."""
    if not has(p, "local"):
        return facts
    owner = p.local.select("val", F.col("method").alias("_owner")).distinct()
    where = p.stmt.select("stmt", F.col("method").alias("_at"))
    both = facts.join(owner, "val", "left").join(where, "stmt", "left")
    return both.filter(F.col("_owner").isNull() | F.col("_at").isNull() | (F.col("_owner") == F.col("_at"))).select(*facts.columns)


def backward(p: Program, options: Options = Options()) -> Flow:
    """Flow rows of new nodes, backward: evaluated at the statement itself, towards its predecessors.

    Values of other methods are killed, then ignored methods left out, then calls, returns and plain statements looked at.
    """
    fields = F.lit(options.track_fields) & ((F.col("field") != ARRAY) | F.lit(options.array_flows))
    edge = p.cfg_edge.select(F.col("dst").alias("stmt"), F.col("src").alias("via")).distinct().cache()
    first = start_points(p).select("stmt", F.col("method").alias("callee"))
    site = p.call_edge.select("site", "callee")
    last = end_points(p).join(p.stmt.filter(F.col("kind") != "throw"), ["stmt", "method"], "left_semi").select(F.col("stmt").alias("end"), F.col("method").alias("callee"))
    ends_of_calls = site.withColumnRenamed("site", "stmt").join(last, "callee").cache()
    passed = p.arg.select("stmt", "pos", "val").join(ends_of_calls, "stmt").join(p.param.select(F.col("method").alias("callee"), "pos", F.col("val").alias("to")), ["callee", "pos"]).select("stmt", "val", "end", "to")
    result = p.call.filter("lhs is not null").select("stmt", F.col("lhs").alias("val")).join(ends_of_calls, "stmt").join(p.ret.select(F.col("stmt").alias("end"), F.col("val").alias("to")), "end").select("stmt", "val", "end", "to")
    into = passed.unionByName(result).distinct().cache()
    # The argument holds before the call: at the statements that lead to it.
    callers = first.join(site, "callee").join(edge.select(F.col("stmt").alias("site"), "via"), "site").cache()
    out_of = callers.join(p.param.select(F.col("method").alias("callee"), "pos", "val"), "callee").join(p.arg.select(F.col("stmt").alias("site"), "pos", F.col("val").alias("to")), ["site", "pos"])

    def along(rows: DataFrame, kind: str, sym, to) -> DataFrame:
        """Rows (stmt, val, ..) for every edge that leads back from their statement."""
        return rows.join(edge, "stmt").select("stmt", "val", F.lit(kind).alias("kind"), (F.lit("") if sym is None else F.col(sym)).alias("sym"), F.col("via").alias("to_stmt"), F.col(to).alias("to_val"), "via")

    parts = [
        along(p.assign.select("stmt", F.col("lhs").alias("val"), F.col("rhs").alias("to")), "normal", None, "to"),
        along(models(p).select(F.col("succ").alias("stmt"), F.col("to").alias("val"), F.col("val").alias("to")), "normal", None, "to"),
        along(p.load.filter(fields).select("stmt", F.col("lhs").alias("val"), F.col("base").alias("to"), "field"), "field_push", "field", "to"),
        along(p.store.filter(fields).select("stmt", F.col("base").alias("val"), F.col("rhs").alias("to"), "field"), "field_pop", "field", "to"),
        into.join(edge, "stmt").select("stmt", "val", F.lit("call_push").alias("kind"), F.col("via").alias("sym"), F.col("end").alias("to_stmt"), F.col("to").alias("to_val"), "via"),
    ]
    statics = options.static_flows and (has(p, "static_load") or has(p, "static_store"))
    if statics:
        load = p.static_load.select("stmt", F.col("lhs").alias("val"), F.concat(F.lit(STATIC), "field").alias("to"))
        store = p.static_store.select("stmt", F.concat(F.lit(STATIC), "field").alias("val"), F.col("rhs").alias("to"))
        parts.append(along(load.unionByName(store), "normal", None, "to"))
    special = parts[0]
    for x in parts[1:]:
        special = special.unionByName(x)
    initialisers = None
    if statics and options.static_fields_at_entry:
        ends = p.static_field.select(F.concat(F.lit(STATIC), "field").alias("val"), "cls").join(initialiser_ends(p).withColumnRenamed("stmt", "to_stmt"), "cls").select("val", "to_stmt")
        initialisers = entry_points(p).select("stmt"), ends

    def of_statics(n: DataFrame) -> list[DataFrame]:
        if not statics:
            return []
        s = n.filter(F.col("val").startswith(STATIC))
        down = s.join(edge, "stmt").join(ends_of_calls.select("stmt", "end").distinct(), "stmt")
        out = [down.select("qid", F.lit("call_push").alias("kind"), "stmt", "val", F.col("via").alias("sym"), F.col("end").alias("to_stmt"), F.col("val").alias("to_val"))]
        if initialisers is not None:
            starts, ends = initialisers
            out.append(_row(s.join(starts, "stmt", "left_semi").join(ends, "val"), "normal", None, "to_stmt", F.col("val")))
        return out

    moved = killed_values(p).select("stmt", "val").unionByName(into.select("stmt", "val")).join(edge, "stmt").select("stmt", "via", "val")
    returns = _returns(out_of.select("stmt", "val", F.col("via").alias("to_stmt"), F.col("to").alias("to_val")), first, callers.select(F.col("via").alias("to_stmt"), "callee"), statics)
    flow = _flow(special, moved, edge, of_statics, returns, [edge, ends_of_calls, into, callers])
    ignored = p.stmt.join(ignored_methods(p, throwables=options.track_throwables), "method", "left_semi").select("stmt") if options.track_throwables else None

    def own(new: DataFrame) -> DataFrame:
        n = own_facts(p, new.select("qid", "stmt", "val", *(c for c in new.columns if c == "fresh")))
        return n if ignored is None else n.join(ignored, "stmt", "left_anti")

    return Flow(lambda new: flow(own(new)), lambda nodes=None, open_calls=None, ended=None: flow.returns(None if nodes is None else own(nodes), open_calls, None if ended is None else own(ended)), flow.kept, flow.tables)
