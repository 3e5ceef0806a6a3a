"""Registered queries of the engine's operators over the driver's tables, each with DuckDB SQL.

The tables are read as program facts: a user is a method, its events are statements in order of time; an order
is an object whose field holds parts; nations and regions are types.
"""

from __future__ import annotations

import functools
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.functions import semiring as S
from pushgraph.functions import text as T
from pushgraph.operators import alias, closure, flows, language, pds, results, sync, typestate
from pushgraph.plans import stats
from pushgraph.session import shuffled, table, written
from pushgraph.sources import ir, sinks
from pushgraph.streaming import incremental

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def settled(f):
    """f's rows joined as its rounds are, and written: what is joined after the query has returned would be broadcast under the session's threshold,
    seeds and facts through the driver."""
    return functools.wraps(f)(shuffled(lambda spark, sf: written(f(spark, sf))))


def _statements(spark, sf) -> DataFrame:
    """Events as statements: ord by time, then id."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("stmt"), F.col("user_id").cast("string").alias("method"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("kind"))


def _program(spark, sf) -> ir.Program:
    s = _statements(spark, sf)
    calls = s.filter("kind = 'purchase'").select("stmt", F.lit(None).cast("string").alias("recv"), F.lit("f").alias("sig"), F.lit("static").alias("kind"), F.lit(None).cast("string").alias("lhs"))
    return ir.Program(spark, {"stmt": s, "cfg_edge": ir.straight_line_edges(s), "call": calls})


_NEXT = "SELECT event_id, user_id, event_type, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS next_type, lag(event_id) OVER w AS prv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("a3_cfg_successors", f"SELECT event_id::VARCHAR AS src, nxt::VARCHAR AS dst FROM ({_NEXT}) WHERE nxt IS NOT NULL")
def _(spark, sf):
    return ir.successors(_program(spark, sf))


@query("a4_cfg_predecessors", f"SELECT event_id::VARCHAR AS src, prv::VARCHAR AS dst FROM ({_NEXT}) WHERE prv IS NOT NULL")
def _(spark, sf):
    return ir.predecessors(_program(spark, sf))


@query("a5_start_and_end_points", f"SELECT event_id::VARCHAR AS stmt, user_id::VARCHAR AS method, 'start' AS point FROM ({_NEXT}) WHERE prv IS NULL UNION ALL SELECT event_id::VARCHAR, user_id::VARCHAR, 'end' FROM ({_NEXT}) WHERE nxt IS NULL")
def _(spark, sf):
    p = _program(spark, sf)
    return ir.start_points(p).withColumn("point", F.lit("start")).unionByName(ir.end_points(p).withColumn("point", F.lit("end")))


@query("a6_call_sites", "SELECT user_id::VARCHAR AS method, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS sites FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def _(spark, sf):
    return ir.call_sites(_program(spark, sf)).select("method", F.array_join("sites", ",").alias("sites"))


@query("a7_plain_points", f"SELECT event_id::VARCHAR AS stmt, user_id::VARCHAR AS method FROM ({_NEXT}) WHERE prv IS NOT NULL AND nxt IS NOT NULL AND event_type <> 'purchase'")
def _(spark, sf):
    p = _program(spark, sf)
    return ir.plain_start_points(p).intersect(ir.plain_end_points(p))


@query("a2_named_constants", "WITH s AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS n FROM events), e AS (SELECT *, unnest(range(n)) AS sub FROM s) SELECT CASE WHEN n = 2 AND sub = 0 THEN event_id || '$c' ELSE event_id::VARCHAR END AS stmt, user_id::VARCHAR AS method, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, sub) - 1 AS ord FROM e")
def _(spark, sf):
    rows = _statements(spark, sf).select("stmt", "method", "ord", F.lit("x").alias("lhs"), F.when(F.col("kind") == "purchase", "7").alias("const"))
    return ir.named_constants(rows).select("stmt", "method", "ord")


def _trade_edges(spark, sf) -> DataFrame:
    n, c, o, l, s = (table(spark, sf, t) for t in ("nation", "customer", "orders", "lineitem", "supplier"))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("caller"), F.concat(F.lit(b), y).alias("callee"))
    parts = [edge(n, "r", "n_regionkey", "n", "n_nationkey"), edge(c, "n", "c_nationkey", "c", "c_custkey"), edge(s, "n", "s_nationkey", "s", "s_suppkey"), edge(o, "c", "o_custkey", "o", "o_orderkey"), edge(l, "o", "l_orderkey", "p", "l_partkey")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumns({"site": F.col("caller"), "kind": F.lit("static")})


_TRADE = "edges AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem)"


@query("a15_reachable_methods", f"WITH RECURSIVE {_TRADE}, reach(method) AS (SELECT 'r2' UNION SELECT b FROM reach JOIN edges ON a = method) SELECT method FROM reach")
def _(spark, sf):
    p = ir.Program(spark, {"call_edge": _trade_edges(spark, sf)})
    return ir.reachable_methods(p, spark.createDataFrame([("r2",)], "method string"))


@query("e8_least_depth", f"WITH RECURSIVE {_TRADE}, reach(method, d) AS (SELECT 'r1', 0 UNION SELECT b, d + 1 FROM reach JOIN edges ON a = method) SELECT method, min(d)::INTEGER AS depth FROM reach GROUP BY method")
def _(spark, sf):
    e = _trade_edges(spark, sf).select(F.lit(1).cast("bigint").alias("qid"), F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return closure.depths(e, spark.createDataFrame([(1, "r1")], "qid long, node string")).select(F.col("node").alias("method"), "depth")


def _bigrams(spark, sf) -> DataFrame:
    """(qid, src, dst): types of neighbouring events of each user."""
    s = _statements(spark, sf)
    w = ir.Window.partitionBy("method").orderBy("ord")
    return s.select(F.col("method").cast("bigint").alias("qid"), F.col("kind").alias("src"), F.lead("kind").over(w).alias("dst")).filter("dst is not null").distinct()


_BI = f"bi AS (SELECT DISTINCT user_id::BIGINT AS qid, event_type AS src, next_type AS dst FROM ({_NEXT}) WHERE nxt IS NOT NULL)"


@query("d17_transitive_closure", f"WITH RECURSIVE {_BI}, tc(qid, src, dst) AS (SELECT * FROM bi UNION SELECT tc.qid, tc.src, bi.dst FROM tc JOIN bi ON tc.qid = bi.qid AND tc.dst = bi.src) SELECT * FROM tc")
def _(spark, sf):
    return closure.transitive_closure(_bigrams(spark, sf))


@query("f14_cycle_flag", f"WITH RECURSIVE {_BI}, up AS (SELECT * FROM bi WHERE src <> dst AND src <> 'view'), tc(qid, src, dst) AS (SELECT * FROM up UNION SELECT tc.qid, tc.src, up.dst FROM tc JOIN up ON tc.qid = up.qid AND tc.dst = up.src) SELECT qid, bool_or(src = dst) AS cyclic FROM tc GROUP BY qid")
def _(spark, sf):
    return closure.has_cycle(_bigrams(spark, sf).filter("src <> dst and src <> 'view'"))


def _rules(spark, sf) -> DataFrame:
    """A pushdown system for each user: signups push their successor over 'ret', errors pop, others go on."""
    b = _bigrams(spark, sf)
    kind = F.when(F.col("src") == "signup", "push").when(F.col("src") == "error", "pop").otherwise("normal")
    site = F.when(kind == "push", "view").otherwise("")
    return b.select("qid", kind.alias("kind"), F.lit("p").alias("s1"), F.col("src").alias("l1"), F.lit("p").alias("s2"), F.when(kind == "pop", "").otherwise(F.col("dst")).alias("l2"), site.alias("site"), F.lit(1).cast("bigint").alias("w")).distinct()


def _starts(spark, sf) -> DataFrame:
    users = table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("qid")).distinct()
    return users.select("qid", F.lit("p").alias("src"), F.lit("signup").alias("label"), F.lit("ACC").alias("dst"), F.lit(0).cast("bigint").alias("w"))


_PDS = f"""WITH RECURSIVE {_BI},
rules AS (SELECT DISTINCT qid, CASE src WHEN 'signup' THEN 'push' WHEN 'error' THEN 'pop' ELSE 'normal' END AS kind, src AS l1, CASE WHEN src = 'error' THEN '' ELSE dst END AS l2 FROM bi),
t(qid, src, label, dst, w) USING KEY (qid, src, label, dst) AS (
  SELECT DISTINCT user_id::BIGINT, 'p', 'signup', 'ACC', 0::BIGINT FROM events
  UNION
  SELECT n.qid, n.src, n.label, n.dst, n.w FROM (
    SELECT qid, src, label, dst, min(w)::BIGINT AS w FROM (
      SELECT t.qid, 'p' AS src, l2 AS label, dst, w + 1 AS w FROM t JOIN rules r ON r.qid = t.qid AND t.src = 'p' AND r.l1 = t.label AND kind = 'normal' AND r.l2 <> r.l1
      UNION ALL SELECT t.qid, '<p|' || l2 || '>', 'view', dst, w + 1 FROM t JOIN rules r ON r.qid = t.qid AND t.src = 'p' AND r.l1 = t.label AND kind = 'push'
      UNION ALL SELECT t.qid, 'p', l2, '<p|' || l2 || '>', 0 FROM t JOIN rules r ON r.qid = t.qid AND t.src = 'p' AND r.l1 = t.label AND kind = 'push'
      UNION ALL SELECT t.qid, 'p', 'eps', dst, w + 1 FROM t JOIN rules r ON r.qid = t.qid AND t.src = 'p' AND r.l1 = t.label AND kind = 'pop' AND dst LIKE '<%'
      UNION ALL SELECT a.qid, a.src, b.label, b.dst, a.w + b.w FROM t a JOIN recurring.t b ON a.qid = b.qid AND a.dst = b.src AND a.label = 'eps' AND b.label <> 'eps'
      UNION ALL SELECT a.qid, a.src, b.label, b.dst, a.w + b.w FROM recurring.t a JOIN t b ON a.qid = b.qid AND a.dst = b.src AND a.label = 'eps' AND b.label <> 'eps'
    ) c GROUP BY ALL HAVING TRUE) n
  LEFT JOIN recurring.t o ON o.qid = n.qid AND o.src = n.src AND o.label = n.label AND o.dst = n.dst
  WHERE o.w IS NULL OR n.w < o.w)
"""
_PDS = _PDS.replace("GROUP BY ALL HAVING TRUE", "GROUP BY qid, src, label, dst")


@query("d1_post_star", _PDS + "SELECT qid, src, label, dst FROM t")
def _(spark, sf):
    return pds.post_star(_rules(spark, sf), _starts(spark, sf)).total.select("qid", "src", "label", "dst")


@query("e8_min_plus_post_star", _PDS + "SELECT qid, src, label, dst, w FROM t")
def _(spark, sf):
    return pds.post_star(_rules(spark, sf), _starts(spark, sf), S.MIN_PLUS).total.select("qid", "src", "label", "dst", "w")


@query("e5_ordered_paths", f"WITH RECURSIVE {_BI}, up AS (SELECT * FROM bi WHERE src < dst), walk(qid, node, labels, last) AS (SELECT DISTINCT qid, 'click', []::VARCHAR[], NULL::VARCHAR FROM bi UNION SELECT walk.qid, up.dst, list_sort(list_distinct(list_append(labels, up.src || '>' || up.dst))), up.src || '>' || up.dst FROM walk JOIN up ON up.qid = walk.qid AND up.src = node) SELECT qid, node, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS names, max(last) AS last FROM walk GROUP BY qid, node")
def _(spark, sf):
    """Ways from clicks up the types in order: all steps of them, and the greatest that one ends with."""
    up = _bigrams(spark, sf).filter("src < dst")
    step, p = F.concat("src", F.lit(">"), "dst"), F.lit("p")
    rules = up.select("qid", F.lit("normal").alias("kind"), p.alias("s1"), F.col("src").alias("l1"), p.alias("s2"), F.col("dst").alias("l2"), F.lit("").alias("site"), F.struct(F.array(step).alias("names"), step.alias("last")).alias("w"))
    start = _bigrams(spark, sf).select("qid").distinct().select("qid", p.alias("src"), F.lit("click").alias("label"), F.lit("ACC").alias("dst"), S.ORDERED_PATH.one().alias("w"))
    found = pds.post_star(rules, start, S.ORDERED_PATH).total
    return found.select("qid", F.col("label").alias("node"), F.array_join("w.names", ",").alias("names"), F.col("w.last").alias("last"))


_PRE = f"""WITH RECURSIVE {_BI},
rules AS (SELECT DISTINCT qid, CASE src WHEN 'signup' THEN 'push' WHEN 'error' THEN 'pop' ELSE 'normal' END AS kind, src AS l1, CASE WHEN src = 'error' THEN '' ELSE dst END AS l2 FROM bi),
users AS (SELECT DISTINCT user_id::BIGINT AS qid FROM events),
t(qid, src, label, dst) USING KEY (qid, src, label, dst) AS (
  (SELECT qid, 'p', 'signup', 'ACC' FROM users UNION SELECT qid, 'q', unnest(['view', 'error']), 'ACC' FROM users UNION SELECT qid, 'p', l1, 'p' FROM rules WHERE kind = 'pop')
  UNION
  SELECT n.* FROM (
    SELECT t.qid, 'p' AS src, l1 AS label, dst FROM t JOIN rules r ON r.qid = t.qid AND t.src = 'p' AND r.l2 = t.label AND kind = 'normal'
    UNION SELECT t.qid, 'p', t.label, t.dst FROM t WHERE t.src = 'q' AND t.label <> 'error'
    UNION SELECT a.qid, 'p', r.l1, b.dst FROM t a JOIN rules r ON r.qid = a.qid AND a.src = 'p' AND r.l2 = a.label AND kind = 'push' JOIN recurring.t b ON b.qid = a.qid AND b.src = a.dst AND b.label = 'view'
    UNION SELECT a.qid, 'p', r.l1, b.dst FROM recurring.t a JOIN rules r ON r.qid = a.qid AND a.src = 'p' AND r.l2 = a.label AND kind = 'push' JOIN t b ON b.qid = a.qid AND b.src = a.dst AND b.label = 'view') n
  LEFT JOIN recurring.t o ON o.qid = n.qid AND o.src = n.src AND o.label = n.label AND o.dst = n.dst WHERE o.qid IS NULL)
"""


@query("d9_pre_star", _PRE + "SELECT qid, src, label, dst FROM t")
def _(spark, sf):
    users = _starts(spark, sf)
    more = users.select("qid", F.lit("q").alias("src"), F.explode(F.array(F.lit("view"), F.lit("error"))).alias("label"), "dst", "w")
    # p goes to q on any label but error, which it keeps.
    wild = users.select("qid", F.lit("normal").alias("kind"), F.lit("p").alias("s1"), F.lit("*").alias("l1"), F.lit("q").alias("s2"), F.lit("not:error").alias("l2"), F.lit("").alias("site"), F.lit(1).cast("bigint").alias("w"))
    return pds.pre_star(_rules(spark, sf).unionByName(wild), users.unionByName(more)).total.select("qid", "src", "label", "dst")


@query("d12_synchronised", "WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), d AS (SELECT *, coalesce(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM t) SELECT qid, stmt FROM (SELECT conv_id AS qid, turn::VARCHAR AS stmt, min(depth) OVER (PARTITION BY conv_id ORDER BY n) AS low FROM d) WHERE low >= 0")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), "turn", "role")
    w = ir.Window.partitionBy("qid").orderBy("turn")
    c = c.withColumns({"to": F.lead("turn").over(w), "n": F.row_number().over(w)})
    kind = F.when(F.col("role") == "user", "field_push").when(F.col("role") == "assistant", "field_pop").otherwise("normal")
    flow = c.filter("to is not null").select("qid", kind.alias("kind"), F.col("turn").cast("string").alias("stmt"), F.lit("x").alias("val"), F.when(F.col("role").isin("user", "assistant"), "f").otherwise("").alias("sym"), F.col("to").cast("string").alias("to_stmt"), F.lit("x").alias("to_val"))
    seeds = c.filter("n = 1").select("qid", F.col("turn").cast("string").alias("stmt"), F.lit("x").alias("val"))
    return sync.synchronised(seeds, flow)[0].select("qid", "stmt")


@query("f19_budgets", "SELECT conv_id AS qid, count(*) > 5 AS exhausted, CASE WHEN count(*) <= 5 THEN count(*) END AS reached FROM conversations GROUP BY conv_id")
def _(spark, sf):
    """Conversations as chains of turns, each a query of four rounds at most: longer ones are given up, the others are whole."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), "turn")
    w = ir.Window.partitionBy("qid").orderBy("turn")
    c = c.withColumns({"to": F.lead("turn").over(w), "n": F.row_number().over(w)})
    text, x = (lambda name: F.col(name).cast("string")), F.lit("x")
    flow = c.filter("to is not null").select("qid", F.lit("normal").alias("kind"), text("turn").alias("stmt"), x.alias("val"), F.lit("").alias("sym"), text("to").alias("to_stmt"), x.alias("to_val"))
    told = {}
    reached, _, _ = sync.synchronised(c.filter("n = 1").select("qid", text("turn").alias("stmt"), x.alias("val")), flow, budget=sync.Budget(rounds=4), listen=lambda name, rows: told.update({name: rows}))
    whole = reached.groupBy("qid").agg(F.count("*").alias("n")).join(told["exhausted"].select("qid", F.lit(True).alias("over")), "qid", "left")
    over = F.coalesce("over", F.lit(False))
    return whole.select("qid", over.alias("exhausted"), F.when(~over, F.col("n")).alias("reached"))


_MOVES = [("INIT", "signup", "OPEN"), ("OPEN", "view", "USED"), ("USED", "purchase", "CLOSED"), ("CLOSED", "view", "ERROR"), ("CLOSED", "error", "INIT"), ("ERROR", "signup", "OPEN")]
_FOLD = f"""WITH RECURSIVE m(a, n, b) AS (VALUES {', '.join(str(x) for x in _MOVES)}),
ev AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
run(user_id, i, s) AS (SELECT DISTINCT user_id, 0::BIGINT, 'INIT' FROM events
  UNION ALL SELECT run.user_id, ev.i, coalesce(m.b, run.s) FROM run JOIN ev ON ev.user_id = run.user_id AND ev.i = run.i + 1 LEFT JOIN m ON m.a = run.s AND m.n = ev.event_type)
"""


@query("d35_fold_machine", _FOLD + "SELECT user_id AS qid, arg_max(s, i) AS state, bool_or(s = 'ERROR') AS error FROM run GROUP BY user_id")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("name"))
    found = typestate.fold_machine(e, spark.createDataFrame(_MOVES, "src string, name string, dst string"), "INIT")
    return found.select("qid", "state", F.array_contains("visited", "ERROR").alias("error"))


def _trade_program(spark, sf) -> ir.Program:
    """order o = new; part p = new; o.item = p; customer c = o; nation n = c.item."""
    c, o, l = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    name = lambda a, x: F.concat(F.lit(a), x.cast("string"))
    none = F.lit(None).cast("string")
    new = lambda df, a, x, t: df.select(name(a, F.col(x)).alias("stmt"), name(a, F.col(x)).alias("val"), F.lit(t).alias("type"), F.lit("new").alias("kind"), none.alias("const")).distinct()
    return ir.Program(spark, {
        "alloc": new(o, "o", "o_orderkey", "order").unionByName(new(l, "p", "l_partkey", "part")),
        "store": l.select(F.lit("").alias("stmt"), name("o", F.col("l_orderkey")).alias("base"), F.lit("item").alias("field"), name("p", F.col("l_partkey")).alias("rhs")).distinct(),
        "assign": o.select(F.lit("").alias("stmt"), name("c", F.col("o_custkey")).alias("lhs"), name("o", F.col("o_orderkey")).alias("rhs")).distinct(),
        "load": c.select(F.lit("").alias("stmt"), name("n", F.col("c_nationkey")).alias("lhs"), name("c", F.col("c_custkey")).alias("base"), F.lit("item").alias("field")).distinct(),
    })


_BOUGHT = "SELECT DISTINCT c_nationkey AS n, l_partkey AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


@query("f1_flow_insensitive", f"SELECT 'n' || n AS val, 'p' || p AS alloc FROM ({_BOUGHT})")
def _(spark, sf):
    points, _ = alias.flow_insensitive(_trade_program(spark, sf))
    return points.filter(F.col("val").startswith("n"))


@query("d20_flow_insensitive_heap", "SELECT DISTINCT 'o' || l_orderkey AS base, 'item' AS field, 'p' || l_partkey AS alloc FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark, sf):
    return alias.flow_insensitive(_trade_program(spark, sf))[1]


@query("d27_dispatch", "SELECT 's' || s_suppkey AS site, CASE WHEN s_suppkey % 5 = 0 THEN 'S' || s_suppkey WHEN n_nationkey % 2 = 0 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END AS method FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    name = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    up = s.select(name("s", "s_suppkey").alias("sub"), name("n", "s_nationkey").alias("sup")).unionByName(n.select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup")))
    has = lambda df, t, m, x: df.select(name(t, x).alias("type"), F.lit("go()").alias("sig"), name(m, x).alias("method"))
    table_rows = has(s.filter("s_suppkey % 5 = 0"), "s", "S", "s_suppkey").unionByName(has(n.filter("n_nationkey % 2 = 0"), "n", "N", "n_nationkey")).unionByName(has(n.select("n_regionkey").distinct(), "r", "R", "n_regionkey"))
    p = ir.Program(spark, {"subtype": up, "vtable": table_rows})
    return ir.dispatch(p, s.select(name("s", "s_suppkey").alias("site"), name("s", "s_suppkey").alias("type"), F.lit("go()").alias("sig"))).select("site", "method")


@query("b17_subtypes", "SELECT 'n' || n_nationkey AS sub, 'r' || n_regionkey AS sup FROM nation UNION SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey, 'r' || n_regionkey FROM nation UNION SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    name = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    up = s.select(name("s", "s_suppkey").alias("sub"), name("n", "s_nationkey").alias("sup")).unionByName(n.select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup")))
    return ir.subtype_closure(ir.Program(spark, {"subtype": up}))


@query("b16_method_matcher", "SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_type, '.*(A|B|E).*')")
def _(spark, sf):
    return table(spark, sf, "part").filter(T.full_match(F.col("p_type"), ".*(A|B|E).*")).select("p_partkey", "p_name")


@query("e4_inference_sets", "SELECT user_id AS qid, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.array("event_type").alias("w"))
    return e.groupBy("qid").agg(F.array_join(S.INFERENCE.combine(F.col("w")), ",").alias("types"))


@query("e7_num_weights", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(length(o_orderpriority)) END AS w FROM (SELECT o_custkey, length(o_orderpriority) AS o_orderpriority FROM orders) GROUP BY o_custkey".replace("min(length(o_orderpriority))", "min(o_orderpriority)::BIGINT"))
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.length("o_orderpriority").cast("bigint").alias("w"))
    return o.groupBy("o_custkey").agg(S.NUM.combine(F.col("w")).alias("w"))


@query("h1_access_paths", "SELECT p_partkey, p_brand AS base, 'f' || p_size || ',' || p_type AS fields, p_size % 2 = 0 AS approx, p_brand || '[f' || p_size || ',' || p_type || ']' || CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END AS printed FROM part")
def _(spark, sf):
    text = F.concat(F.lit(" "), "p_brand", F.lit("[f"), "p_size", F.lit(" , "), "p_type", F.lit("]"), F.when(F.col("p_size") % 2 == 0, "*").otherwise(""), F.lit(" ;"))
    paths = table(spark, sf, "part").select("p_partkey", F.explode(T.parse_access_paths(text)).alias("p"))
    return paths.select("p_partkey", F.col("p.base").alias("base"), F.array_join("p.fields", ",").alias("fields"), F.col("p.approx").alias("approx"), T.access_path_text(F.col("p")).alias("printed"))


@query("h7_escaped_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"))


@query("h8_interned", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM part")
def _(spark, sf):
    return T.interned(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", F.col("id").cast("bigint").alias("id"))


@query("g2_top_methods", "SELECT user_id::VARCHAR AS method, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, method LIMIT 11")
def _(spark, sf):
    return stats.top_methods(_statements(spark, sf))


@query("g3_query_spread", "WITH p AS (SELECT user_id AS qid, count(*) AS n FROM events GROUP BY user_id) SELECT min(n) AS least, avg(n) AS mean, max(n) AS most, (SELECT qid FROM p ORDER BY n DESC, qid LIMIT 1) AS largest FROM p")
def _(spark, sf):
    return stats.query_spread(table(spark, sf, "events").select(F.col("user_id").alias("qid")))


@query("g5_only_one_system", "WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT (SELECT count(*) FROM f ANTI JOIN c USING (user_id)) AS field_only, (SELECT count(*) FROM c ANTI JOIN f USING (user_id)) AS call_only")
def _(spark, sf):
    s = _statements(spark, sf)
    return stats.only_one_system(s.filter("kind = 'signup'"), s.filter("kind = 'error'"))


@query("m2_collisions", "SELECT count(*) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS n_distinct, count(*) - count(DISTINCT (l_partkey, l_suppkey)) AS collisions FROM lineitem")
def _(spark, sf):
    return stats.collisions(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("m4_graph_edges", f"SELECT (SELECT count(*) FROM ({_NEXT}) WHERE nxt IS NOT NULL) + 2 * (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) AS n")
def _(spark, sf):
    return stats.graph_edges(_program(spark, sf).cfg_edge, table(spark, sf, "orders").select("o_custkey", "o_orderkey")).select(F.col("n").cast("bigint").alias("n"))


@query("m6_call_graph_metrics", "WITH p AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS t FROM lineitem GROUP BY 1) SELECT count(*) AS sites, sum(t)::BIGINT AS edges, avg(t) AS mean_targets, max(t) AS most_targets, count(*) FILTER (t = 1) AS single FROM p")
def _(spark, sf):
    return stats.call_graph_metrics(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("callee")))


@query("l1_dot_lines", f"WITH {_BI} SELECT qid, format('\"{{}}\" -> \"{{}}\" [label=\"{{}}\"];', src, dst, string_agg(DISTINCT upper(dst), ',' ORDER BY upper(dst))) AS line FROM bi GROUP BY qid, src, dst")
def _(spark, sf):
    return sinks.dot_lines(_bigrams(spark, sf).withColumn("label", F.upper("dst")))


@query("l2_graph_json", f"WITH {_BI} SELECT DISTINCT qid, 'node' AS part, n AS a, upper(n) AS b FROM (SELECT qid, unnest([src, dst]) AS n FROM bi) UNION ALL SELECT qid, 'edge', src, dst FROM bi")
def _(spark, sf):
    b = _bigrams(spark, sf)
    nodes = b.select("qid", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.upper("id"))
    read = sinks.graph_json(nodes, b).select("qid", F.from_json("json", "nodes array<struct<id:string,label:string>>, edges array<struct<src:string,dst:string>>").alias("g"))
    part = lambda name, a, b: F.transform(F.col(f"g.{name}s"), lambda x: F.struct(F.lit(name).alias("part"), x[a].alias("a"), x[b].alias("b")))
    return read.select("qid", F.explode(F.concat(part("node", "id", "label"), part("edge", "src", "dst"))).alias("p")).select("qid", "p.*")


@query("l5_geometric_mean", "SELECT round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean FROM orders WHERE o_totalprice > 0")
def _(spark, sf):
    return stats.geometric_mean(table(spark, sf, "orders"), "o_totalprice").select(F.round("geometric_mean", 4).alias("geometric_mean"))


@query("f17_longest_label_path", f"WITH RECURSIVE {_BI}, up AS (SELECT * FROM bi WHERE src < dst), walk(qid, node, labels) AS (SELECT DISTINCT qid, 'click', []::VARCHAR[] FROM bi UNION SELECT walk.qid, up.dst, list_sort(list_append(labels, up.src || '>' || up.dst)) FROM walk JOIN up ON up.qid = walk.qid AND up.src = node) SELECT qid, array_to_string(arg_max(labels, len(labels) || ' ' || array_to_string(labels, ',')), ',') AS labels FROM walk GROUP BY qid")
def _(spark, sf):
    b = _bigrams(spark, sf)
    start = b.select("qid").distinct().select("qid", F.lit("click").alias("node"))
    return closure.longest_label_path(b.withColumn("label", F.concat("src", F.lit(">"), "dst")).filter("src < dst"), start).select("qid", F.array_join("labels", ",").alias("labels"))


@query("a10_whole_program_seeds", "SELECT event_id::VARCHAR AS stmt, user_id::VARCHAR AS method FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    p = _program(spark, sf)
    none = F.lit(None).cast("string")
    p.tables["alloc"] = p.stmt.filter("kind = 'signup'").select("stmt", F.concat(F.lit("v"), "stmt").alias("val"), F.lit("T").alias("type"), F.lit("new").alias("kind"), none.alias("const"))
    entries = p.stmt.select("method").distinct()
    return ir.whole_program_seeds(p, entries).select("stmt").join(p.stmt.select("stmt", "method"), "stmt")


@query("c1_forward_identity", f"SELECT event_id::VARCHAR AS stmt, event_type AS val, nxt::VARCHAR AS to_stmt FROM ({_NEXT}) WHERE nxt IS NOT NULL AND next_type <> event_type")
def _(spark, sf):
    p = _program(spark, sf)
    none = F.lit(None).cast("string")
    p.tables["alloc"] = p.stmt.select("stmt", F.col("kind").alias("val"), F.lit("T").alias("type"), F.lit("new").alias("kind"), none.alias("const"))
    nodes = p.stmt.select(F.lit(1).cast("bigint").alias("qid"), "stmt", F.col("kind").alias("val"))
    return flows.forward(p)(nodes).select("stmt", "val", "to_stmt")


@query("b9_type_filter", "SELECT s_suppkey AS qid, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    name = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    up = s.select(name("s", "s_suppkey").alias("sub"), name("n", "s_nationkey").alias("sup")).unionByName(n.select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("sup")))
    subtypes = ir.subtype_closure(ir.Program(spark, {"subtype": up}))
    # Every supplier is asked whether it can be each of the regions.
    regions = r.agg(F.collect_set("r_regionkey").alias("regions"))
    facts = s.select(F.col("s_suppkey").alias("qid")).join(F.broadcast(regions)).select("qid", F.explode("regions").alias("region")).withColumn("declared", name("r", "region"))
    types = s.select(F.col("s_suppkey").alias("qid"), name("s", "s_suppkey").alias("type"))
    return results.type_filter(facts, types, subtypes).select("qid", "region")


@query("d29_callers", "SELECT o_orderkey AS site, o_custkey AS callee FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_custkey").alias("callee"), "o_orderpriority")
    return results.callers(o.filter("o_orderpriority = '1-URGENT'"), o, table(spark, sf, "customer").select(F.col("c_custkey").alias("method")))


_WORDS = [""] + [" ".join(w) + " " for n in (1, 2, 3) for w in itertools.product("cepsv", repeat=n)]


@query("f15_languages", f"WITH RECURSIVE {_BI}, walk(qid, node, word, n) AS (SELECT DISTINCT qid, 'click', '', 0 FROM bi UNION SELECT walk.qid, dst, word || dst[1] || ' ', n + 1 FROM walk JOIN bi ON bi.qid = walk.qid AND bi.src = node WHERE n < 3) SELECT DISTINCT qid, word FROM walk WHERE node = 'view'")
def _(spark, sf):
    """Words of three labels at most that each user's expression accepts."""
    b = _bigrams(spark, sf).withColumn("label", F.substring("dst", 1, 1))
    found = language.languages(b, b.select("qid").distinct().withColumns({"start": F.lit("click"), "final": F.lit("view")})).filter("regex is not null")

    def accepted(batches):
        for batch in batches:
            rows = [(q, w) for q, r in zip(batch["qid"], batch["regex"], strict=True) for p in [language.to_python(r)] for w in _WORDS if p.fullmatch(w)]
            yield pd.DataFrame(rows, columns=["qid", "word"])

    return found.select("qid", "regex").mapInPandas(accepted, "qid long, word string")


@query("h4_short_labels", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'x' || user_id || ' = new T' WHEN 'purchase' THEN 'x' || user_id || ' = m()' WHEN 'click' THEN 'x' || user_id || ' = y.f' WHEN 'view' THEN 'x' || user_id || '.f = y' ELSE 'return y' END AS label FROM events")
def _(spark, sf):
    kinds = F.create_map(*(F.lit(x) for x in ("signup", "alloc", "purchase", "call", "click", "load", "view", "store", "error", "return")))
    rhs = F.when(F.col("event_type") == "signup", "T").when(F.col("event_type") == "purchase", "m").otherwise("y")
    e = table(spark, sf, "events").withColumns({"lhs": F.concat(F.lit("x"), "user_id"), "rhs": rhs, "kind": kinds[F.col("event_type")]})
    return e.select("event_id", T.short_label(F.col("kind"), F.col("lhs"), F.col("rhs"), F.lit("f")).alias("label"))


@query("i1_incremental_closure", ORACLES["d17_transitive_closure"])
def _(spark, sf):
    b, c = _bigrams(spark, sf), incremental.IncrementalClosure()
    for part in (0, 1):  # two batches, split by the edges' starts
        c.add(b.filter(F.col("src").isin("click", "view") == F.lit(bool(part))))
    return c.pairs


# Conversations as code: a conversation is a method, its turns are statements; the first turn, and those whose text's length leaves 0,
# are v = new T; other remainders are w = v, w.f = v, x = w.f, calls on v and calls on w.
_KINDS = ("new", "assign", "store", "load", "on_v", "on_w")
_TYPES = ("T0", "T1", "T2")


def _turns(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    size = F.octet_length("text")
    first = F.col("turn") == F.min("turn").over(ir.Window.partitionBy("conv_id"))
    kind = F.when(first, "new").otherwise(F.element_at(F.array(*map(F.lit, _KINDS)), (size % 6 + 1).cast("int")))
    name = lambda a: F.concat(F.lit(a), "conv_id")
    return c.select(F.concat(name("c"), F.lit(":"), "turn").alias("stmt"), name("c").alias("method"), F.col("turn").cast("long").alias("ord"), kind.alias("kind"), F.floor(size / 6).cast("int").alias("n"), name("v").alias("v"), name("w").alias("w"), name("x").alias("x"))


def _code(spark, sf, types=_TYPES, calls=("go()",), results=()) -> ir.Program:
    """The program; allocations take types, calls take signatures in turn. results: (type, signature) of types that a call makes."""
    t = written(_turns(spark, sf))
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), F.pmod("n", F.lit(len(names))) + 1)
    of = lambda kind, *cols: t.filter(F.col("kind").isin(*kind.split())).select("stmt", *cols)
    none = F.lit(None).cast("string")
    alloc = of("new", F.col("v").alias("val"), pick(types).alias("type"), F.lit("new").alias("kind"), none.alias("const"))
    call = of("on_v on_w", F.when(F.col("kind") == "on_v", F.col("v")).otherwise(F.col("w")).alias("recv"), pick(calls).alias("sig"), F.lit("virtual").alias("kind"), none.alias("lhs"))
    if results:
        made = alloc.join(F.broadcast(spark.createDataFrame(results, "type string, sig string")), "type")
        call = call.unionByName(made.select("stmt", none.alias("recv"), "sig", F.lit("static").alias("kind"), F.col("val").alias("lhs")))
    return ir.Program(spark, {
        "stmt": t.select("stmt", "method", "ord", "kind"), "cfg_edge": ir.straight_line_edges(t), "alloc": alloc, "call": call,
        "assign": of("assign", F.col("w").alias("lhs"), F.col("v").alias("rhs")), "store": of("store", F.col("w").alias("base"), F.lit("f").alias("field"), F.col("v").alias("rhs")),
        "load": of("load", F.col("x").alias("lhs"), F.col("w").alias("base"), F.lit("f").alias("field")),
    })


_SOLVED = {}


def _there(df: DataFrame) -> bool:
    """Whether the files that df is read from still exist."""
    context = df.sparkSession.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(x.getFileSystem(context._jsc.hadoopConfiguration()).exists(x) for x in paths)


def _solved(spark, sf, code=None) -> alias.Solution:
    """The program's solution, which the rows of one session share as long as the conversations' files stay the same."""
    code = code or _code
    files = table(spark, sf, "conversations").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h")).first()["h"]
    key = (spark.sparkContext.applicationId, code.__name__, sf, state)
    s = _SOLVED.get(key)
    if s is None or not all(_there(t) for t in (s.seeds, s.points, s.reached, s.fields, s.calls, s.heap)):
        _SOLVED[key] = s = alias.solve(code(spark, sf))
    return s


def _asked(p: ir.Program, *names: str) -> DataFrame:
    """(query, stmt, val): the named values at every statement."""
    val = F.explode(F.array(*(F.concat(F.lit(n), F.substring("method", 2, 99)) for n in names))).alias("val")
    return p.stmt.select("stmt", val).select(F.concat_ws("|", "stmt", "val").alias("query"), "stmt", "val")


# Each statement with what v and w hold before and after it, by the statement that allocated it; folded in order, what field f of v's and
# of w's object holds as the variables know it: a store through w replaces what w knows, and adds to what v knows if both are one object.
_HELD = """WITH RECURSIVE k AS (SELECT conv_id AS c, turn AS t, strlen(text) // 6 AS n, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'new' ELSE (['new', 'assign', 'store', 'load', 'on_v', 'on_w'])[strlen(text) % 6 + 1] END AS kind FROM conversations),
v AS (SELECT *, last_value(CASE WHEN kind = 'new' THEN t END IGNORE NULLS) OVER (PARTITION BY c ORDER BY t) AS va, last_value(CASE WHEN kind = 'new' THEN t END IGNORE NULLS) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS vb FROM k),
w AS (SELECT *, last_value(CASE WHEN kind = 'assign' THEN vb END IGNORE NULLS) OVER (PARTITION BY c ORDER BY t) AS wa, last_value(CASE WHEN kind = 'assign' THEN vb END IGNORE NULLS) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wb, row_number() OVER (PARTITION BY c ORDER BY t) AS i FROM v),
folded(c, i, vf, wf, x) AS (
  SELECT DISTINCT c, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM k
  UNION ALL
  SELECT w.c, w.i, CASE WHEN kind = 'new' THEN [] WHEN kind = 'store' AND vb = wb THEN list_distinct(list_append(vf, vb)) ELSE vf END,
    CASE kind WHEN 'assign' THEN vf WHEN 'store' THEN [vb] ELSE wf END, CASE WHEN kind = 'load' THEN wf ELSE x END
  FROM folded JOIN w ON w.c = folded.c AND w.i = folded.i + 1),
held AS (SELECT w.*, folded.x AS xs FROM w JOIN folded ON folded.c = w.c AND folded.i = w.i),
heap AS (SELECT DISTINCT c, wb AS a, vb AS o FROM held WHERE kind = 'store' AND wb IS NOT NULL),
points AS (SELECT c, t, 'v' AS x, va AS o FROM held WHERE va IS NOT NULL UNION ALL SELECT c, t, 'w', wa FROM held WHERE wa IS NOT NULL UNION ALL SELECT c, t, 'x', unnest(xs) FROM held)
"""
_OF = "'c' || p.c || ':' || p.o"


@query("f1_points_to", _HELD + f"SELECT 'c' || c || ':' || t AS stmt, x || c AS val, {_OF} AS alloc_stmt FROM points p")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    asked = _asked(s.program, "v", "w", "x")
    return alias.points_to(s, asked).join(asked, "query").select("stmt", "val", "alloc_stmt")


@query("d24_backward_points_to", _HELD + f"SELECT 'x' || p.c AS val, {_OF} AS alloc_stmt, (['T0', 'T1', 'T2'])[a.n % 3 + 1] AS type FROM points p JOIN k a ON a.c = p.c AND a.t = p.o WHERE x = 'x' AND p.t = (SELECT max(t) FROM k WHERE k.c = p.c)")
@settled
def _(spark, sf):
    """What x holds at each method's end, asked backwards: only the allocations that can matter are solved."""
    p = _code(spark, sf)
    asked = _asked(p, "x").join(ir.end_points(p).select("stmt"), "stmt", "left_semi")
    return alias.answers(alias.backward_solve(p, asked), asked).join(asked, "query").select("val", "alloc_stmt", "type")


@query("f2_may_alias", _HELD + "SELECT 'c' || k.c || ':' || k.t AS stmt, EXISTS (SELECT 1 FROM points a JOIN points b ON a.c = b.c AND a.t = b.t AND a.o = b.o WHERE a.c = k.c AND a.t = k.t AND a.x = 'x' AND b.x = 'v') AS alias FROM k")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    pairs = _asked(s.program, "x").select("query", "stmt", "val", F.col("stmt").alias("other_stmt"), F.concat(F.lit("v"), F.substring("val", 2, 99)).alias("other"))
    return alias.may_alias(s, pairs).select("stmt", "alias")


@query("f5_possible_types", _HELD + "SELECT DISTINCT 'c' || p.c || ':' || p.t AS stmt, (['T0', 'T1', 'T2'])[a.n % 3 + 1] AS type FROM points p JOIN k a ON a.c = p.c AND a.t = p.o WHERE x = 'x'")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    asked = _asked(s.program, "x")
    return alias.possible_types(s, asked).join(asked, "query").select("stmt", "type")


@query("d20_heap_edges", _HELD + "SELECT 'c' || c || ':' || a AS base, 'f' AS field, 'c' || c || ':' || o AS alloc FROM heap")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    names = lambda qid, name: s.seeds.select(F.col("qid").alias(qid), F.col("stmt").alias(name))
    return s.heap.withColumnRenamed("base", "b").join(names("b", "base"), "b").join(names("qid", "alloc"), "qid").select("base", "field", "alloc")


@query("d18_points_of_indirection", _HELD + "SELECT 'c' || c || ':' || t AS stmt, 'store' AS kind, 'c' || c || ':' || wb AS base, 'c' || c || ':' || vb AS flow FROM held WHERE kind = 'store' AND wb IS NOT NULL UNION ALL SELECT 'c' || c || ':' || t, 'load', 'c' || c || ':' || wb, 'c' || c || ':' || o FROM (SELECT c, t, wb, unnest(xs) AS o FROM held WHERE kind = 'load' AND wb IS NOT NULL)")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    names = lambda qid, name: s.seeds.select(F.col("qid").alias(qid), F.col("stmt").alias(name))
    met = alias.indirections(s).withColumnsRenamed({"base": "b", "flow": "o"})
    return met.join(names("b", "base"), "b").join(names("o", "flow"), "o").select("stmt", "kind", "base", "flow")


@query("f11_invoked_methods", _HELD + "SELECT 'c' || c || ':' || CASE WHEN kind = 'on_v' THEN vb ELSE wb END AS alloc, 'c' || c || ':' || t AS stmt, 'go()' AS sig FROM held WHERE kind = 'on_v' OR (kind = 'on_w' AND wb IS NOT NULL)")
@settled
def _(spark, sf):
    s = _solved(spark, sf)
    return alias.invoked_methods(s).join(s.seeds.select("qid", F.col("stmt").alias("alloc")), "qid").select("alloc", "stmt", "sig")


@query("b6_killed_values", _HELD + "SELECT 'c' || c || ':' || t AS stmt, CASE kind WHEN 'new' THEN 'v' WHEN 'assign' THEN 'w' ELSE 'x' END || c AS val FROM k WHERE kind IN ('new', 'assign', 'load')")
def _(spark, sf):
    return ir.killed_values(_code(spark, sf))


@query("d27_call_graph", _HELD + "SELECT 'c' || h.c || ':' || h.t AS site, 'c' || h.c AS caller, CASE WHEN a.n % 3 = 0 THEN 'M0' ELSE 'M1' END AS callee FROM held h JOIN k a ON a.c = h.c AND a.t = CASE WHEN h.kind = 'on_v' THEN vb ELSE wb END WHERE h.kind IN ('on_v', 'on_w')")
@settled
def _(spark, sf):
    """T0 has a method of its own; T1 has one that T2, below it, inherits."""
    p = _code(spark, sf)
    p.tables |= {"vtable": spark.createDataFrame([("T0", "go()", "M0"), ("T1", "go()", "M1")], ir.SCHEMAS["vtable"]), "subtype": spark.createDataFrame([("T2", "T1")], ir.SCHEMAS["subtype"])}
    p.tables["call_edge"] = spark.createDataFrame([], ir.SCHEMAS["call_edge"])
    full, _ = alias.call_graph(p, p.stmt.select("method").distinct())
    return full.call_edge.select("site", "caller", "callee")


@query("e3_typestate_weights", _HELD + "SELECT 'c' || p.c || ':' || p.o AS alloc, CASE n WHEN 0 THEN '*>*' WHEN 1 THEN 'INIT>OPENED' ELSE '' END AS w FROM (SELECT p.c, p.o, count(h.t) AS n FROM points p LEFT JOIN held h ON h.c = p.c AND h.kind = 'on_v' AND h.vb = p.o WHERE x = 'v' AND p.t = (SELECT max(t) FROM k WHERE k.c = p.c) GROUP BY ALL) p")
@settled
def _(spark, sf):
    """What the calls on v change, for what v holds at the end: calls through w are not v's."""
    p = _code(spark, sf, types=("File",), calls=("open()",))
    s = alias.solve(p)
    moves = typestate.machine_tables(spark)[1].filter("machine = 'FileMustBeClosed'")
    ends = _asked(p, "v").join(ir.end_points(p).select("stmt"), "stmt", "left_semi")
    found = results.state_changes(s, moves).join(ends, ["stmt", "val"], "left_semi").join(s.seeds.select("qid", F.col("stmt").alias("alloc")), "qid")
    return found.select("alloc", F.array_join(F.transform("w", lambda x: F.concat_ws(">", x["src"], x["dst"])), ",").alias("w"))


_WATCHED = ("File", "Iterator", "Vector", "KeyStore", "Signature", "Socket", "URLConnection", "InputStream", "OutputStream", "PipedInputStream", "PipedOutputStream", "PrintStream", "PrintWriter")
_RESULTS = [("Iterator", "iterator()"), ("KeyStore", "getInstance(String)"), ("Signature", "getInstance(String)")]
_SIGS = tuple("close() connect() read() write(int) open() add(int) get(int) removeAllElements() next() hasNext() load(int) initSign(int) initVerify(int) sign() verify(int) update(int) setDoInput(boolean) getInputStream()".split())


def _watch_sql() -> str:
    """Every object's calls folded from each of its seeds, for every machine; what a pattern matches is told by its names."""
    heads, moves, errors = [], set(), []
    for line in typestate.MACHINES.strip().splitlines():
        name, cls, seed, initial, wrong, _, steps = (x.strip() for x in line.split(" | "))
        kind, _, method = seed.partition(" ")
        heads.append((name, cls, kind, method, initial))
        errors += [(name, e) for e in wrong.split()]
        for step in steps.split(";"):
            src, methods, dst, *_ = step.split()
            over, _, pattern = methods.rpartition(":")
            for sig in _SIGS:
                if over != "native" and re.fullmatch(pattern, sig if over == "sig" else sig.partition("(")[0]):
                    moves.add((name, src, sig, dst))
    values = lambda rows: "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in sorted(rows))
    return _HELD + f""",
m(machine, cls, seed, method, initial) AS ({values(heads)}), mv(machine, src, sig, dst) AS ({values(moves)}), bad(machine, state) AS ({values(errors)}),
objects AS (SELECT c, t AS o, ([{', '.join(f"'{x}'" for x in _WATCHED)}])[n % {len(_WATCHED)} + 1] AS cls FROM k WHERE kind = 'new'),
calls AS (SELECT c, CASE WHEN kind = 'on_v' THEN vb ELSE wb END AS o, t, ([{', '.join(f"'{x}'" for x in _SIGS)}])[n % {len(_SIGS)} + 1] AS sig FROM held WHERE kind IN ('on_v', 'on_w')),
ev AS (SELECT *, row_number() OVER (PARTITION BY c, o ORDER BY t) AS i FROM calls WHERE o IS NOT NULL),
starts AS (SELECT machine, objects.c, objects.o, 0 AS i, initial FROM m JOIN objects USING (cls) WHERE seed IN ('new', 'result') UNION SELECT machine, ev.c, ev.o, ev.i - 1, initial FROM m JOIN objects USING (cls) JOIN ev ON ev.c = objects.c AND ev.o = objects.o AND seed = 'call' AND split_part(ev.sig, '(', 1) = method),
run(machine, c, o, i, state) AS (SELECT * FROM starts UNION SELECT run.machine, run.c, run.o, ev.i, coalesce(mv.dst, run.state) FROM run JOIN ev ON ev.c = run.c AND ev.o = run.o AND ev.i = run.i + 1 LEFT JOIN mv ON mv.machine = run.machine AND mv.src = run.state AND mv.sig = ev.sig),
last AS (SELECT run.*, coalesce((SELECT max(i) FROM ev WHERE ev.c = run.c AND ev.o = run.o), 0) AS n FROM run)
SELECT last.machine, 'c' || c || ':' || o AS stmt, bool_or(bad.state IS NOT NULL) AS error FROM last LEFT JOIN bad ON bad.machine = last.machine AND bad.state = last.state WHERE i = n GROUP BY last.machine, c, o"""


@query("k1_to_k18_typestate_verdicts", _watch_sql())
@settled
def _(spark, sf):
    """All machines over one program whose objects are of the watched classes."""
    p = _code(spark, sf, types=_WATCHED, calls=_SIGS, results=_RESULTS)
    names = [line.split(" | ")[0] for line in typestate.MACHINES.strip().splitlines()]
    return typestate.judged(p, names).select("machine", "stmt", "error")


# Conversations that call methods which all of them share; turns are told by their text's length, the first is v = new File.
_CALLING = ("new", "assign", "put", "get", "same", "keep", "take", "open_it", "shut")
# The shared methods: name; parameters; what they do; what they return.
_SHARED = {
    "put": (["b", "o"], ("store", "b", "f", "o"), None),
    "get": (["c"], ("load", "r", "c", "f"), "r"),
    "same": (["p"], ("nop",), "p"),
    "keep": (["s"], ("static_store", "G", "s"), None),
    "take": ([], ("static_load", "u", "G"), "u"),
    "open_it": (["q"], ("call", "q", "open()"), None),
    "shut": (["t"], ("call", "t", "close()"), None),
}


def _calling(spark, sf) -> ir.Program:
    """put(w, v), x = get(w), y = same(v), keep(v), z = take(), open_it(v) and shut(v), with bodies of their own."""
    t = _turns(spark, sf)
    first = F.col("turn") == F.min("turn").over(ir.Window.partitionBy("conv_id"))
    kinds = table(spark, sf, "conversations").withColumn("kind", F.when(first, "new").otherwise(F.element_at(F.array(*map(F.lit, _CALLING)), (F.octet_length("text") % len(_CALLING) + 1).cast("int"))))
    kinds = kinds.select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("stmt"), "kind")
    t = written(t.drop("kind").join(kinds, "stmt").withColumns({x: F.concat(F.lit(x), F.substring("method", 2, 99)) for x in "yz"}))
    of = lambda kind, *cols: t.filter(F.col("kind").isin(*kind.split())).select("stmt", *cols)
    rows = {n: [] for n in ("stmt", "store", "load", "static_store", "static_load", "call", "param", "ret", "method")}
    for name, (params, (kind, *x), result) in _SHARED.items():
        rows["stmt"] += [(f"{name}:{i}", name, i, k) for i, k in enumerate(("nop", kind, "ret"))]
        rows["param"] += [(name, i, v) for i, v in enumerate(params)]
        rows["method"].append((name, "C", True, True, False, False, False, True))
        rows["ret"] += [(f"{name}:2", result)] if result else []
        if kind == "call":
            rows["call"].append((f"{name}:1", x[0], x[1], "virtual", None))
        elif kind != "nop":
            rows[kind].append((f"{name}:1", *x))
    shared = {n: spark.createDataFrame(r, ir.SCHEMAS[n]) for n, r in rows.items()}
    none, lit = F.lit(None).cast("string"), F.lit
    called = t.filter(F.col("kind").isin(*_SHARED))
    given = F.when(F.col("kind") == "put", F.array("w", "v")).when(F.col("kind") == "get", F.array("w")).when(F.col("kind") != "take", F.array("v")).otherwise(F.expr("cast(array() as array<string>)"))
    lhs = F.when(F.col("kind") == "get", F.col("x")).when(F.col("kind") == "same", F.col("y")).when(F.col("kind") == "take", F.col("z"))
    stmts = t.select("stmt", "method", "ord", "kind").unionByName(shared["stmt"])
    flag = lambda x: lit(x)
    own = t.select("method").distinct().select("method", lit("C").alias("cls"), *(flag(x).alias(n) for n, x in (("static", True), ("has_body", True), ("native", False), ("phantom", False), ("clinit", False), ("app", True))))
    return ir.Program(spark, shared | {
        "stmt": stmts, "cfg_edge": ir.straight_line_edges(stmts), "method": shared["method"].unionByName(own),
        "alloc": of("new", F.col("v").alias("val"), lit("File").alias("type"), lit("new").alias("kind"), none.alias("const")),
        "assign": of("assign", F.col("w").alias("lhs"), F.col("v").alias("rhs")),
        "call": shared["call"].unionByName(called.select("stmt", none.alias("recv"), F.concat("kind", lit("()")).alias("sig"), lit("static").alias("kind"), lhs.alias("lhs"))),
        "call_edge": called.select(F.col("stmt").alias("site"), F.col("method").alias("caller"), F.col("kind").alias("callee"), lit("static").alias("kind")),
        "arg": called.select("stmt", F.posexplode(given).alias("pos", "val")).filter("val is not null"),
    })


# The same folded in order: what G has been given, and what x, y and z were last given by the shared methods.
_CALLED = """WITH RECURSIVE k AS (SELECT conv_id AS c, turn AS t, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'new' ELSE (['new', 'assign', 'put', 'get', 'same', 'keep', 'take', 'open_it', 'shut'])[strlen(text) % 9 + 1] END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
run(c, i, t, kind, va, vb, wa, wb, vf, wf, g, x, y, z) AS (
  SELECT DISTINCT c, 0::BIGINT, NULL::BIGINT, '', NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], []::BIGINT[], []::BIGINT[], []::BIGINT[] FROM k
  UNION ALL
  SELECT k.c, k.i, k.t, k.kind, CASE WHEN k.kind = 'new' THEN k.t ELSE va END, va, CASE WHEN k.kind = 'assign' THEN va ELSE wa END, wa,
    CASE WHEN k.kind = 'new' THEN [] WHEN k.kind = 'put' AND va = wa THEN list_distinct(list_append(vf, va)) ELSE vf END, CASE k.kind WHEN 'assign' THEN vf WHEN 'put' THEN [va] ELSE wf END,
    CASE WHEN k.kind = 'keep' THEN list_distinct(list_append(g, va)) ELSE g END, CASE WHEN k.kind = 'get' THEN wf ELSE x END, CASE WHEN k.kind = 'same' THEN [va] ELSE y END, CASE WHEN k.kind = 'take' THEN g ELSE z END
  FROM run JOIN k ON k.c = run.c AND k.i = run.i + 1),
done AS (SELECT * FROM run WHERE i > 0),
held AS (SELECT c, t, 'v' AS n, va AS o FROM done WHERE va IS NOT NULL UNION ALL SELECT c, t, 'w', wa FROM done WHERE wa IS NOT NULL UNION ALL SELECT c, t, 'x', unnest(x) FROM done UNION ALL SELECT c, t, 'y', unnest(y) FROM done UNION ALL SELECT c, t, 'z', unnest(z) FROM done)
"""


@query("c5_calls_points_to", _CALLED + "SELECT 'c' || c || ':' || t AS stmt, n || c AS val, 'c' || c || ':' || o AS alloc_stmt FROM held")
@settled
def _(spark, sf):
    """What every value of a conversation holds, through arguments, returns, fields and statics of shared methods."""
    s = _solved(spark, sf, _calling)
    own = s.program.stmt.filter(F.col("method").startswith("c")).join(spark.createDataFrame([(m,) for m in _SHARED], "method string"), "method", "left_anti")
    asked = _asked(ir.Program(spark, {"stmt": own}), "v", "w", "x", "y", "z")
    return alias.points_to(s, asked).join(asked, "query").select("stmt", "val", "alloc_stmt")


@query("c11_parameters", _CALLED + "SELECT DISTINCT kind || ':1' AS stmt, CASE kind WHEN 'put' THEN 'o' WHEN 'same' THEN 'p' WHEN 'keep' THEN 's' WHEN 'open_it' THEN 'q' ELSE 't' END AS val, 'c' || c || ':' || va AS alloc_stmt FROM done WHERE kind IN ('put', 'same', 'keep', 'open_it', 'shut') UNION SELECT DISTINCT kind || ':1', CASE kind WHEN 'put' THEN 'b' ELSE 'c' END, 'c' || c || ':' || wa FROM done WHERE kind IN ('put', 'get') AND wa IS NOT NULL")
@settled
def _(spark, sf):
    """What the parameters of the shared methods hold, over all calls."""
    s = _solved(spark, sf, _calling)
    asked = s.program.param.select(F.concat_ws("|", "method", "val").alias("query"), F.concat("method", F.lit(":1")).alias("stmt"), "val")
    return alias.points_to(s, asked).join(asked, "query").select("stmt", "val", "alloc_stmt")


@query("d26_open_calls", _CALLED + "SELECT kind AS method, 'c' || c || ':' || t AS call_site FROM done WHERE kind IN ('put', 'get', 'same', 'keep', 'open_it', 'shut') AND (kind <> 'get' OR wa IS NOT NULL)")
@settled
def _(spark, sf):
    """The calls that are open where a parameter of a shared method holds something."""
    s = _solved(spark, sf, _calling)
    asked = s.program.param.select(F.col("method").alias("query"), F.concat("method", F.lit(":1")).alias("stmt"), "val")
    return alias.contexts(s, asked).select(F.col("query").alias("method"), "call_site")


@query("c21_static_values", _CALLED + "SELECT 'c' || c || ':' || t AS stmt, 'c' || c || ':' || unnest(g) AS alloc_stmt FROM done")
@settled
def _(spark, sf):
    """What the static field holds after each statement of a conversation."""
    s = _solved(spark, sf, _calling)
    held = s.points.filter(F.col("val") == flows.STATIC + "G").join(s.program.stmt.filter(F.col("method").rlike("^c[0-9]")).select("stmt"), "stmt", "left_semi")
    return held.join(s.seeds.select("qid", F.col("stmt").alias("alloc_stmt")), "qid").select("stmt", "alloc_stmt")


@query("d32_typestate_in_callees", _CALLED + ", u AS (SELECT c, va AS o, min(CASE WHEN kind = 'open_it' THEN t END) AS opened, min(CASE WHEN kind = 'shut' THEN t END) AS closed FROM done GROUP BY c, va) SELECT 'c' || c || ':' || o AS stmt, opened IS NOT NULL AND closed IS NULL AS error FROM u")
@settled
def _(spark, sf):
    """Files that are open at the end; they are opened and closed in methods that all conversations share."""
    s, found = _file_paths(spark, sf)
    machines = typestate.machine_tables(spark)[0].filter("machine = 'FileMustBeClosed'")
    return typestate.verdicts(typestate.final_states(s, found), machines).join(s.seeds.select("qid", "stmt"), "qid").select("stmt", "error")


@query("f20_error_anywhere", _CALLED + ", u AS (SELECT c, va AS o, min(CASE WHEN kind = 'open_it' THEN t END) AS opened, min(CASE WHEN kind = 'shut' THEN t END) AS closed FROM done GROUP BY c, va) SELECT 'c' || c || ':' || o AS stmt, opened IS NOT NULL AND (closed IS NULL OR opened < closed) AS error FROM u")
@settled
def _(spark, sf):
    """Files that are open after any statement."""
    s, found = _file_paths(spark, sf)
    machines = typestate.machine_tables(spark)[0].filter("machine = 'FileMustBeClosed'")
    return typestate.verdicts(found.filter(F.col("kind") == typestate.AT), machines).join(s.seeds.select("qid", "stmt"), "qid").select("stmt", "error")


def _file_paths(spark, sf) -> tuple[alias.Solution, DataFrame]:
    s = _solved(spark, sf, _calling)
    machines, moves = (t.filter("machine = 'FileMustBeClosed'") for t in typestate.machine_tables(spark))
    start = typestate.seeds(s, machines, spark.createDataFrame([], ir.SCHEMAS["subtype"]))
    return s, typestate.paths(s, start, moves)


@query("d25_contexts_of_each_call", _CALLED + "SELECT 'c' || c || ':' || t AS call_site, 'c' || c || ':' || CASE kind WHEN 'get' THEN wa ELSE va END AS alloc_stmt FROM done WHERE kind IN ('same', 'keep', 'open_it', 'shut') OR (kind = 'get' AND wa IS NOT NULL)")
@settled
def _(spark, sf):
    """What the parameter of a shared method holds at each of its calls: one backward query a call, asked in that call alone."""
    p = _calling(spark, sf)
    params = p.param.groupBy(F.col("method").alias("callee")).agg(F.count("*").alias("n"), F.min("val").alias("val")).filter("n = 1")
    asked = written(p.call_edge.join(params, "callee").select(F.col("site").alias("query"), F.concat("callee", F.lit(":1")).alias("stmt"), "val", "callee", "site"))
    s = alias.backward_solve(p, asked, contexts=asked.select("query", "callee", "site"))
    return alias.answers(s, asked).select(F.col("query").alias("call_site"), "alloc_stmt")


@query("d14_empty_stacks", _CALLED + "SELECT 'c' || c || ':' || t AS stmt, n || c AS val, 'c' || c || ':' || o AS alloc_stmt FROM held UNION ALL SELECT 'c' || c || ':' || t, 'static:G', 'c' || c || ':' || unnest(g) FROM done")
@settled
def _(spark, sf):
    """Facts with no field and no call open: those of the conversations' own statements."""
    s = _solved(spark, sf, _calling)
    return sync.empty_stack_nodes(s.reached, s.fields, s.calls).join(s.seeds.select("qid", F.col("stmt").alias("alloc_stmt")), "qid").select("stmt", "val", "alloc_stmt")
