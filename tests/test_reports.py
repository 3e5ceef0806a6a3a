"""Reports over one solved program, and small readers and writers."""

from pyspark.sql import functions as F

from pushgraph.functions import semiring as S
from pushgraph.functions import text as T
from pushgraph.operators import alias as A
from pushgraph.operators import closure, flows, language, pds
from pushgraph.operators import results as R
from pushgraph.operators import typestate as Y
from pushgraph.plans import stats
from pushgraph.plans.fixpoint import fixpoint
from pushgraph.sources import ir, sinks
from tests.test_alias import Code


def test_reports(spark):
    code = Code()
    on = lambda v, sig: ("call", None, v, sig, [], [])
    code.method("main", [], ("new", "f", "File"), ("assign", "g", "f"), on("f", "open()"), on("g", "close()"), ("new", "b", "Box"), ("call", None, None, "put", ["b", "g"], ["put"]), ("load", "q", "b", "held"), ("nop",))
    code.method("put", ["c", "o"], ("store", "c", "held", "o"), ("nop",))
    code.method("other", [], ("new", "n", "Num"), ("nop",))
    p = code.program(spark, local=[(v, m, None) for v, m in (("f", "main"), ("g", "main"), ("b", "main"), ("q", "main"), ("c", "put"), ("o", "put"), ("n", "other"))])
    p.tables["alloc"] = p.alloc.withColumn("const", F.when(F.col("type") == "Num", "7"))
    s = A.solve(p)
    val = {r["qid"]: r["val"] for r in s.seeds.collect()}
    named = lambda rows, *cols: {(val[r["qid"]], *(r[c] for c in cols)) for r in rows.collect()}
    # Each alias has the state that the other one's call gave it, and no other.
    moves = Y.machine_tables(spark)[1].filter("machine = 'FileMustBeClosed'")
    w = {(val[r["qid"]], r["stmt"], r["val"]): [tuple(x) for x in r["w"]] for r in R.second_phase(s, moves).collect()}
    assert w["f", "main:3", "g"] == w["f", "main:3", "f"] == [("INIT", "OPENED")]
    assert w["f", "main:4", "g"] == w["f", "main:4", "f"] == [("INIT", "CLOSED")]
    facts = R.state_changes(s, moves)
    at = {(val[r["qid"]], r["stmt"]): {tuple(x) for x in r["w"]} for r in R.statement_weights(facts, S.TYPESTATE).collect()}
    assert at["f", "main:3"] == {("INIT", "OPENED"), ("*", "*")}
    assert {x for x in named(R.visited_methods(s), "method")} == {("f", "main"), ("f", "put"), ("b", "main"), ("b", "put"), ("n", "other")}
    assert named(R.values_at(s, spark.createDataFrame([("main:7",)], "stmt string")), "stmt", "val") >= {("f", "main:7", "q"), ("f", "main:7", "b"), ("b", "main:7", "b")}
    assert named(R.result_table(s), "val") == named(s.reached, "val")
    counts = {val[r["qid"]]: (r["field_rules"], r["call_rules"]) for r in R.rule_counts(s).collect()}
    assert set(counts) == {"f", "b", "n"} and counts["f"] > counts["n"]
    asked = spark.createDataFrame([(1, "other:1", "n"), (2, "main:7", "q")], "query long, stmt string, val string")
    assert [tuple(r) for r in R.possible_constants(s, asked).collect()] == [(1, "Num", "7")]
    pairs = spark.createDataFrame([(1, "main:7", "q", "main:2", "g"), (2, "main:7", "q", "main:5", "b")], "query long, stmt string, val string, other_stmt string, other string")
    assert [(r["query"], r["alloc_val"]) for r in R.shared_allocations(s, pairs).collect()] == [(1, "f")]
    active = {(r["stmt"], val[r["base"]], val[r["flow"]], r["succ"]) for r in A.activated(s).collect()}
    assert {("put:1", "b", "f", "put:2"), ("main:7", "b", "f", "main:8")} == active
    assert ("f", "main:6", "f") in named(A.imported_at_calls(s), "stmt", "val")
    assert ("f", "main:2", "f") in named(A.data_flow_path(s), "stmt", "val")
    chain = spark.createDataFrame([(1, "put:1", "o")], "query long, stmt string, val string")
    assert [tuple(r) for r in A.scoped_contexts(s, chain).collect()] == [(1, "put", "main:6")]
    one = stats.simple([("forward", s)], p).first().asDict()
    assert (one["forward"], one["backward"], one["total"], one["visited_methods"]) == (3, 0, 3, 3)
    flow = R.flow_rows(s)
    assert ("n", "other:1", "n") in named(flows.is_identity(flow), "stmt", "val") and ("f", "main:1", "f") not in named(flows.is_identity(flow), "stmt", "val")
    scope = ir.method_scope(p, spark.createDataFrame([(1, "put:1"), (2, "other:1")], "query long, stmt string"))
    assert {tuple(r) for r in scope.collect()} == {(1, "put"), (1, "main"), (2, "other")}
    entry = spark.createDataFrame([("main",)], "method string")
    assert {r["val"] for r in ir.application_seeds(p, entry).collect()} == {"f", "b"}
    possible = spark.createDataFrame([("main:6", "put"), ("main:6", "put2"), ("main:3", "open")], "site string, callee string")
    assert {r["site"] for r in ir.may_have_more_edges(p, possible).collect()} == {"main:3", "main:6"}


def test_automata(spark):
    rule = "qid long, kind string, s1 string, l1 string, s2 string, l2 string, site string, w long"
    rules = spark.createDataFrame([(1, "push", "p", "call", "q", "in", "back", 0), (1, "pop", "q", "in", "q", "", "", 0)], rule)
    trans = pds.post_star(rules, spark.createDataFrame([(1, "p", "call", "END", 0)], "qid long, src string, label string, dst string, w long")).total
    assert [tuple(r) for r in pds.matched_calls(trans, rules).collect()] == [(1, "call", "back", "q")]
    assert [tuple(r) for r in pds.summaries(trans).collect()] == [(1, "<q|in>", 2, 1)]
    t = spark.createDataFrame([(1, "a", "eps", "b"), (1, "b", "eps", "c"), (1, "c", "x", "a")], "qid long, src string, label string, dst string")
    assert {tuple(r)[1:] for r in closure.epsilon_closure(t).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {r["node"] for r in closure.on_cycle(t).collect()} == {"a", "b", "c"}
    assert {tuple(r)[1:] for r in language.reversed_automaton(t).collect()} == {("b", "eps", "a"), ("c", "eps", "b"), ("a", "x", "c")}
    odd = S.Semiring("count", "bigint", lambda: F.lit(1), lambda a, b: a * b, F.sum, idempotent=False)
    try:
        fixpoint(t.select("src", F.lit(1).alias("w")), lambda total, delta: delta, keys=["src"], weight="w", semiring=odd)
    except ValueError as e:
        assert "count" in str(e)
    else:
        raise AssertionError("a counting semiring has no fixpoint")


def test_readers_and_writers(spark, tmp_path, capsys):
    (tmp_path / "log").write_text("Class.forName;pkg.A;pkg.B.m;12;\nMethod.invoke;pkg.C;;;g\n")
    (tmp_path / "classes").write_text("pkg.A\n\n pkg.B \npkg.A\n")
    (tmp_path / "props").write_text("# comment\nbudget = 60000\n! other\nstaticFlows:true\nempty=\n")
    assert [tuple(r) for r in ir.reflection_log(spark, str(tmp_path / "log")).orderBy("kind").collect()] == [("Class.forName", "pkg.A", "pkg.B.m", "12", None), ("Method.invoke", "pkg.C", None, None, "g")]
    assert {r["cls"] for r in ir.class_list(spark, str(tmp_path / "classes")).collect()} == {"pkg.A", "pkg.B"}
    assert {tuple(r) for r in ir.properties(spark, str(tmp_path / "props")).collect()} == {("budget", "60000"), ("staticFlows", "true"), ("empty", "")}
    rows = spark.createDataFrame([("b",), ("a",)], "line string")
    assert sinks.console(rows, 1) in capsys.readouterr().out
    sinks.write_text(rows, "line", str(tmp_path / "out"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"a", "b"}
    got = spark.createDataFrame([("<pkg.A",), ("java.X",), ("lib.Y",)], "c string").select("c", T.in_application(F.col("c"), ["pkg.", "lib."]).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, True]
