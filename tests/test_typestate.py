"""Typestate on small programs; closures, statistics, sinks, text functions, streaming."""

import pytest
from pyspark.sql import functions as F

from pushgraph.functions import text as T
from pushgraph.operators import alias as A
from pushgraph.operators import closure as C
from pushgraph.operators import typestate as Y
from pushgraph.plans import stats
from pushgraph.sources import sinks
from pushgraph.streaming.incremental import IncrementalClosure
from tests.test_alias import Code

EDGE = "qid long, src string, dst string"


def test_file_machine(spark):
    code = Code()
    code.method("open_only", [], ("new", "o.f", "File"), ("call", None, "o.f", "open()", [], []), ("nop",))
    code.method("closed", [], ("new", "c.f", "File"), ("assign", "c.g", "c.f"), ("call", None, "c.f", "open()", [], []), ("call", None, "c.g", "close()", [], []), ("nop",))
    code.method("in_callee", [], ("new", "d.f", "File"), ("call", None, "d.f", "open()", [], []), ("call", None, None, "shut", ["d.f"], ["shut"]), ("nop",))
    code.method("shut", ["p"], ("call", None, "p", "close()", [], []), ("nop",))
    code.method("weak", [], ("new", "w.f", "File"), ("call", None, "w.f", "open()", [], []), ("new", "w.h", "File"), ("nop",), ("assign", "w.x", "w.f"), ("nop",), ("call", None, "w.x", "close()", [], []), ("nop",))
    p = code.program(spark)
    # one more path into weak's close: x may be the second file too
    p.tables["cfg_edge"] = p.cfg_edge.union(spark.createDataFrame([("weak:4", "weak:9"), ("weak:9", "weak:6")], "src string, dst string"))
    p.tables["stmt"] = p.stmt.union(spark.createDataFrame([("weak:9", "weak", 9, "assign")], "stmt string, method string, ord long, kind string"))
    p.tables["assign"] = p.assign.union(spark.createDataFrame([("weak:9", "w.x", "w.h")], "stmt string, lhs string, rhs string"))
    s = A.solve(p)
    machines, moves = Y.machine_tables(spark)
    one = machines.filter("machine = 'FileMustBeClosed'")
    found = Y.states(s, Y.seeds(s, one, spark.createDataFrame([], "sub string, sup string")), moves.filter("machine = 'FileMustBeClosed'")).cache()
    names = {r["qid"]: r["stmt"] for r in s.seeds.collect()}
    held = {}
    for r in found.collect():
        held.setdefault((names[r["qid"]], r["stmt"]), set()).add(r["state"])
    assert held["open_only:1", "open_only:3"] == {"OPENED"}
    assert held["closed:1", "closed:3"] == {"OPENED"} and held["closed:1", "closed:5"] == {"CLOSED"}
    assert held["in_callee:1", "in_callee:4"] == {"CLOSED"}
    assert held["weak:1", "weak:8"] == {"OPENED", "CLOSED"}
    exits = spark.createDataFrame([("open_only:3",), ("closed:5",)], "stmt string")
    got = {names[r["qid"]]: r["error"] for r in Y.verdicts(found, one, exits).collect()}
    assert got == {"open_only:1": True, "closed:1": False}
    asked = found.filter("stmt = 'weak:8'").select("machine", "qid", "stmt", F.lit("CLOSED").alias("state")).distinct()
    assert [(r["may"], r["must"]) for r in Y.must_may(found, asked).collect()] == [(True, False)] * 2


def test_call_contexts(spark):
    """What goes into a method at one call does not come back at another; a helper's update is strong for each caller's object."""
    code = Code()
    on = lambda v, sig: ("call", None, v, sig, [], [])
    to = lambda name, v: ("call", None, None, name, [v], [name])
    code.method("between", [], ("new", "o", "File"), on("o", "open()"), to("id", "o"), on("o", "close()"), to("id", "o"), ("nop",))
    code.method("two", [], ("new", "a", "File"), ("new", "b", "File"), to("open2", "a"), to("open_it", "b"), to("shut", "a"), ("nop",))
    code.method("again", [], ("new", "r", "File"), on("r", "open()"), to("rec", "r"), ("nop",))
    code.method("id", ["p"], ("nop",))
    code.method("open2", ["q2"], to("open_it", "q2"), ("nop",))
    code.method("open_it", ["q"], on("q", "open()"), ("nop",))
    code.method("shut", ["t"], on("t", "close()"), ("nop",))
    code.method("rec", ["u"], on("u", "close()"), to("rec", "u"), ("nop",))
    p = code.program(spark)
    p.tables["cfg_edge"] = p.cfg_edge.union(spark.createDataFrame([("rec:1", "rec:3")], "src string, dst string"))
    s = A.solve(p)
    machines, moves = (t.filter("machine = 'FileMustBeClosed'") for t in Y.machine_tables(spark))
    start = Y.seeds(s, machines, spark.createDataFrame([], "sub string, sup string"))
    walked = Y.paths(s, start, moves).cache()
    names = {r["qid"]: r["val"] for r in s.seeds.collect()}
    held = {}
    for r in walked.filter("kind = 'at'").collect():
        held.setdefault((names[r["qid"]], r["stmt"]), set()).add(r["state"])
    assert held["o", "between:3"] == {"OPENED"} and held["o", "between:4"] == held["o", "between:6"] == {"CLOSED"} and held["o", "id:1"] == {"OPENED", "CLOSED"}
    assert held["a", "two:3"] == {"OPENED"} and held["a", "two:6"] == {"CLOSED"} and held["b", "two:3"] == {"INIT"} and held["b", "two:6"] == {"OPENED"}
    assert held["r", "again:4"] == {"CLOSED"} and ("a", "shut:1") in held and ("b", "shut:1") not in held
    told = lambda rows: {names[r["qid"]]: r["error"] for r in Y.verdicts(rows, machines).collect()}
    assert told(Y.final_states(s, walked)) == {"o": False, "a": False, "b": True, "r": False}
    assert told(walked.filter("kind = 'at'")) == {"o": True, "a": True, "b": True, "r": True}


def test_machines(spark):
    machines, moves = Y.machine_tables(spark)
    assert machines.count() == 18 and moves.select("machine").distinct().count() == 18
    states = moves.select("machine", F.explode(F.array("src", "dst")).alias("s")).distinct()
    errors = machines.select("machine", F.explode("errors").alias("s"))
    assert errors.join(states, ["machine", "s"], "left_anti").count() == 0


def test_closures(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "a", "b"), (2, "b", "d"), (2, "a", "d")]
    e = spark.createDataFrame(rows, EDGE)
    for doubling in (True, False):
        got = {tuple(r) for r in C.transitive_closure(e, doubling=doubling).collect()}
        assert got == {(1, x, y) for x in "abc" for y in "abcd"} | {(2, "a", "b"), (2, "b", "d"), (2, "a", "d")}
    assert {tuple(r) for r in C.has_cycle(e).collect()} == {(1, True), (2, False)}
    start = spark.createDataFrame([(2, "a")], "qid long, node string")
    assert {tuple(r)[1:] for r in C.depths(e, start).collect()} == {("a", 0), ("b", 1), ("d", 1)}
    assert {tuple(r)[1:] for r in C.depths(e, start, longest=True).collect()} == {("a", 0), ("b", 1), ("d", 2)}
    with pytest.raises(ValueError):
        C.depths(e, spark.createDataFrame([(1, "a")], "qid long, node string"), longest=True, max_rounds=6)
    t = spark.createDataFrame([(1, "x", "f", "y"), (1, "y", "g", "x"), (1, "y", "h", "z")], "qid long, src string, label string, dst string")
    assert C.longest_label_path(t, spark.createDataFrame([(1, "x")], "qid long, node string")).first()["labels"] == ["f", "h"]


def test_prefix_import(spark):
    trans = "qid long, src string, label string, dst string"
    base = spark.createDataFrame([(1, "A1", "f", "INITA"), (1, "A3", "g", "INITA"), (1, "A4", "h", "A3"), (2, "A1", "f", "A2"), (2, "A2", "i", "INITA"), (2, "A3", "g", "INITA"), (2, "A4", "k", "A3")], trans)
    flow = spark.createDataFrame([(q, "A1", "f", "B2") for q in (1, 2)] + [(q, "B2", "i", "INITB") for q in (1, 2)], trans)
    at = spark.createDataFrame([(1, "A1", "f", "INITA"), (2, "A1", "f", "A2")], trans)
    got = {tuple(r) for r in C.prefix_import(base, flow, at).collect()}
    assert {(1, "A3", "g", "B2"), (1, "A4", "h", "A3"), (2, "A3", "g", "INITB"), (2, "A4", "k", "A3")} <= got


def test_text_functions(spark):
    df = spark.createDataFrame([("a[f,g]; b[h]* ;c",)], "t string").select(F.explode(T.parse_access_paths(F.col("t"))).alias("p"))
    assert [(r["p"]["base"], r["p"]["fields"], r["p"]["approx"]) for r in df.collect()] == [("a", ["f", "g"], False), ("b", ["h"], True), ("c", [], False)]
    assert [r["t"] for r in df.select(T.access_path_text(F.col("p")).alias("t")).collect()] == ["a[f,g]", "b[h]*", "c"]
    ids = {r["v"]: r["id"] for r in T.interned(spark.createDataFrame([("z",), ("a",), ("m",), ("a",)], "v string"), "v").collect()}
    assert ids == {"a": 0, "m": 1, "z": 2}
    assert spark.range(1).select(T.escape_html(F.lit("<a & b>"))).first()[0] == "&lt;a &amp; b&gt;"


def test_stats_and_sinks(spark, tmp_path):
    visits = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "method string")
    assert [tuple(r) for r in stats.top_methods(visits, 2).collect()] == [("b", 2), ("a", 1)]
    assert stats.collisions(visits, ["method"]).first()["collisions"] == 1
    t = spark.createDataFrame([(1, "a", 'x"', "b"), (1, "a", "f", "b")], "qid long, src string, label string, dst string")
    assert sinks.dot(t).first()["dot"] == 'digraph {\n"a" -> "b" [label="f,x"];\n}'
    for _ in range(2):
        sinks.append_csv(visits, str(tmp_path / "s"))
    assert sinks.read_csv(spark, str(tmp_path / "s"), "method string").count() == 8


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], EDGE).write.parquet(str(tmp_path / "in"))
    c, seen = IncrementalClosure(), []
    c.listen(lambda new: seen.append(new.count()))
    q = c.attach(spark.readStream.schema(EDGE).parquet(str(tmp_path / "in")), str(tmp_path / "ck"))
    q.processAllAvailable()
    spark.createDataFrame([(1, "c", "d")], EDGE).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r)[1:] for r in c.pairs.collect()} == {(x, y) for x, y in ("ab", "bc", "ac", "cd", "bd", "ad")} and seen == [3, 3]
