"""Backward queries, filters of facts, library models, pops through the empty stack, wildcards backwards, shared folders."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pushgraph.operators import alias as A
from pushgraph.operators import pds, sync
from pushgraph.operators import results as R
from pushgraph.session import checkpoint_dir
from pushgraph.sources import ir
from tests.test_alias import Code

RULE = "qid long, kind string, s1 string, l1 string, s2 string, l2 string, site string, w long"
TRANS = "qid long, src string, label string, dst string, w long"


def test_pops_through_the_empty_stack(spark):
    rules = spark.createDataFrame([(1, "pop", "p", "f", "t", "", "", 0), (1, "push", "s", "a", "q", "f", "b", 0)], RULE)
    start = spark.createDataFrame([(1, "p", "{}", "q", 0), (1, "s", "a", "END", 0)], TRANS)
    found = lambda **k: {tuple(r)[1:4] for r in pds.post_star(rules, start, **k).total.collect()}
    assert ("t", "eps", "<q|f>") not in found() and {("t", "eps", "<q|f>"), ("t", "b", "END")} <= found(through_empty=True)


def test_names_kept_for_pushed_states(spark):
    rules = spark.createDataFrame([(1, "pop", "p", "f", "<init>", "", "", 0)], RULE)
    with pytest.raises(Exception, match="may not begin with"):
        pds.post_star(rules, spark.createDataFrame([(1, "p", "f", "END", 0)], TRANS))


def test_wildcards_backwards(spark):
    rules = spark.createDataFrame([(1, "push", "p", "*", "q", "x", "*", 0), (1, "normal", "r", "a", "q", "not:a", "", 0)], RULE)
    got = {tuple(r)[1:4] for r in pds.pre_star(rules, spark.createDataFrame([(1, "q", "x", "m", 0), (1, "m", "a", "END", 0)], TRANS)).total.collect()}
    assert got == {("q", "x", "m"), ("m", "a", "END"), ("p", "a", "END")}


def test_backward_query(spark):
    code = Code()
    code.method("main", [], ("new", "a", "T"), ("assign", "e", "a"), ("new", "x", "A"), ("call", None, None, "put", ["e", "x"], ["put"]), ("load", "q", "a", "b"), ("nop",))
    code.method("put", ["r", "s"], ("nop",), ("store", "r", "b", "s"), ("nop",))
    code.method("other", [], ("new", "u", "U"), ("new", "z", "Z"), ("store", "u", "c", "z"), ("load", "y", "u", "c"), ("nop",))
    p = code.program(spark)
    asked = spark.createDataFrame([(1, "main:6", "q")], "query long, stmt string, val string")
    s = A.backward_solve(p, asked)
    assert [r["alloc_stmt"] for r in A.points_to(s, asked).collect()] == ["main:3"]
    assert {r["stmt"] for r in s.seeds.collect()} == {"main:1", "main:3"}  # nothing of the other method
    met = {(r["stmt"], r["kind"]) for r in A.indirections(s).collect()}
    assert met == {("put:2", "store"), ("main:5", "load")}
    assert [(r["query"], r["alloc_stmt"]) for r in A.answers(s, asked).collect()] == [(1, "main:3")]
    one = A.solve(p, options=A.Options(timeout_seconds=0.0))
    assert one.timed_out and not s.timed_out


def test_backward_queries_in_contexts(spark):
    """Queries of one batch are asked in call chains of their own; loads and stores in backward queries, through aliases and calls."""
    code = Code()
    code.method("main", [], ("new", "x", "A"), ("call", None, None, "m", ["x"], ["m"]), ("new", "y", "B"), ("call", None, None, "m", ["y"], ["m"]), ("nop",))
    code.method("m", ["p"], ("nop",))
    code.method("store", [], ("new", "w", "N"), ("new", "v", "A"), ("store", "w", "f", "v"), ("assign", "e", "w"), ("load", "q", "e", "f"), ("new", "u", "N"), ("new", "z", "B"), ("store", "u", "f", "z"), ("nop",))
    p = code.program(spark)
    asked = spark.createDataFrame([(1, "m:1", "p"), (2, "m:1", "p"), (3, "m:1", "p"), (4, "m:1", "p"), (5, "store:6", "q")], "query long, stmt string, val string")
    chains = spark.createDataFrame([(1, "m", "main:2"), (2, "m", "main:4"), (4, "m", "nowhere")], "query long, callee string, site string")
    s = A.backward_solve(p, asked, contexts=chains)
    got = {}
    for r in A.answers(s, asked).collect():
        got.setdefault(r["query"], set()).add(r["alloc_stmt"])
    assert got == {1: {"main:1"}, 2: {"main:3"}, 3: {"main:1", "main:3"}, 5: {"store:2"}}
    assert {r["stmt"] for r in s.seeds.collect()} == {"main:1", "main:3", "store:1", "store:2"}  # not the other N, nor what is stored there


def test_filters_and_models(spark):
    code = Code()
    code.method("main", [], ("new", "a", "A"), ("new", "b", "B"), ("assign", "c", "a"), ("call", "r", None, "copy(Object)", ["a"], []), ("new", "n", None, "null"), ("nop",), ("new", "arr", "T[][]", "multi_array"), ("load", "q", "arr", "array"), ("nop",))
    p = code.program(spark, local=[("a", "main", "A"), ("b", "main", "B"), ("c", "main", "B"), ("r", "main", None), ("n", "main", "A"), ("q", "other", "T[]")], lib_model=[("copy", 0, ir.RESULT)], null_branch=[("main:6", "main:7", "n")], subtype=[("A", "Top"), ("B", "Top")])
    s = A.solve(p, options=A.Options(track_nulls=True))
    names = {r["qid"]: r["stmt"] for r in s.seeds.collect()}
    at = {(r["stmt"], r["val"], names[r["qid"]]) for r in s.points.collect()}
    assert not any(val == "c" for _, val, _ in at)  # an A is no B
    assert ("main:5", "r", "main:1") in at and ("main:6", "n", "main:5") in at and not any(val == "n" and stmt > "main:6" for stmt, val, _ in at)
    assert not any(val == "q" for _, val, _ in at)  # another method's local
    free = A.solve(ir.Program(spark, {k: v for k, v in p.tables.items() if k != "local"}), options=A.Options())
    assert {(r["stmt"], r["val"]) for r in free.points.collect()} >= {("main:9", "q"), ("main:9", "c")}
    asked = spark.createDataFrame([(1, "main:9", "c"), (2, "main:9", "a")], "query long, stmt string, val string")
    assert {r["query"]: r["empty"] for r in R.is_empty(s, asked).collect()} == {1: True, 2: False}
    ends = {(names[r["qid"]], r["stmt"], r["val"]) for r in R.destructing_statements(s).collect()}
    assert ("main:2", "main:2", "b") in ends and ("main:1", "main:4", "a") in ends
    assert {(names[r["qid"]], r["type"]) for r in R.propagation_types(s).collect()} >= {("main:1", "A"), ("main:2", "B")}
    told = {r["query"]: r["regex"] for r in R.access_path_languages(free, free.seeds.filter("kind = 'multi_array'").select(F.lit(1).alias("query"), "qid", "stmt", "val")).collect()}
    assert set(told) == {1} and "array" in told[1]
    made = ir.allocation_at(p, spark.createDataFrame([("main:1", "a"), ("main:3", "c")], "stmt string, val string")).collect()
    assert [(r["stmt"], r["alloc_stmt"]) for r in made] == [("main:1", "main:1")]


def test_listeners_and_nested_returns(spark):
    seen = {}
    seeds = spark.createDataFrame([(1, "s0", "x")], "qid long, stmt string, val string")
    flows = spark.createDataFrame([(1, "call_push", "s0", "x", "s1", "m0", "y"), (1, "normal", "m0", "y", "", "m1", "y"), (1, "call_pop", "m1", "y", "", "s1", "x")], "qid long, kind string, stmt string, val string, sym string, to_stmt string, to_val string")
    reached, _, calls = sync.synchronised(seeds, flows, listen=lambda name, rows: seen.setdefault(name, []).extend(map(tuple, rows.collect())))
    assert sorted(seen["reached"]) == sorted(map(tuple, reached.collect())) and {"field", "call", "field_rule", "call_rule"} <= set(seen)
    assert [tuple(r) for r in sync.returned_through(calls).collect()] == [(1, "s1", "x")]


def test_a_cluster_needs_a_shared_folder():
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
