"""Regular expressions of automata, weighted results, filters."""

import itertools
import random

from pyspark.sql import functions as F

from pushgraph.operators import alias as A
from pushgraph.operators import language as L
from pushgraph.operators import results as R
from tests.test_alias import Code


def accepts(edges, start, final, word):
    now = {start}
    for step in (*word, None):
        while True:
            more = now | {b for a, x, b in edges if a in now and x in ("eps", "{}")}
            if more == now:
                break
            now = more
        if step is not None:
            now = {b for a, x, b in edges if a in now and x == step}
    return final in now


def matches(regex, word):
    return regex is not None and L.to_python(regex).fullmatch("".join(w + " " for w in word)) is not None


def test_languages(spark):
    r = random.Random(9)
    automata = []
    for _ in range(25):
        states = [str(i) for i in range(r.randint(2, 4))]
        automata.append(sorted({(r.choice(states), r.choice(["f", "g", "eps"]), r.choice(states)) for _ in range(r.randint(1, 6))}))
    trans = spark.createDataFrame([(q, *e) for q, a in enumerate(automata) for e in a], "qid long, src string, label string, dst string")
    ends = spark.createDataFrame([(q, "0", "1") for q in range(25)], "qid long, start string, final string")
    got = {x["qid"]: x["regex"] for x in L.languages(trans, ends).collect()}
    for q, a in enumerate(automata):
        for n in range(5):
            for word in itertools.product("fg", repeat=n):
                assert matches(got[q], word) == accepts(a, "0", "1", word), (a, got[q], word)


def test_weighted_results(spark):
    code = Code()
    code.method("main", [], ("new", "x", "T"), ("assign", "y", "x"), ("call", None, "y", "m()", [], ["T.m"]), ("call", None, "y", "close()", [], []), ("nop",))
    code.method("T.m", [], ("assign", "z", "t"), ("nop",), this="t")
    s = A.solve(code.program(spark))
    called = {(r["stmt"], r["val"]): r["w"] for r in R.called_on_the_way(s).collect()}
    assert called["T.m:2", "z"] == ["T.m"] and called["main:2", "y"] == []
    paths = {(r["stmt"], r["val"]): r["w"] for r in R.data_flow_paths(s).collect()}
    assert "main:2" in paths["main:4", "y"] and "main:3" in paths["T.m:1", "z"]
    moves = spark.createDataFrame([("OPEN", "close", "CLOSED"), ("OPEN", "m", "OPEN")], "src string, pattern string, dst string")
    states = {(r["stmt"], r["val"]): {tuple(p) for p in r["w"]} for r in R.state_changes(s, moves).collect()}
    assert ("OPEN", "CLOSED") in states["main:5", "y"] and states["main:2", "y"] == {("*", "*")}
    stat = R.statistics(s).first()
    assert stat["methods"] == 2 and not stat["call_loop"] and stat["call_states"] == 1


def test_filters(spark):
    facts = spark.createDataFrame([(1, "s", "v", "Base"), (1, "s", "w", "Other"), (1, "s", "u", None), (2, "s", "w", "Other")], "qid long, stmt string, val string, declared string")
    types = spark.createDataFrame([(1, "Sub"), (2, "Other")], "qid long, type string")
    subs = spark.createDataFrame([("Sub", "Base"), ("Sub", "Sub"), ("Other", "Other")], "sub string, sup string")
    assert {(r["qid"], r["val"]) for r in R.type_filter(facts, types, subs).collect()} == {(1, "v"), (1, "u"), (2, "w")}
    cfg = spark.createDataFrame([("s", "a"), ("s", "b")], "src string, dst string")
    branch = spark.createDataFrame([("s", "b", "v")], "src string, dst string, val string")
    assert {(r["dst"], r["val"]) for r in R.null_branches_cut(cfg, branch, facts.filter("val in ('u', 'v')")).collect()} == {("a", "v"), ("a", "u"), ("b", "u")}
    edges = spark.createDataFrame([("c1", "m")], "site string, callee string")
    more = spark.createDataFrame([("c2", "m"), ("c3", "n")], "site string, callee string")
    asked = spark.createDataFrame([("m",), ("n",)], "method string")
    assert {tuple(r) for r in R.callers(edges, more, asked).collect()} == {("c1", "m"), ("c3", "n")}
    assert F is not None
