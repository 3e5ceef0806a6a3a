"""Points-to, aliases, contexts and call graph on small programs written as facts."""

import pytest
from pyspark.sql import functions as F

from pushgraph.operators import alias as A
from pushgraph.sources.ir import Program, dispatch, named_constants, straight_line_edges

METHOD = lambda name, **k: (name, k.get("cls", "C"), k.get("static", True), k.get("body", True), False, False, False, True)


class Code:
    """Methods as lists of statements, turned into fact tables."""

    def __init__(self):
        self.rows = {n: [] for n in ("stmt", "cfg_edge", "assign", "load", "store", "alloc", "call", "call_edge", "arg", "param", "ret", "method", "static_load", "static_store")}

    def method(self, name, params, *body, this=None):
        r = self.rows
        r["method"].append(METHOD(name))
        r["param"] += [(name, i, v) for i, v in enumerate(params)] + ([(name, -1, this)] if this else [])
        stmts = [("nop",), *body]
        for i, (kind, *x) in enumerate(stmts):
            s = f"{name}:{i}"
            r["stmt"].append((s, name, i, kind))
            if i:
                r["cfg_edge"].append((f"{name}:{i - 1}", s))
            if kind == "new":
                r["alloc"].append((s, x[0], x[1], x[2] if len(x) > 2 else "new", None))
            elif kind == "call":  # lhs, recv, sig, args, callees
                r["call"].append((s, x[1], x[2], "virtual" if x[1] else "static", x[0]))
                r["arg"] += [(s, k, v) for k, v in enumerate(x[3])] + ([(s, -1, x[1])] if x[1] else [])
                r["call_edge"] += [(s, name, c, "static") for c in x[4]]
            elif kind != "nop":
                r[{"static_load": "static_load", "static_store": "static_store"}.get(kind, kind)].append((s, *x))
        return self

    def program(self, spark, **more):
        return Program.of(spark, **{k: v for k, v in {**self.rows, **more}.items() if v})


CASES = {
    "array cells are one": (
        [("main", [], ("new", "arr", "T[]", "new_array"), ("new", "a1", "A"), ("store", "arr", "array", "a1"), ("new", "a2", "B"), ("store", "arr", "array", "a2"), ("load", "q", "arr", "array"), ("nop",))],
        ("main:6", "q"), {"main:2", "main:4"},
    ),
    "store through an alias": ([("main", [], ("new", "a", "T"), ("assign", "e", "a"), ("new", "x", "A"), ("store", "e", "b", "x"), ("load", "q", "a", "b"), ("nop",))], ("main:5", "q"), {"main:3"}),
    "load twice, store through the first": (
        [("main", [], ("new", "a", "T"), ("new", "l", "N"), ("store", "a", "left", "l"), ("load", "t", "a", "left"), ("load", "u", "a", "left"), ("new", "x", "A"), ("store", "t", "right", "x"), ("load", "q", "u", "right"), ("nop",))],
        ("main:8", "q"), {"main:6"},
    ),
    "fields are kept apart": ([("main", [], ("new", "a", "T"), ("new", "x", "A"), ("new", "y", "B"), ("store", "a", "f", "x"), ("store", "a", "g", "y"), ("load", "q", "a", "g"), ("nop",))], ("main:6", "q"), {"main:3"}),
    "overwritten local": ([("main", [], ("new", "q", "A"), ("new", "q", "B"), ("nop",))], ("main:2", "q"), {"main:2"}),
    "query in the callee": ([("main", [], ("new", "x", "A"), ("call", None, None, "m", ["x"], ["m"])), ("m", ["p"], ("nop",))], ("m:1", "p"), {"main:1"}),
    "two contexts": ([("main", [], ("new", "x", "A"), ("call", None, None, "m", ["x"], ["m"]), ("new", "y", "B"), ("call", None, None, "m", ["y"], ["m"])), ("m", ["p"], ("nop",))], ("m:1", "p"), {"main:1", "main:3"}),
    "returns go to their own call": (
        [("main", [], ("new", "x", "A"), ("call", "q", None, "id", ["x"], ["id"]), ("new", "y", "B"), ("call", "r", None, "id", ["y"], ["id"]), ("nop",)), ("id", ["p"], ("nop",), ("ret", "p"))],
        ("main:5", "q"), {"main:1"},
    ),
    "recursion": ([("main", [], ("new", "x", "A"), ("call", None, None, "m", ["x"], ["m"])), ("m", ["p"], ("call", None, None, "m", ["p"], ["m"]), ("nop",))], ("m:0", "p"), {"main:1"}),
    "allocated below, returned": ([("main", [], ("call", "q", None, "mk", [], ["mk"]), ("nop",)), ("mk", [], ("new", "z", "A"), ("ret", "z"))], ("main:2", "q"), {"mk:1"}),
    "container moved to another": (
        [("main", [], ("new", "c", "C"), ("new", "x", "A"), ("store", "c", "f", "x"), ("new", "d", "D"), ("load", "t", "c", "f"), ("store", "d", "f", "t"), ("call", None, None, "m", ["d"], ["m"])), ("m", ["p"], ("load", "q", "p", "f"), ("nop",))],
        ("m:2", "q"), {"main:2"},
    ),
    "static field": ([("main", [], ("new", "x", "A"), ("static_store", "S.f", "x"), ("static_load", "q", "S.f"), ("nop",))], ("main:3", "q"), {"main:1"}),
    "load before the store": ([("main", [], ("new", "w", "N"), ("load", "q", "w", "f"), ("new", "v", "A"), ("store", "w", "f", "v"), ("nop",))], ("main:5", "q"), set()),
    "overwritten field": ([("main", [], ("new", "w", "N"), ("new", "a", "A"), ("store", "w", "f", "a"), ("new", "b", "B"), ("store", "w", "f", "b"), ("load", "q", "w", "f"), ("nop",))], ("main:6", "q"), {"main:4"}),
    "an alias in the caller": (
        [("main", [], ("new", "c", "C"), ("assign", "e", "c"), ("new", "x", "A"), ("call", None, None, "put", ["c", "x"], ["put"]), ("load", "q", "e", "f"), ("nop",)), ("put", ["b", "v"], ("store", "b", "f", "v"), ("nop",))],
        ("main:5", "q"), {"main:3"},
    ),
    "an alias before the call": (
        [("main", [], ("new", "c", "C"), ("assign", "e", "c"), ("new", "x", "A"), ("load", "q", "e", "f"), ("call", None, None, "put", ["c", "x"], ["put"]), ("nop",)), ("put", ["b", "v"], ("store", "b", "f", "v"), ("nop",))],
        ("main:6", "q"), set(),
    ),
    "an alias two calls up": (
        [("main", [], ("new", "c", "C"), ("assign", "e", "c"), ("new", "x", "A"), ("call", None, None, "put2", ["c", "x"], ["put2"]), ("load", "q", "e", "f"), ("nop",)), ("put2", ["b2", "v2"], ("call", None, None, "put", ["b2", "v2"], ["put"]), ("nop",)), ("put", ["b", "v"], ("store", "b", "f", "v"), ("nop",))],
        ("main:5", "q"), {"main:3"},
    ),
    "stored below, allocated below": (
        [("main", [], ("call", "c", None, "mk", [], ["mk"]), ("assign", "e", "c"), ("load", "q", "e", "f"), ("nop",)), ("mk", [], ("new", "z", "C"), ("new", "s", "A"), ("store", "z", "f", "s"), ("ret", "z"))],
        ("main:3", "q"), {"mk:2"},
    ),
    "an alias behind a field": (
        [("main", [], ("new", "a", "N"), ("new", "b", "B"), ("store", "a", "g", "b"), ("assign", "c", "a"), ("new", "x", "A"), ("store", "b", "f", "x"), ("load", "t", "c", "g"), ("load", "q", "t", "f"), ("nop",))],
        ("main:8", "q"), {"main:5"},
    ),
    "calls keep their fields apart": (
        [("main", [], ("new", "c", "C"), ("new", "x", "A"), ("call", None, None, "put", ["c", "x"], ["put"]), ("new", "d", "D"), ("assign", "e", "d"), ("new", "y", "B"), ("call", None, None, "put", ["d", "y"], ["put"]), ("load", "q", "e", "f"), ("nop",)), ("put", ["b", "v"], ("store", "b", "f", "v"), ("nop",))],
        ("main:8", "q"), {"main:6"},
    ),
    "stored in the callee": ([("main", [], ("new", "c", "C"), ("new", "x", "A"), ("call", None, None, "put", ["c", "x"], ["put"]), ("load", "q", "c", "f"), ("nop",)), ("put", ["b", "v"], ("store", "b", "f", "v"), ("nop",))], ("main:4", "q"), {"main:2"}),
}


@pytest.fixture(scope="module")
def solved(spark):
    code = Code()
    for k, (methods, _, _) in enumerate(CASES.values()):
        for name, params, *body in methods:
            fix = lambda x, k=k: f"{k}/{x}" if x else x
            moved = []
            for kind, *x in body:
                if kind == "call":
                    x = [fix(x[0]), fix(x[1]), x[2], [fix(a) for a in x[3]], [fix(c) for c in x[4]]]
                elif kind in ("load", "store"):
                    x = [fix(v) if i != {"load": 2, "store": 1}[kind] else v for i, v in enumerate(x)]
                elif kind == "new":
                    x = [fix(x[0]), *x[1:]]
                elif kind in ("assign", "ret"):
                    x = [fix(v) for v in x]
                elif kind == "static_store":
                    x = [fix(x[0]), fix(x[1])]
                elif kind == "static_load":
                    x = [fix(x[0]), fix(x[1])]
                moved.append((kind, *x))
            code.method(fix(name), [fix(v) for v in params], *moved)
    return A.solve(code.program(spark))


def test_points_to(spark, solved):
    queries = spark.createDataFrame([(name, f"{k}/{q[0]}", f"{k}/{q[1]}") for k, (name, (_, q, _)) in enumerate(CASES.items())], "query string, stmt string, val string")
    got = {}
    for r in A.points_to(solved, queries).collect():
        got.setdefault(r["query"], set()).add(r["alloc_stmt"].split("/")[1])
    assert got == {name: want for name, (_, _, want) in CASES.items() if want}


def test_aliases_types_and_paths(spark, solved):
    k = list(CASES).index("store through an alias")
    at, q = f"{k}/main:5", f"{k}/q"
    pairs = spark.createDataFrame([(1, f"{k}/main:2", f"{k}/a", f"{k}/main:2", f"{k}/e"), (2, f"{k}/main:3", f"{k}/a", f"{k}/main:3", f"{k}/x")], "query int, stmt string, val string, other_stmt string, other string")
    assert {r["query"]: r["alias"] for r in A.may_alias(solved, pairs).collect()} == {1: True, 2: False}
    queries = spark.createDataFrame([("p", at, q)], "query string, stmt string, val string")
    assert [r["type"] for r in A.possible_types(solved, queries).collect()] == ["A"]
    paths = {(r["base"].split("/")[1], *r["fields"]) for r in A.access_paths(solved, queries).collect()}
    assert {("q",), ("x",), ("e", "b")} <= paths


def test_contexts(spark, solved):
    k = list(CASES).index("two contexts")
    queries = spark.createDataFrame([(1, f"{k}/m:1", f"{k}/p")], "query int, stmt string, val string")
    assert {r["call_site"].split("/")[1] for r in A.contexts(solved, queries).collect()} == {"main:2", "main:4"}


def test_call_graph_and_uses(spark):
    code = Code().method("main", [], ("new", "x", "Sub"), ("call", None, "x", "go()", [], []), ("new", "n", "null", "null"), ("call", None, "n", "go()", [], []), ("nop",)).method("Base.go", [], ("nop",), this="t")
    p = code.program(spark, subtype=[("Sub", "Base")], vtable=[("Base", "go()", "Base.go"), ("Other", "go()", "Other.go")])
    full, s = A.call_graph(p, spark.createDataFrame([("main",)], "method string"))
    assert [tuple(r)[:3] for r in full.call_edge.collect()] == [("main:2", "main", "Base.go")]
    assert ("Base.go:1", "t") in {(r["stmt"], r["val"]) for r in s.points.collect()}
    assert {(r["stmt"], r["sig"]) for r in A.invoked_methods(s).collect()} == {("main:2", "go()")}
    nulls = A.solve(p, None, A.Options(track_nulls=True))
    assert {(r["stmt"], r["val"]) for r in A.null_dereferences(nulls).collect()} == {("main:4", "n")}
    assert "main:2" in {r["stmt"] for r in A.last_uses(s).collect()}
    got = dispatch(p, spark.createDataFrame([("s", "Sub[]", "go()"), ("t", "None", "go()")], "site string, type string, sig string"))
    assert [tuple(r) for r in got.collect()] == [("s", "Sub[]", "Base.go")] or [r["method"] for r in got.collect()] == ["Base.go"]


def test_constants_and_order(spark):
    rows = spark.createDataFrame([("a", "m", 0, "x", None), ("b", "m", 1, "y", "7")], "stmt string, method string, ord long, lhs string, const string")
    got = [(r["stmt"], r["ord"], r["lhs"], r["rhs"]) for r in named_constants(rows).orderBy("ord").collect()]
    assert got == [("a", 0, "x", None), ("b$c", 1, "const$b", "7"), ("b", 2, "y", "const$b")]
    assert [tuple(r) for r in straight_line_edges(rows.select("stmt", "method", "ord").withColumn("kind", F.lit("nop"))).collect()] == [("a", "b")]
