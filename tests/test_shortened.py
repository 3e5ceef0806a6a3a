"""Runs of statements, and calls of short methods, are taken at once: rows of several steps lie beside those of each step."""

from pushgraph.operators import flows
from tests.test_alias import Code


def test_runs_and_calls_are_taken_at_once(spark):
    code = Code().method("same", ["p"], ("nop",), ("ret", "p")).method("put", ["b", "o"], ("store", "b", "f", "o"), ("nop",)).method("get", ["c"], ("load", "r", "c", "f"), ("ret", "r"))
    code.method("m", [], ("new", "v", "T"), ("new", "w", "T"), ("call", None, None, "put()", ["w", "v"], ["put"]), ("call", "y", None, "same()", ["v"], ["same"]), ("call", "x", None, "get()", ["w"], ["get"]), ("nop",))
    p = code.program(spark)
    at = spark.createDataFrame([(1, "m:2", "v"), (1, "m:2", "w"), (1, "m:3", "v"), (1, "m:4", "w")], "qid long, stmt string, val string")

    def rows(**how):
        flow = flows.forward(p, **how)
        out = {tuple(r) for r in flow(at).select("stmt", "val", "kind", "sym", "to_stmt", "to_val").collect()}
        flow.release()
        return out

    plain, short = rows(), rows(shorten=True)
    assert plain <= short and {r[2] for r in short - plain} == {"normal", "exclude", "field_pop"}
    assert short - plain == {
        *(("m:2", "v", "normal", "", f"m:{i}", "v") for i in (3, 4, 5, 6)), ("m:3", "v", "normal", "", "m:4", "v"), ("m:3", "v", "normal", "", "m:5", "v"), ("m:3", "v", "normal", "", "m:6", "v"), ("m:3", "v", "normal", "", "m:4", "y"),
        *(("m:2", "w", "exclude", "f", f"m:{i}", "w") for i in (3, 4, 5, 6)), ("m:4", "w", "normal", "", "m:5", "w"), ("m:4", "w", "normal", "", "m:6", "w"), ("m:4", "w", "field_pop", "f", "m:5", "x"),
    }
