"""Pushdown saturation: literal vectors, all in one batch, and a plain worklist on random systems."""

import random

import pytest

from pushgraph.functions import semiring as S
from pushgraph.operators import pds
from tests import fixtures

RULES = "qid long, kind string, s1 string, l1 string, s2 string, l2 string, site string, w long"
TRANS = "qid long, src string, label string, dst string, w long"


def kind_of(name):
    return ("pre" if "Pre" in name.split(".")[0] else "post", S.MIN_PLUS if name.startswith("Min") else S.NUM if name.startswith("W") else S.UNWEIGHTED)


def test_vectors(spark):
    cases = fixtures.pushdown()
    assert len(cases) == 29
    for which in {kind_of(c[0]) for c in cases}:
        batch = [(q, c) for q, c in enumerate(cases) if kind_of(c[0]) == which]
        rules = spark.createDataFrame([(q, *r) for q, c in batch for r in c[2]], RULES)
        start = spark.createDataFrame([(q, *t) for q, c in batch for t in c[1]], TRANS)
        run = pds.pre_star if which[0] == "pre" else pds.post_star
        found = {}
        for r in run(rules, start, which[1]).total.collect():
            found.setdefault(r["qid"], {})[(r["src"], r["label"], r["dst"])] = r["w"]
        for q, (name, _, _, exact, held, counts) in batch:
            got = found[q]
            if exact is not None:
                assert set(got) == exact, name
            for t, w in held:
                assert t in got, (name, t)
                if w is not None:
                    assert got[t] == (None if w == "ZERO" else int(w)), (name, t)
            if counts[0] is not None:
                assert len(got) == counts[0], name
            if counts[1] is not None:
                assert len({x for t in got for x in (t[0], t[2])}) == counts[1], name


def worklist(rules, start, combine):
    """Plain saturation of (src, label, dst) -> weight, by rounds over everything."""
    trans = dict(start)
    while True:
        new = dict(trans)

        def add(t, w):
            if t[0] != t[2] or t[1] != "eps":
                new[t] = w if t not in new else combine(new[t], w)

        for (p, g, q), w in trans.items():
            for kind, s1, l1, s2, l2, site, v in rules:
                if s1 != p or l1 != g:
                    continue
                if kind == "normal":
                    add((s2, l2, q), w + v)
                elif kind == "push":
                    ir = f"<{s2}|{l2}>"
                    add((ir, site, q), w + v)
                    add((s2, l2, ir), 0)
                elif q.startswith("<"):
                    add((s2, "eps", q), w + v)
            if g == "eps":
                for (a, b, c), x in trans.items():
                    if a == q and b != "eps":
                        add((p, b, c), x + w)
        if new == trans:
            return trans
        trans = new


def test_random_systems(spark):
    r = random.Random(7)
    cases = []
    for _ in range(12):
        rules = []
        for _ in range(r.randint(3, 9)):
            kind = r.choice(["normal", "normal", "push", "pop"])
            s1, s2, l1, l2, site = r.choice("pq"), r.choice("pq"), *(r.choice("abcd") for _ in range(3))
            if (kind, s1, l1) != ("normal", s2, l2):
                rules.append((kind, s1, l1, s2, "" if kind == "pop" else l2, site if kind == "push" else "", r.randint(0, 4)))
        cases.append(rules)
    rules = spark.createDataFrame([(q, *x) for q, c in enumerate(cases) for x in c], RULES)
    start = spark.createDataFrame([(q, "p", "a", "ACC", 0) for q in range(len(cases))], TRANS)
    got = {}
    for x in pds.post_star(rules, start, S.MIN_PLUS).total.collect():
        got.setdefault(x["qid"], {})[(x["src"], x["label"], x["dst"])] = x["w"]
    for q, c in enumerate(cases):
        assert got[q] == worklist(c, {("p", "a", "ACC"): 0}, min), c


def test_budget_gives_partial(spark):
    rules = spark.createDataFrame([(1, "normal", "p", chr(97 + i), "p", chr(98 + i), "", 1) for i in range(9)], RULES)
    start = spark.createDataFrame([(1, "p", "a", "ACC", 0)], TRANS)
    part = pds.post_star(rules, start, S.MIN_PLUS, max_rounds=3)
    assert part.timed_out and part.total.count() == 4


def test_wildcards_and_unbalanced(spark):
    rules = spark.createDataFrame([(1, "normal", "p", "*", "q", "*", "", 0), (1, "normal", "q", "*", "r", "not:a", "", 0), (1, "pop", "r", "b", "s", "", "", 0)], RULES)
    start = spark.createDataFrame([(1, "p", x, "U", 0) for x in "ab"], TRANS)
    open_at = spark.createDataFrame([(1, "U")], "qid long, state string")
    got = pds.post_star(rules, start, unbalanced=open_at)
    assert {tuple(t)[1:4] for t in got.total.collect()} == {("p", "a", "U"), ("p", "b", "U"), ("q", "a", "U"), ("q", "b", "U"), ("r", "b", "U"), ("s", "eps", "U")}
    assert [tuple(t)[:4] for t in pds.unbalanced_pops(got.total, rules, open_at).collect()] == [(1, "s", "b", "U")]
    plain = pds.instantiated(rules, spark.createDataFrame([(1, "a"), (1, "b")], "qid long, label string"))
    assert {t["src"] for t in pds.post_star(plain, start, unbalanced=open_at).total.collect()} == {"p", "q", "r", "s"}


@pytest.mark.parametrize("ring", ["typestate", "set_domain", "inference"])
def test_extend_and_combine(spark, ring):
    s = S.SEMIRINGS[ring]
    rows = {"typestate": ([("a", "b"), ("b", "b")], [("b", "c"), ("*", "*")]), "set_domain": ([], ["x"]), "inference": (["x"], ["y"])}[ring]
    df = spark.createDataFrame([rows], f"a {s.dtype}, b {s.dtype}")
    got = df.select(s.extend(S.F.col("a"), S.F.col("b")).alias("e")).first()["e"]
    want = {"typestate": [("a", "b"), ("a", "c"), ("b", "b"), ("b", "c")], "set_domain": ["x"], "inference": ["x", "y"]}[ring]
    assert [tuple(x) if ring == "typestate" else x for x in got] == want
