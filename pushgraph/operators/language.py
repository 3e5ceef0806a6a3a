"""Automata as regular expressions: the field and call languages of a fact."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.operators.pds import EMPTY, EPS


def _concat(a: str, b: str) -> str:
    wrap = lambda x: f"({x})" if "|" in x and not (x.startswith("(") and _closes(x)) else x
    return a if not b else b if not a else f"{wrap(a)} {wrap(b)}"


def _closes(x: str) -> bool:
    """Whether the first bracket of x closes at its end."""
    depth = 0
    for i, c in enumerate(x):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i == len(x) - 1
    return False


def _either(a: str | None, b: str | None) -> str | None:
    if a is None or b is None or a == b:
        return b if a is None else a
    parts = sorted({*_alternatives(a), *_alternatives(b)})
    return "|".join(parts)


def _alternatives(x: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(x):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append(x[last:i])
            last = i + 1
    return [*out, x[last:]]


def eliminate(edges: list[tuple[str, str, str]], start: str, final: str) -> str | None:
    """Expression of the words from start to final: labels parted by spaces, | between choices, * after brackets; None where
    there are none. Epsilon and the empty stack's label read nothing."""
    arcs: dict[tuple[str, str], str] = {}
    for a, label, b in edges:
        new = "" if label in (EPS, EMPTY) else label
        arcs[a, b] = _either(arcs.get((a, b)), new)
    for a, b in ((" in", start), (final, " out")):
        arcs[a, b] = _either(arcs.get((a, b)), "")
    states = {x for arc in arcs for x in arc} - {" in", " out"}
    degree = lambda s: (sum(a == s for a, _ in arcs) * sum(b == s for _, b in arcs), s)
    while states:
        s = min(states, key=degree)
        states.remove(s)
        loop = arcs.pop((s, s), None)
        again = f"({loop})*" if loop else ""
        into = [(a, x) for (a, b), x in arcs.items() if b == s]
        out = [(b, x) for (a, b), x in arcs.items() if a == s]
        for a, x in into:
            for b, y in out:
                arcs[a, b] = _either(arcs.get((a, b)), _concat(_concat(x, again), y))
        arcs = {k: v for k, v in arcs.items() if s not in k}
    return arcs.get((" in", " out"))


def languages(trans: DataFrame, ends: DataFrame) -> DataFrame:
    """trans (qid, src, label, dst) and ends (qid, start, final) -> (qid, start, final, regex).

    One automaton, which is small, is one group; automata are spread by qid.
    """

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        edges = list(left[["src", "label", "dst"]].itertuples(index=False, name=None))
        rows = [(r.qid, r.start, r.final, eliminate(edges, r.start, r.final)) for r in right.itertuples()]
        return pd.DataFrame(rows, columns=["qid", "start", "final", "regex"])

    both = trans.select("qid", "src", "label", "dst").distinct().groupBy("qid").cogroup(ends.select("qid", "start", "final").distinct().groupBy("qid"))
    return both.applyInPandas(solve, "qid long, start string, final string, regex string")


def reversed_automaton(trans: DataFrame) -> DataFrame:
    return trans.select("qid", F.col("dst").alias("src"), "label", F.col("src").alias("dst"))


def to_python(regex: str) -> re.Pattern:
    """A pattern over words whose labels are each followed by a space."""
    return re.compile(re.sub(r"[^\s()|*]+", lambda m: rf"(?:{re.escape(m[0])}\ )", regex), re.VERBOSE)
