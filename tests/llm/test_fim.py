"""Fill-in-middle against a plain reading of its rules."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pushgraph.llm import fim
from pushgraph.llm.fim import fill_in_middle, restored

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    t = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(t), "plain", None, None, text
    x, y, z = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h4 % 100 < 80:
        return doc_id, len(t), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, len(t), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def odd_texts(r, n):
    parts = ["word", "é", "漢字", " ", "\n", "\t\x0b", "<", "<P", "<P>", "S>", "<S", "M", ">", "P", "<<M>", " ", "𝄞"]
    return ["".join(r.choice(parts[:6] if r.random() < 0.6 else parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 16])
def test_against_rules(spark, chunk):
    r = random.Random(chunk)
    rows = list(enumerate(odd_texts(r, 60 if chunk < 64 else 400)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "a"), (1004, " a "), (None, "no id here"), rows[3], rows[3], (rows[4][0], "another text of one id"), (-5, "x" * 3000 + " y"), (1006, "a <P\n> b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "who": F.lit(1), "form": F.lit(0)}).repartition(3)
    out = fill_in_middle(df, chunk_bytes=chunk)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((*x,)[:6] for x in got), key=repr) == sorted((plain(*x) for x in rows), key=repr)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    assert all(x["back"] in texts[x["doc_id"]] for x in got)


def test_empty(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_functions_compose():
    """The function of a text is that of its chunks one after the other, from every start state, wherever it is cut."""
    r = random.Random(9)
    for text in odd_texts(r, 60):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = fim.functions(data, np.array([0, len(data)]))
        for _ in range(3):
            at = np.array(sorted([0, len(data), *(r.randint(0, len(data)) for _ in range(4))]))
            states, counts = fim.functions(data, at)
            f = np.arange(fim.STATES, dtype=np.uint8)[None], np.zeros((1, fim.STATES), np.int64)
            for i in range(len(at) - 1):
                f = fim._then(f, (states[i : i + 1], counts[i : i + 1]))
            assert (f[0] == whole[0]).all() and (f[1] == whole[1]).all()
        for s in range(fim.STATES):  # and that of reading it byte by byte
            state, n = s, 0
            for c in fim.CLASS[data]:
                n += fim.ENDS[c, state]
                state = fim.STEP[c, state]
            assert (state, n) == (whole[0][0, s], whole[1][0, s])
