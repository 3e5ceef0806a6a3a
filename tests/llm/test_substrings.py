"""Repeated windows against a brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pushgraph.llm.substrings import repeated_words
from tests.llm.conftest import words


def brute(rows):
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 16), (3, 18)])
def test_brute_force(spark, seed, bits):
    r = random.Random(seed)
    vocab = [f"v{i}é" for i in range(50)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(80):
        t = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if r.random() < 0.5:
            a = r.randint(0, 40)
            t[10:10] = passage[a : a + r.randint(10, 40)]
        if rows and r.random() < 0.2:
            t = words(r.choice(rows)[1])
        rows.append((i, r.choice([" ", "\n", "\t "]).join(t)))
    rows += [(80, None), (81, ""), (None, rows[3][1]), (5, rows[5][1]), (7, rows[8][1]), (-3, rows[9][1]), (90, " ".join(["same"] * 40)), (91, " ".join(["same"] * 12))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(5)
    got = repeated_words(df, bits=bits).drop("removed").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(spark):
    assert repeated_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []
