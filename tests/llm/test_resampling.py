"""Importance resampling against a brute force; its checksums and merges."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pushgraph.llm import crc, resampling, tournament

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    b = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for g in grams(x)[1]:
                into[b(g)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (S + 10000) / ((s[i] + 1) * (T + 10000)))) for i in range(10000)]
    rows = []
    for d, x in docs:
        n, f = grams(x)
        weight = sum(gain[b(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def odd_rows(seed, n):
    r = random.Random(seed)
    vocab = ["The", "é", "ÉA", "x1", "漢字", "quick", "brown-fox", "a_b", "1.5", " ", "don't", "z" * 70, "y" * 200]
    return [(i, r.choice([" ", "\n", ", "]).join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("size,range_rows,ranges", [(300, 1 << 16, 4096), (700, 50, 4096), (700, 10, 5)])
def test_brute_force(spark, size, range_rows, ranges):
    docs = odd_rows(size, size)
    docs += [(9000, None), (9001, ""), (9002, "!!! ???"), (None, docs[3][1] * 3), (-7, docs[4][1] * 2)]
    target = [x for _, x in odd_rows(5, 8)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("x"), "seq": F.lit(1), "score": F.lit(0)}).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(x, 1) for x in target], "text string, item_id long"), range_rows=range_rows, most_ranges=ranges)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


def test_long_texts_in_parts(spark, monkeypatch):
    """A text above the piece size is read in parts; runs of words across them count once."""
    monkeypatch.setattr(resampling, "PIECE", 64)
    import pyarrow as pa

    docs = odd_rows(3, 40) + [(50, "a bc " * 300), (51, "q" * 500 + " r s"), (52, None), (53, "  ")]
    batch = pa.RecordBatch.from_pydict({"text": [x for _, x in docs]})
    found = [[] for _ in docs]
    for i, _, keys, rows, _ in resampling.features(batch, "text", 10000):
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            found[i + r].append(k)
    for (_, x), f in zip(docs, found, strict=True):
        assert sorted(f) == sorted(zlib.crc32(g.encode()) % 10000 for g in grams(x)[1])


def test_repeated_rows_and_empty(spark):
    many = [(1, "w " * 30)] * 400 + [(None, "w " * 30)] * 100
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    nothing = spark.createDataFrame([], "text string")
    got = resampling.resample(df, nothing, range_rows=16)
    rows = got.collect()
    assert len(rows) == 500 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 26))
    best = max(r["score"] for r in rows)
    assert all(r["score"] == best for r in rows if r["rank"])
    assert resampling.resample(df.limit(0), nothing).collect() == []


def test_checksums():
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(r.choice([1, 2, 5, 63, 64, 65, 66, 200, 5000]))) for _ in range(200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    one = crc.of_words(data, ends - [len(t) for t in texts], ends)
    assert one.tolist() == [zlib.crc32(t) for t in texts]
    two = crc.moved(crc.spaced(one[:-1]), np.array([len(t) for t in texts[1:]])) ^ one[1:]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(texts[:-1], texts[1:], strict=True)]


def test_tournament():
    r = random.Random(2)
    tree, runs = tournament.Tournament(), [sorted((r.randint(0, 30), r.randint(0, 3), i * 1000 + j) for j in range(r.randint(1, 40))) for i in range(13)]
    pages = sorted(([run[i : i + 7] for run in runs for i in range(0, len(run), 7)]), key=lambda p: p[0])
    got = []
    for page in pages:
        got += [x for part in tree.below(page[0]) for x in zip(*part, strict=True)]
        tree.add(tournament.Page(tuple(np.array(c) for c in zip(*page, strict=True))))
    got += [x for part in tree.below(tournament.LAST) for x in zip(*part, strict=True)]
    assert [tuple(map(int, x)) for x in got] == sorted(x for run in runs for x in run)
    assert tree.size <= 16  # one open page of each run
