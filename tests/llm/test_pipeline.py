"""The corpus pipeline on a small corpus: every stage against brute force on what it was given."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from pushgraph.session import written
from tests.llm.conftest import words
from tests.llm.test_ngram_join import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(8)
    vocab = ["".join(r.choice("bcdghklmnp") for _ in range(5)) for _ in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(5)]
    rows, labels = [], []
    for i in range(220):
        t = [r.choice(vocab) for _ in range(r.randint(20, 90))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(4):
                t.insert(r.randint(0, len(t)), r.choice(["moron", "idiot", "scum"]))
        if i % 25 == 7:
            t[4:4] = words(r.choice(items)[1])
        if i % 30 == 11:
            t += ["token", "=", f'"{r.getrandbits(160):040x}"']
        if i % 20 == 3:
            t = words(rows[i - 2][1])
        rows.append((i, " ".join(t), "en", f"src{i % 4}", len(" ".join(t))))
        labels.append((i, int(toxic)))
    rows += [(220, None, "en", "src0", 0), (221, "", "en", None, 0), (5, *rows[5][1:])]
    return rows, items, labels


def test_stages(spark, tmp_path):
    rows, items, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, str(tmp_path)))
        seen.append((name, before, [tuple(r) for r in docs.collect()]))
        if name != "mix":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    kept = {name: (sorted(b, key=repr), sorted(a, key=repr)) for name, b, a in seen}
    b, a = kept["toxicity"]
    assert a == [x for x in b if not any(w in (x[1] or "").split() for w in ("moron", "idiot", "scum"))]
    b, a = kept["near_copies"]
    groups = {}
    for d, n, c in brute([x[:2] for x in b]):
        groups.setdefault(c if n else ("empty", d), set()).add(d)
    assert sorted(x[0] for x in a) == sorted(min(g) for g in groups.values()) and set(a) <= set(b)
    b, a = kept["benchmark"]
    assert a == [x for x in b if not any(words(i)[:30] == words(x[1])[k : k + 30] for _, i in items for k in range(len(words(x[1]))))]
    b, a = kept["secrets"]
    assert len(a) == len(b) and any("[REDACTED]" in (x[1] or "") for x in a) and {x[0] for x in a if "[REDACTED]" in (x[1] or "")} == {x[0] for x in b if "token =" in (x[1] or "")}
    b, a = kept["mix"]
    total = sum(len(words(x[1])) for x in b)
    assert len(a) == len(b) and abs(sum(x[4] for x in a) - total) <= 5
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect()), key=repr) == a


def test_clashing_columns(spark, tmp_path):
    rows, items, labels = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = ("score", "predicted", "cuts", "class", "kind", "once", "component", "h", "item_id", "size", "toxic", "spans")
    docs = spark.createDataFrame([(*x, *(f"{c}{x[0]}" for c in more)) for x in rows[:40]], COLUMNS + "".join(f", {c} string" for c in more))
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns[5:] == list(more) and docs.filter(docs.score != F.concat(F.lit("score"), "doc_id")).isEmpty(), name
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 20


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0
