"""Line dedup against a brute force, and its runs."""

import random
import re

from pyspark.sql import functions as F

from pushgraph.llm.line_dedup import LineRuns, cut_lines

LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def brute(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(float("-inf") if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        at = float("-inf") if d is None else d
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or at == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_brute_force(spark):
    r = random.Random(7)
    common = [f"Ligne commune numéro {i} Éa" for i in range(6)] + ["a plain ASCII line that REPEATS", "x" * 19, "é" * 20]
    rows = []
    for i in range(200):
        lines = [r.choice([r.choice(common), r.choice(common).upper(), f" \t{r.choice(common)}\r", f"only here {i} {r.random()}", ""]) for _ in range(r.randint(0, 12))]
        rows.append((i * 3 - 100, "\n".join(lines)))
    rows += [(None, common[0]), (None, "\n" + common[1] + "\n"), (1000, None), (1001, ""), (1002, "\n\n"), (rows[5][0], rows[5][1]), (rows[9][0], common[2] + "\n" + common[2]), (1003, "\n".join(common * 300))]
    rows += [(2000 + i, "the one line that stands everywhere\nand one of its own " + str(i)) for i in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "lines": F.lit(1), "keeper": F.lit(2)}).repartition(4)
    for batches, fanout in ((6, 3), (1, 2), (5, 2)):
        assert sorted(map(tuple, cut_lines(df, batches=batches, fanout=fanout).collect()), key=repr) == brute(rows)
    assert cut_lines(df.limit(0)).collect() == []


def test_levels(spark):
    """Batches in any order: runs are compacted level by level, lines that are settled are not written again."""
    r = random.Random(8)
    runs, seen = LineRuns(spark, fanout=2), {}
    docs = list(range(70))
    r.shuffle(docs)
    for b in range(7):
        rows = [(r.randint(0, 30), 0, d) for d in docs[b * 10 : b * 10 + 10] for _ in range(4)]
        for h, _, d in rows:
            seen.setdefault(h, set()).add(d)
        runs.add(spark.createDataFrame(rows, "h long, g int, doc long"))
        assert [len(x) for x in runs.levels][::-1] == [int(c) for c in f"{b + 1:b}".zfill(len(runs.levels))]
    got = {x["h"]: x["keeper"] for x in runs.settled().collect()}
    assert got == {h: max(d) for h, d in seen.items() if len(d) >= 3}
    before = sum(spark.table(x).count() for level in runs.levels for x in level)
    low = [(h, 0, -1) for h in got]
    runs.add(spark.createDataFrame(low, "h long, g int, doc long"))
    assert [len(x) for x in runs.levels] == [0, 0, 0, 1] and before >= len(got)
    assert {x["h"]: x["keeper"] for x in runs.settled().collect()} == got
    runs.release()


def test_no_python_and_merge_joins(spark):
    df = spark.createDataFrame([(i, "a line of more than twenty letters") for i in range(9)], "doc_id long, text string")
    plan = cut_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    runs = LineRuns(spark, buckets=4)
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3)], "h long, g int, doc long")
    runs.add(rows)
    own = rows.groupBy("h", "g").agg(F.max("doc").alias("keeper"))
    run = spark.table(runs.levels[0][0]).select(F.col("h").alias("r_h"), F.col("g").alias("r_g"))
    joined = own.join(run.hint("merge"), (F.col("h") == F.col("r_h")) & (F.col("g") == F.col("r_g")), "left_anti")
    shown = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in shown and "Bucketed: true" in shown
    runs.release()
