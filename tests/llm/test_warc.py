"""Revisit resolution against a brute force, over several time spans."""

import random
from datetime import datetime, timedelta

import pytest

from pushgraph.llm import warc as R

SCHEMA = "record_id long, url string, ts timestamp_ntz, type string, etag string, last_modified string, headers map<string,string>, verdict string"


def brute(rows):
    out = []
    for i, u, t, kind, tag, when, heads, _ in rows:
        if kind != "revisit":
            continue
        early = [r for r in rows if r[3] == "response" and u is not None and t is not None and r[1] == u and r[2] is not None and r[2] < t]
        hit = max(early, key=lambda r: (r[2], r[0]), default=None)
        if hit is None:
            out.append((i, "missing", None, None))
            continue
        tags = (tag and tag.removeprefix("W/"), hit[4] and hit[4].removeprefix("W/"))
        if None not in tags:
            verdict = "resolved" if tags[0] == tags[1] else "mismatch"
        elif when is not None and hit[5] is not None:
            verdict = "resolved" if when == hit[5] else "mismatch"
        else:
            verdict = "unchecked"
        merged = {**(hit[6] or {}), **{k: v for k, v in (heads or {}).items() if k in R.PERMITTED}} if verdict == "resolved" else None
        out.append((i, verdict, hit[0], merged))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    r = random.Random(seed)
    start, rows = datetime(2024, 1, 1), []
    for i in range(250):
        url = r.choice(["hot.org/a"] * 5 + [f"h{k}.org/p" for k in range(9)] + [None])
        ts = start + timedelta(seconds=r.randint(0, 900) * 10) if r.random() < 0.95 else None
        kind = r.choice(["response", "revisit", "revisit", "metadata"])
        heads = r.choice([None, {"etag": "x", "content-length": str(i), "date": str(i)}, {"server": "s", "vary": "v"}])
        rows.append((i, url, ts, kind, r.choice([None, '"a"', 'W/"a"', '"b"']), r.choice([None, "t1", "t2"]), heads, "x"))
    got = R.resolve_revisits(spark.createDataFrame(rows, SCHEMA), span_seconds=600).collect()
    assert sorted(((g["record_id"], g["verdict"], g["response_id"], g["headers"]) for g in got), key=repr) == [(a, b, c, d) for a, b, c, d in sorted([(a, b, c, dict(sorted(d.items())) if d is not None else None) for a, b, c, d in brute(rows)], key=repr)]


def test_canonical_url(spark):
    urls = {"HTTP://WWW.Ex.org:80/A/?b=2&utm_source=f&a=1#top": "ex.org/A?a=1&b=2", "https://ex.org": "ex.org", "https://ex.org:443/?b": "ex.org?b", "https://ex.org:80/a": "ex.org:80/a", "http://ex.org:443": "ex.org:443", "http://ex.org:8080": "ex.org:8080", "ex.org:80": "ex.org", "ex.org/?ref=x": "ex.org", "": "", None: None}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", R.canonical_url(R.F.col("url")).alias("k")).collect()
    assert {r["url"]: r["k"] for r in got} == urls


def test_empty_and_repeated(spark):
    assert R.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
    row = (1, "a.org", datetime(2024, 1, 1), "revisit", None, None, None, "")
    assert R.resolve_revisits(spark.createDataFrame([row, row], SCHEMA)).count() == 2


def test_header_names_in_any_case(spark):
    from pyspark.sql import functions as F

    from pushgraph.llm.warc import lower_names

    rows = spark.createDataFrame([({"ETag": "a", "Etag": "b", "Date": "d", "x": None},), ({},)], "h map<string,string>")
    assert [dict(r[0]) for r in rows.select(lower_names(F.col("h"))).collect()] == [{"etag": "a, b", "date": "d", "x": None}, {}]
