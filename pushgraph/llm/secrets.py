"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Spans are found with regular expressions in the JVM. Every candidate value is then counted by the
distinct repositories and owners that hold it: one that many owners or repositories hold is a copied example,
one that a single owner holds and that looks random is live-looking and gets a further ``live`` span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushgraph.session import table, written, written_counted

# Kinds in order, their patterns, the group that holds the secret, its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Greedy runs of 24 or more are the runs of [0-9a-f]+ that pass the length test.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
LIVE = "live"
NAMES = [k for k, *_ in KINDS] + [LIVE]


def _matches(kind: int, text: Column, found: Column) -> Column:
    """An element for each match: what lies before it since the last one, its length, its secret."""
    _, pattern, group, _ = KINDS[kind]
    value = lambda m: F.regexp_extract(m, pattern, group) if group else m
    # The pieces are bound to a lambda's variable, lest each match splits the text again.
    each = lambda between: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.get(between, i).alias("before"), F.length(m).alias("len"), value(m).alias("value")))
    bound = F.element_at(F.transform(F.array(F.transform(F.split(text, pattern, -1), F.length)), each), 1)
    return F.when(F.size(found) > 0, bound).otherwise(F.expr("cast(array() as array<struct<kind:int,nth:int,before:int,len:int,value:string>>)"))


def secret_spans(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """(row_id, doc_id, owner, repo, kind, start, end, value): a row for each base span, and one with
    a null kind for each document, so that none is lost.

    row_id tells input rows apart that share an id. Offsets are sums over the pieces between
    matches, in a window over one document's matches of one kind.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        F.to_json(F.struct(*(F.col(c).alias(f"r{i}") for i, c in enumerate(repo_cols)))).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    base = base.select("*", *(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias(f"found{i}") for i, (_, pattern, _, _) in enumerate(KINDS)))
    each = F.concat(*(_matches(i, F.col("text"), F.col(f"found{i}")) for i in range(len(KINDS))), F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("before"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("value"))))
    # Most rows have no match and stay where they are.
    rows = base.select("row_id", "doc_id", "owner", "repo", F.explode(each).alias("m")).select("row_id", "doc_id", "owner", "repo", "m.*")
    rows = written(rows)
    upto = Window.partitionBy("row_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.filter(F.col("kind").isNotNull()).withColumn("end", F.sum(F.col("before") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    spans = spans.filter(F.length("value") >= least)
    ids = rows.filter(F.col("kind").isNull()).withColumns({"start": F.lit(None).cast("long"), "end": F.lit(None).cast("long")})
    cols = ["row_id", "doc_id", "owner", "repo", "kind", "start", "end", "value"]
    return spans.select(*cols).unionByName(ids.select(*cols))


def ownership(spans: DataFrame, *, copied_owners: int = 3, copied_repos: int = 3) -> DataFrame:
    """(secret, n_spans, n_repos, n_owners, verdict) over the whole corpus, by hash of the value.

    verdict: ``copied`` where at least copied_owners owners or copied_repos repositories hold the value, ``live``
    where one owner does and the value looks random (see ``_random``), else ``shared``. Rows are first reduced to
    (hash, repository, owner), which happens before the shuffle.
    """
    held = spans.filter(F.col("kind").isNotNull()).groupBy(F.sha2("value", 256).alias("secret"), "repo", "owner").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    by_owner = held.groupBy("secret", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.min("value").alias("value"))
    found = by_owner.groupBy("secret").agg(F.sum("n").alias("n_spans"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.min("value").alias("value"))
    verdict = F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos), "copied").when((F.col("n_owners") == 1) & _random(F.col("value")), LIVE).otherwise("shared")
    return found.select("secret", "n_spans", "n_repos", "n_owners", verdict.alias("verdict"))


def _random(value: Column) -> Column:
    """Whether a value looks random: distinct characters for seven tenths of its length, 8 at most; and a digit, a capital
    after a small letter or one of +/=, unless it has the form of an access key or a long hex value."""
    distinct = F.size(F.array_distinct(F.split(value, ""))) >= F.least(F.lit(8), F.ceil(F.length(value) * 7 / 10).cast("int"))
    return distinct & value.rlike("[0-9]|[a-z][A-Z]|[+/=]|^AKIA[A-Z0-9]{16,}$|^[0-9a-f]{24,}$")


#: A value with more than this part of all spans is hot; at most as many values as its inverse can be.
HOT_PART = 1 / 4096


def _judged(spans: DataFrame, copied_owners: int) -> DataFrame:
    """Base spans with their value's verdict. Values with very many spans, which are few by the bound, are judged where the
    spans lie; the others meet their verdicts in a shuffle, where no value has more than a small part of the rows."""
    base, n = written_counted(spans.filter(F.col("kind").isNotNull()).withColumn("secret", F.sha2("value", 256)))
    verdicts = written(ownership(base, copied_owners=copied_owners).select("secret", "n_spans", "verdict"))
    is_hot = F.col("n_spans") > max(100, int(n * HOT_PART))
    hot = F.broadcast(verdicts.filter(is_hot).select("secret", "verdict"))  # 4,096 rows at most
    cold = verdicts.filter(~is_hot).select("secret", "verdict")
    marked = base.join(hot, "secret", "left")
    there = marked.filter(F.col("verdict").isNotNull())
    return there.unionByName(marked.filter(F.col("verdict").isNull()).drop("verdict").join(cold, "secret"))


def scan_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), copied_owners: int = 3
) -> DataFrame:
    """One row for each input row: (row_id, doc_id, spans, n_copied, n_shared, n_live).

    spans: array of (start, kind, end, verdict) in code points by start, then kind; base spans
    first, then a ``live`` span over each live-looking value. Null text counts as empty: no span. A null
    owner or repository column is a value of its own. Repeated rows each get a row; they count once
    as owner and repository. No rows: no rows. Further columns are ignored.
    """
    spans = secret_spans(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_cols=repo_cols)
    # Documents' own rows, which hold no value, go past the judgement.
    documents = spans.filter(F.col("kind").isNull()).select("row_id", "doc_id", "kind", "start", "end", "value", F.lit(None).cast("string").alias("verdict"))
    judged = _judged(spans, copied_owners).select("row_id", "doc_id", "kind", "start", "end", "value", "verdict").unionByName(documents)
    span = lambda start, kind, end: F.struct(start.cast("long").alias("start"), kind.cast("int").alias("kind"), end.cast("long").alias("end"), F.col("verdict"))
    base = F.when(F.col("kind").isNotNull(), span(F.col("start"), F.col("kind"), F.col("end")))
    live = F.when(F.col("verdict") == LIVE, span(F.col("end") - F.length("value"), F.lit(len(KINDS)), F.col("end")))
    count = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(f"n_{v}")
    return judged.groupBy("row_id", "doc_id").agg(
        F.array_sort(F.concat(F.collect_list(base), F.collect_set(live))).alias("spans"), count("copied"), count("shared"), count(LIVE)
    )


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact_live(docs: DataFrame, *, mark: str = "[REDACTED]", copied_owners: int = 3) -> DataFrame:
    """docs with every live-looking value replaced by mark; other rows unchanged, n_chars kept right.

    Columns and row count stay. The rows that change are joined back by id and text, so repeated
    rows are treated alike.
    """
    cols = docs.columns
    keyed = docs.withColumn("__rowhash", F.xxhash64("doc_id", "text"))
    found = scan_secrets(keyed.withColumn("__id", F.struct("doc_id", "__rowhash")), id_col="__id", copied_owners=copied_owners).filter(F.col("n_live") > 0)
    live = found.select("doc_id.*", F.explode(F.filter("spans", lambda s: s["kind"] == len(KINDS))).alias("s")).select("doc_id", "__rowhash", F.col("s.start").alias("a"), F.col("s.end").alias("b")).distinct()
    # Spans that overlap are cut out as one.
    row = Window.partitionBy("doc_id", "__rowhash").orderBy("a", "b")
    opens = F.coalesce(F.col("a") >= F.max("b").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    live = live.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    parts = live.groupBy("doc_id", "__rowhash", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = parts.groupBy(F.col("doc_id").alias("__f_id"), F.col("__rowhash").alias("__f_hash")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("__cuts"))
    joined = keyed.join(cuts, F.col("doc_id").eqNullSafe(F.col("__f_id")) & (F.col("__rowhash") == F.col("__f_hash")), "left")
    n = F.size("__cuts")
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            F.col("text"),
            F.when(i == 0, F.lit(1)).otherwise(F.get("__cuts", i - 1)["b"] + 1).cast("int"),
            (F.when(i == n, F.length("text")).otherwise(F.get("__cuts", i)["a"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("__cuts", i - 1)["b"])).cast("int"),
        ),
    )
    hit = F.col("__cuts").isNotNull()
    out = joined.withColumn("text", F.when(hit, F.array_join(kept, mark)).otherwise(F.col("text")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*cols)


def op3_secret_ownership(spark, sf_dir):
    """All documents; owner: source, repository: source and language."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{NAMES[i]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_copied", "n_shared", "n_live")


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(source, chr(1)) || '/' || coalesce(lang, chr(1)) AS repo, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT d.row_id, d.doc_id, source, repo, 0 AS kind, 6 AS least, regexp_extract_all(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS hits,
         string_split_regex(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS parts FROM docs d
  UNION ALL SELECT row_id, doc_id, source, repo, 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT row_id, doc_id, source, repo, 2, 24, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM docs),
each AS (SELECT row_id, doc_id, source, repo, kind, least, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS part, generate_subscripts(hits, 1) AS nth FROM found),
ends AS (SELECT *, sum(length(part) + length(hit)) OVER (PARTITION BY row_id, kind ORDER BY nth) AS e FROM each),
spans AS (
  SELECT row_id, doc_id, source, repo, kind, e - length(hit) AS s, e,
         CASE WHEN kind = 0 THEN regexp_extract(hit, '^(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END AS value, least FROM ends),
good AS (SELECT * FROM spans WHERE length(value) >= least),
owners AS (
  SELECT value, CASE WHEN count(DISTINCT coalesce(source, chr(1))) >= 3 OR count(DISTINCT repo) >= 3 THEN 'copied'
                     WHEN count(DISTINCT coalesce(source, chr(1))) = 1 AND len(list_distinct(string_split(value, ''))) >= least(8, (7 * length(value) + 9) // 10)
                          AND regexp_matches(value, '[0-9]|[a-z][A-Z]|[+/=]|^AKIA[A-Z0-9]{16,}$|^[0-9a-f]{24,}$') THEN 'live' ELSE 'shared' END AS verdict
  FROM good GROUP BY value),
judged AS (SELECT g.*, o.verdict FROM good g JOIN owners o USING (value)),
allspans AS (
  SELECT row_id, kind, s, e FROM judged UNION ALL
  SELECT DISTINCT row_id, 3, e - length(value), e FROM judged WHERE verdict = 'live'),
told AS (
  SELECT row_id, string_agg((['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind, e) AS spans,
         coalesce(string_agg((['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind, e) FILTER (kind < 3), '') AS base,
         count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex FROM allspans GROUP BY row_id),
verdicts AS (SELECT row_id, count(*) FILTER (verdict = 'copied') AS n_copied, count(*) FILTER (verdict = 'shared') AS n_shared, count(*) FILTER (verdict = 'live') AS n_live FROM judged GROUP BY row_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_live, 0)::BIGINT AS n_live
FROM docs d LEFT JOIN told USING (row_id) LEFT JOIN verdicts USING (row_id)
"""
