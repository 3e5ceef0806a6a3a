"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source is clamped at ``max_epochs`` times its size; what it cannot use is reshared by weight
among the others until none is above its cap. The repetition that is not whole takes documents in
a seeded order until the source's target is met; the last one is cut to the words still missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pushgraph.session import table, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with weight and target, one row a source.

    Sources in code point order, null last, get the weights in turn. ``max(lam)`` is the water
    level: lam rises over the clamped sources (in order of cap over weight) and falls after them.
    The one window without a key runs over the list of sources, never over documents.
    """
    everything, in_order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(in_order))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    lam = left.cast("double") / F.sum("weight").over(after).cast("double")
    level = ranked.withColumn("lam", lam).withColumn("level", F.max("lam").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """One row for each input row: id, size, source_size, target (of its source), taken.

    taken is in words, repetitions counted. Null or empty text: size 0, taken 0. A null source is a
    source of its own, last in order. Repeated rows each count. No rows: no rows. Other columns
    are ignored, whatever their names. Equal ids order by size; rows alike in both are
    interchangeable, so reruns agree.

    Cost: one scan of the texts; after it only (id, source, size, order) moves. A source, however
    large, is split into 4096 ranges of the seeded order, whose sums give every range its offset.
    """
    # Rows without an id are spread by their text.
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))))
    base = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("ord")).withColumn("bucket", F.substring("ord", 1, 3))
    )
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    need = F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("whole") * F.col("source_size")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target", "whole", need.alias("need"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "source_size", "target", "whole", (F.col("need") - F.col("offset")).alias("missing")
    )
    within = Window.partitionBy("source", "bucket").orderBy("ord", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("done", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - F.col("done")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def op8_source_mix(spark, sf_dir):
    """All documents; targets 5, 2, 1 and at most three epochs."""
    return mix_sources(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS ord
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM sizes),
weighed AS (SELECT *, (CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, source_size * 3 AS cap FROM ranked),
filled AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam
  FROM weighed),
levelled AS (SELECT *, max(lam) OVER () AS lev FROM filled),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * lev) AS target FROM levelled),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
needs AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS need FROM parts),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM base)
SELECT p.doc_id, p.size, n.source_size, n.target,
       (n.whole * p.size + greatest(0, least(p.size, n.need - p.done)))::BIGINT AS taken
FROM placed p JOIN needs n ON p.source IS NOT DISTINCT FROM n.source
"""
