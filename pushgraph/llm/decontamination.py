"""Benchmark decontamination: size-partitioned MinHash containment search (DataFrame functions only).

Test items are short, documents long, so the Jaccard similarity of the two says little. Items are
partitioned by size (powers of two of their shingle count). Within a partition whose largest item
has u shingles, an item's MinHash signature is its bottom q = u - ceil(t * u) + 1 shingle hashes: a
document that holds a share t of an item's n shingles misses n - ceil(t * n) at most, fewer than q, so it
holds one of the signature at least. The signature probe therefore loses no pair. Pairs that it finds are
verified by exact shingle containment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.session import table, written

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is computed once for a row.

    A lambda that names an outer expression computes it again for each element once the optimizer
    has put the expression in its place; a lambda's own variable can't be replaced.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash for each word, A-Z lower-cased."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """A hash for each run of k of the word hashes, in order; none where there are fewer."""

    def runs(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        each = F.transform(w, lambda h, i: F.xxhash64(h, *(F.get(w, i + j) for j in range(1, k))))
        return F.when(n > 0, F.slice(each, 1, F.greatest(n, F.lit(1)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(hashes, runs)


def item_shingles(items: DataFrame, *, item_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """(item_id, k, n, need, hashes): distinct shingles of each item, k or fewer words each.

    An item with fewer than k words is one shingle of all its words. One without words has none and
    is found nowhere.
    """
    words = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(k))
    by_size = F.coalesce(*(F.when(size == j, shingle_hashes(F.col("w"), j)) for j in range(1, k + 1)))
    out = words.select("item_id", size.alias("k"), F.array_distinct(by_size).alias("hashes")).dropDuplicates(["item_id", "hashes"])
    return out.withColumn("n", F.size("hashes")).withColumn("need", F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"))


def signatures(items: DataFrame, *, threshold: float) -> DataFrame:
    """(item_id, k, n, need, h): the bottom q hashes of each item, q from its size partition."""
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    q = upper - F.ceil(upper * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    bottom = F.slice(F.array_sort("hashes"), 1, F.least(q, F.col("n")))
    return items.select("item_id", "k", "n", "need", F.explode(bottom).alias("h"))


def _joined(left: DataFrame, right: DataFrame, on, how: str, rows: int, broadcast_rows: int) -> DataFrame:
    """Broadcasts right only if its counted rows are within the bound; else Spark shuffles both."""
    return left.join(F.broadcast(right) if rows <= broadcast_rows else right, on, how)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 5,
    threshold: float = 0.8,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) for each document and item of which the document
    holds a share threshold or more of the distinct k-word shingles.

    Null and empty texts match nothing. Rows alike in id and text are one; rows that share only the
    id are judged apart, and give a row each. A null id is kept. No documents or no items: no rows.
    Further columns are ignored. A passage in a third of all documents gives a row for each of them and
    item, never pairs of documents.

    The texts are scanned once for each length of shingles, which items of fewer words have less than k of: at most k times. Each
    scan probes with the signatures of that length, whose table is broadcast while its counted rows are within broadcast_rows; then
    shingles of the candidates alone are read, once a length. 64-bit hashes stand for words and shingles.
    """
    spark = docs.sparkSession
    found = written(item_shingles(items, item_col=item_col, text_col=item_text_col, k=k, threshold=threshold), 1)
    sigs = signatures(found, threshold=threshold)
    sizes = {r["k"]: r["rows"] for r in sigs.groupBy("k").agg(F.count("*").alias("rows")).collect()}  # k rows at most
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_item int, n_common long, containment double").withColumn("doc_id", F.lit(None).cast(docs.schema[id_col].dataType)).withColumn("item_id", F.lit(None).cast(items.schema[item_col].dataType))
    hashed = base.select("doc_id", "text_key", word_hashes(F.col("text")).alias("w"))
    probes = []
    for size, rows in sorted(sizes.items()):
        ours = sigs.filter(F.col("k") == size).select("item_id", "need", "h")
        run = hashed.select("doc_id", "text_key", shingle_hashes(F.col("w"), size).alias("s"))
        run = run.select("doc_id", "text_key", F.size("s").alias("m"), F.explode_outer("s").alias("sh"))
        probes.append(_joined(run, ours, (F.col("sh") == F.col("h")) & (F.col("m") >= F.col("need")), "inner", rows, broadcast_rows).select("doc_id", "text_key", "item_id"))
    candidates = probes[0]
    for p in probes[1:]:
        candidates = candidates.unionByName(p)
    candidates = written(candidates.distinct())

    keys = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")).distinct()
    same_doc = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))
    texts = _joined(base, keys, same_doc, "left_semi", candidates.count(), broadcast_rows).dropDuplicates(["doc_id", "text_key"])
    hashed = texts.select("doc_id", "text_key", word_hashes(F.col("text")).alias("w"))
    whole = found.select("item_id", "k", "n", "need", F.explode("hashes").alias("h"))
    counts = []
    for size, rows in sorted({r["k"]: r["rows"] for r in whole.groupBy("k").agg(F.count("*").alias("rows")).collect()}.items()):
        run = hashed.select("doc_id", "text_key", F.explode_outer(F.array_distinct(shingle_hashes(F.col("w"), size))).alias("sh"))
        ours = whole.filter(F.col("k") == size).select("item_id", "n", "need", "h")
        hit = _joined(run, ours, F.col("sh") == F.col("h"), "inner", rows, broadcast_rows)
        counts.append(hit.groupBy("doc_id", "text_key", "item_id", "n", "need").agg(F.count("*").alias("n_common")))
    verified = counts[0]
    for c in counts[1:]:
        verified = verified.unionByName(c)
    verified = verified.filter(F.col("n_common") >= F.col("need"))
    cand = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), F.col("item_id").alias("c_item"))
    verified = verified.join(cand, same_doc & F.col("item_id").eqNullSafe(F.col("c_item")), "left_semi")
    return verified.select("doc_id", "item_id", F.col("n").alias("n_item"), "n_common", (F.col("n_common") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """docs without the rows that hold an item; a null doc_id is judged by its text like any other."""
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    bad = contained_items(keyed, items, id_col="__key", **params).select(F.col("doc_id.doc_id").alias("__b_id"), F.col("doc_id.h").alias("__b_h")).distinct()
    bad = written(bad)
    on = F.col("doc_id").eqNullSafe(F.col("__b_id")) & (F.xxhash64("text") == F.col("__b_h"))
    return _joined(docs, bad, on, "left_anti", bad.count(), 500_000)


def op4_contained_items(spark, sf_dir):
    """All documents against all of benchmark; five words, 0.8 of an item's shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = """
WITH low AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
its AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
item_sh AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest([array_to_string(w[i:i + least(len(w), 5) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 5) + 2)]) AS s
  FROM its WHERE len(w) > 0),
item_n AS (SELECT item_id, count(*) AS n FROM item_sh GROUP BY item_id),
doc_sh AS (
  SELECT DISTINCT doc_id, text, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s
  FROM low, (SELECT DISTINCT k FROM item_sh) ks WHERE len(w) >= k),
common AS (SELECT doc_id, text, item_id, count(*) AS c FROM doc_sh JOIN item_sh USING (k, s) GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, n::INTEGER AS n_item, c::BIGINT AS n_common, c / n AS containment FROM common JOIN item_n USING (item_id) WHERE 10 * c >= 8 * n
"""
