"""Scalar functions: access paths, labels, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_access_paths(text: Column) -> Column:
    """Array of (base, fields, approx) from ``base[f,g];other[h]*``; null for null text."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda p: p != "")
    fields = lambda p: F.regexp_extract(p, r"\[([^\]]*)\]", 1)
    names = lambda p: F.filter(F.transform(F.split(fields(p), ","), lambda x: F.trim(x)), lambda f: f != "")
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^[^\[*]*", 0)).alias("base"), names(p).alias("fields"), p.endswith("*").alias("approx")))


def access_path_text(path: Column) -> Column:
    """``base[f,g]``, with a trailing star where approximate; the base alone without fields."""
    inner = F.when(F.size(path["fields"]) > 0, F.concat(F.lit("["), F.array_join(path["fields"], ","), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(path["base"], inner, F.when(path["approx"], F.lit("*")).otherwise(F.lit("")))


def without_quotes(text: Column) -> Column:
    """For quoted attributes of dot files."""
    return F.regexp_replace(text, '"', "")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def short_label(kind: Column, lhs: Column, rhs: Column, field: Column) -> Column:
    """Short text of a statement by its kind."""
    return (
        F.when(kind == "load", F.concat(lhs, F.lit(" = "), rhs, F.lit("."), field))
        .when(kind == "store", F.concat(lhs, F.lit("."), field, F.lit(" = "), rhs))
        .when(kind == "alloc", F.concat(lhs, F.lit(" = new "), rhs))
        .when(kind == "assign", F.concat(lhs, F.lit(" = "), rhs))
        .when(kind == "call", F.concat(F.when(lhs.isNotNull(), F.concat(lhs, F.lit(" = "))).otherwise(F.lit("")), rhs, F.lit("()")))
        .when(kind == "return", F.concat(F.lit("return "), F.coalesce(rhs, F.lit(""))))
        .otherwise(kind)
    )


def in_application(cls: Column, prefixes: list[str]) -> Column:
    """Whether a class name (a leading < is ignored) starts with one of the prefixes."""
    name = F.regexp_replace(cls, "^<", "")
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def interned(rows: DataFrame, col: str, out: str = "id") -> DataFrame:
    """A dense number for each distinct value, in order: sorted ranges are numbered apart and offset, so no
    single task sees all values."""
    values = rows.select(col).distinct()
    ranged = values.repartitionByRange(col).withColumn("_part", F.spark_partition_id())
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(col)))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(numbered.join(offset, "_part").select(col, (F.col("_n") + F.col("_before") - 1).alias(out)), col)


def full_match(text: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole text."""
    return text.rlike(f"^(?:{pattern})$")
