"""Statistics of solved queries and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, n_distinct, collisions): how many rows several queries derived again."""
    return rows.agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("n_distinct")).withColumn("collisions", F.col("n") - F.col("n_distinct"))


def top_methods(visits: DataFrame, limit: int = 11) -> DataFrame:
    """(method, n): the most visited methods; equal counts in order of name."""
    return visits.groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method").limit(limit)


def query_spread(reached: DataFrame) -> DataFrame:
    """One row: least, mean and most reached facts of a query, and the query with most (least qid of equals)."""
    per = reached.groupBy("qid").agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.max_by("qid", F.struct("n", -F.col("qid"))).alias("largest"))


def only_one_system(fields: DataFrame, calls: DataFrame) -> DataFrame:
    """One row (field_only, call_only): methods that one of the two systems visited alone."""
    f, c = fields.select("method").distinct(), calls.select("method").distinct()
    return f.exceptAll(c).agg(F.count("*").alias("field_only")).crossJoin(c.exceptAll(f).agg(F.count("*").alias("call_only")))


def call_graph_metrics(edges: DataFrame) -> DataFrame:
    """One row (sites, edges, mean_targets, most_targets, single) of (site, callee) call edges."""
    per = edges.select("site", "callee").distinct().groupBy("site").agg(F.count("*").alias("t"))
    return per.agg(F.count("*").alias("sites"), F.sum("t").alias("edges"), F.avg("t").alias("mean_targets"), F.max("t").alias("most_targets"), F.sum((F.col("t") == 1).cast("bigint")).alias("single"))


def graph_edges(cfg: DataFrame, call_edges: DataFrame) -> DataFrame:
    """One row (n): edges of the interprocedural graph: successors, calls and returns."""
    return cfg.distinct().agg(F.count("*").alias("n")).unionAll(call_edges.distinct().agg((2 * F.count("*")).alias("n"))).agg(F.sum("n").alias("n"))


def simple(solutions: list, program) -> DataFrame:
    """One row (forward, backward, total, visited_methods): queries solved, by direction, and methods that any visited.

    solutions: (direction, Solution) pairs.
    """
    rows = None
    for direction, s in solutions:
        one = s.seeds.select("qid").distinct().withColumn("direction", F.lit(direction))
        rows = one if rows is None else rows.unionByName(one)
    methods = None
    for _, s in solutions:
        m = s.reached.select("stmt").distinct().join(program.stmt.select("stmt", "method"), "stmt").select("method")
        methods = m if methods is None else methods.unionByName(m)
    counts = rows.agg(*(F.sum((F.col("direction") == d).cast("bigint")).alias(d) for d in ("forward", "backward")), F.count("*").alias("total"))
    return counts.crossJoin(methods.agg(F.count_distinct("method").alias("visited_methods")))  # a row each


def geometric_mean(rows: DataFrame, col: str) -> DataFrame:
    """One row (geometric_mean) over positive values."""
    return rows.filter(F.col(col) > 0).agg(F.exp(F.avg(F.log(col))).alias("geometric_mean"))
