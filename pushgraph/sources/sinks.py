"""Sinks: graphs as dot text, JSON for viewers, statistics as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.functions.text import without_quotes


def dot_lines(trans: DataFrame) -> DataFrame:
    """(qid, line): an edge line for each pair of states, its labels sorted and joined."""
    grouped = trans.groupBy("qid", "src", "dst").agg(F.array_join(F.array_sort(F.collect_set(without_quotes(F.col("label")))), ",").alias("labels"))
    return grouped.select("qid", F.format_string('"%s" -> "%s" [label="%s"];', without_quotes(F.col("src")), without_quotes(F.col("dst")), "labels").alias("line"))


def dot(trans: DataFrame) -> DataFrame:
    """(qid, dot): a digraph for each qid, edges in order."""
    lines = dot_lines(trans).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return lines.select("qid", F.concat(F.lit("digraph {\n"), "lines", F.lit("\n}")).alias("dot"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, json): nodes (qid, id, label) and edges (qid, src, dst) of each graph."""
    n = nodes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("nodes"))
    e = edges.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    return n.join(e, "qid", "left").select("qid", F.to_json(F.struct("nodes", "edges")).alias("json"))


def console(rows: DataFrame, most: int = 20) -> str:
    """The first rows in order, as a table; also printed."""
    text = rows.orderBy(*rows.columns).limit(most)._show_string(most, 80, False)
    print(text)
    return text


def write_text(rows: DataFrame, col: str, path: str) -> None:
    rows.select(col).write.mode("overwrite").text(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of ;-separated files, each with its header."""
    rows.write.mode("append").option("header", True).option("sep", ";").csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
