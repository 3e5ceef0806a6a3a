"""The corpus pipeline: five stages, each a training-data operator applied to all that the last one kept.

toxicity     documents that the learned lexicon's model rejects go
near_copies  of each group of near copies one document stays
benchmark    documents that hold a benchmark item go
secrets      live-looking credentials are cut out of the texts
mix          how many words of each document the mix takes; the result
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pushgraph.llm import decontamination, mixing, ngram_join, secrets, toxicity
from pushgraph.session import small_batches, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labels of those given, held-out ones left out."""
    small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, prefix="__tox_").filter(F.col("__tox_predicted") == 0).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked texts stays."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of the shingles of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that one owner alone holds and that look live are replaced by a mark."""
    return secrets.redact_live(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", reject_toxic), ("near_copies", one_of_near_copies), ("benchmark", drop_benchmark), ("secrets", redact_secrets), ("mix", mix)]

#: Learned scores can't be told in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
