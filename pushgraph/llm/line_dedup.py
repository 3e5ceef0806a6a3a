"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of (line hash, documents, keeper), bucketed and sorted by hash: the distinct lines of a batch with the number of
documents that hold each and the largest id among them. Each new batch is merge-joined with the runs: lines that a run has settled
already (enough documents, a keeper that is not below the batch's) are left out, the others become the batch's own run on level 0. A level
that holds ``fanout`` runs is merged into one run of the next level, so that a store of n batches has a logarithm of n runs.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pushgraph.session import checkpoint_dir, forget, table, written

WHITE = " \t\n\x0b\f\r"
LINE, NO_ID = ["h", "g"], -(2**63)
RUN = "h long, g int, docs long, keeper long"
#: A line that more than one in HOT rows of a batch hold is joined by broadcast: HOT lines a batch at most.
HOT = 4096


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(WHITE))
    # lower() is right for ASCII; elsewhere it would change other letters too.
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, string.ascii_uppercase, string.ascii_lowercase))


class LineRuns:
    """The levels of runs; add() a batch of lines (h, g, doc), then settled() tells the lines to cut and their keepers.

    The documents of one id belong to one batch. Runs live in the shared checkpoint folder, as tables that need no shuffle to be joined.
    """

    def __init__(self, spark: SparkSession, *, least_docs: int = 3, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hot: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *LINE).sortBy(*LINE).option("path", f"{checkpoint_dir(self.spark)}/tables/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            gone = self.spark.range(0)
            gone._written_at = f"{checkpoint_dir(self.spark)}/tables/{name}"
            forget(gone)

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed tables claims a partitioning that the written plan does not keep.
        rows = self.spark.read.schema(RUN).parquet(*(f"{checkpoint_dir(self.spark)}/tables/{name}" for name in names))
        return rows.groupBy(*LINE).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """lines (h, g, doc): a row for each line; repeated rows count once."""
        # Documents are made distinct by (line, document) first: a common line is spread over its documents, and counted in part by
        # every task before it meets itself.
        own, total = lines.select(*LINE, "doc").distinct().groupBy(*LINE).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper")), Observation()
        own = written(own.observe(total, F.sum("docs").alias("n")))
        self.hot.append(written(own.filter(F.col("docs") * HOT > F.lit(total.get["n"] or 0)).select(*LINE)))
        fresh = own
        for name in [x for level in self.levels for x in level]:
            run = self.spark.table(name).filter(F.col("docs") >= self.least_docs).select(F.col("h").alias("r_h"), F.col("g").alias("r_g"), F.col("keeper").alias("r_keeper"))
            fresh = fresh.join(run.hint("merge"), (F.col("h") == F.col("r_h")) & (F.col("g") == F.col("r_g")) & (F.col("r_keeper") >= F.col("keeper")), "left_anti")
        self._place(0, self._write(fresh.repartition(self.buckets, *LINE)))
        forget(own)

    def _place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._write(self._merged(full)))
            self._drop(full)

    def settled(self) -> DataFrame:
        """(h, g, docs, keeper): lines in at least least_docs documents."""
        names = [x for level in self.levels for x in level]
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self._merged(names).filter(F.col("docs") >= self.least_docs)

    def release(self) -> None:
        self._drop([x for level in self.levels for x in level])
        forget(*self.hot)
        self.levels, self.hot = [], []


def _dropped(rows: DataFrame, runs: LineRuns) -> DataFrame:
    """The rows (doc, tag, pos, h, g) of settled lines that stand in another document than their keeper."""
    settled = written(runs.settled().select(F.col("h").alias("s_h"), F.col("g").alias("s_g"), "keeper"))
    if not runs.hot:
        return rows.limit(0).select("doc", "tag", "pos")
    hot = runs.hot[0]
    for x in runs.hot[1:]:
        hot = hot.unionByName(x)
    same = (F.col("h") == F.col("s_h")) & (F.col("g") == F.col("s_g"))
    # HOT lines a batch at most are hot; their rows stay where they are, the others meet their line by a shuffle.
    hot = written(hot.distinct())
    common = settled.join(F.broadcast(hot), same, "left_semi").withColumn("common", F.lit(True))
    told = rows.join(F.broadcast(hot.select(F.col("h").alias("h_h"), F.col("g").alias("h_g"), F.lit(True).alias("hot"))), (F.col("h") == F.col("h_h")) & (F.col("g") == F.col("h_g")), "left")
    here = told.filter("hot").join(F.broadcast(common), same).filter("doc < keeper")
    there = told.filter("hot IS NULL").join(settled.hint("merge"), same).filter("doc < keeper")
    return here.select("doc", "tag", "pos").unionByName(there.select("doc", "tag", "pos"))


def cut_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 6, fanout: int = 3) -> DataFrame:
    """One row for each input row: (doc_id, n_lines, n_dropped, kept): the lines of at least least_chars code points (as line_key())
    that at least least_docs documents hold are cut from all of these but the one with the largest id; kept is the rest, joined by \\n.

    A null or empty text is one empty line. Rows with one id are one document; a null id counts as the least. All lines of the keeper
    stay, also those that it repeats. No rows: no rows. Other columns are ignored, whatever their names.

    Documents are added in ``batches`` ranges of their ids, from the largest on: what is settled early is left out of all later runs. 96
    bits of hash stand for a line. The texts are scanned twice and shuffled once; of a line 32 bytes go to shuffles and runs.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    cuts = sorted(set(base.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] or []), reverse=True)
    nth = sum((F.when(F.col("doc") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = base.select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc", "tag", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least_chars)
    lines = lines.select("doc", "tag", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"), nth.alias("batch"))
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    lines._written_at = path
    runs = LineRuns(spark, least_docs=least_docs, fanout=fanout)
    for i in range(len(cuts) + 1):
        runs.add(lines.filter(F.col("batch") == i))
    gone = written(_dropped(lines, runs).groupBy(F.col("doc").alias("d_doc"), F.col("tag").alias("d_tag")).agg(F.collect_set("pos").alias("gone")))
    runs.release()
    forget(lines)
    rows = base.join(gone, (F.col("doc") == F.col("d_doc")) & (F.col("tag") == F.col("d_tag")), "left").select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("lines"))
    # Positions are subtracted as a set, so a text of many lines costs its length.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n"))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark, sf_dir):
    """All documents; lines of 20 code points in three documents."""
    return cut_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM d),
k AS (SELECT r, doc_id, p, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
settled AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT r, p FROM k JOIN settled USING (key) WHERE doc_id < keeper),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM e ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
