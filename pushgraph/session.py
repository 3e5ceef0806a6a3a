"""Session helpers shared by every operator: checkpoint folder, written tables, table reads."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without one gets a temporary folder: elsewhere the executors would each write to their own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pushgraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage, keeps statistics and column pruning for what reads it, and survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one: a single scan of all their files, which plans stay small with."""
    if len(tables) == 1:
        return tables[0]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._written_at for t in tables))


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; frames that are derived from them can't be read again."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def written_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """written(df) with its number of rows, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def shuffled(f: Callable) -> Callable:
    """f with its joins shuffled but for those that ask for a broadcast: what grows in rounds would go to the driver in each of them, up to Spark's
    threshold in files for every join, which is many times that in rows."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        conf, names = SparkSession.active().conf, ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
        before = {name: conf.get(name, None) for name in names}
        try:
            for name in names:
                conf.set(name, "-1")
            return f(*args, **kwargs)
        finally:
            for name, value in before.items():
                if value is None:
                    conf.unset(name)
                else:
                    conf.set(name, value)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under sf_dir; read through Spark alone, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Arrow batches of whole texts: fewer rows each than Spark's default, which a session may overrule."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return spark
