"""Session settings and the shared folder for data written between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins on measured sizes, splits skewed join
# partitions and merges small shuffle partitions; the advisory size keeps a
# task's input well inside executor memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "flowvigil", master: str | None = None,
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only when a local session names none (tests) a folder of our own is set; on a cluster a folder
    of one machine would not do, so there the setting is required.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowvigil-"))
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df):
    """Write ``df`` once to the shared folder: for data that a fit reads many times.

    The lineage is cut by a reliable checkpoint, so a lost executor costs a re-read,
    not a recomputation of all features.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df, rows_each: int = 20_000):
    """``df`` over at least one partition a core, for data that is small in bytes but costs much work a row.

    Files and shuffles are cut by bytes, which leaves such data in a few tasks. Up to ``rows_each`` rows a
    partition it stays as it is.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= cores or df.count() <= rows_each * parts:
        return df
    return df.repartition(cores)
