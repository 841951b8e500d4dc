"""Writers: dated parquet, topic records, result CSV, audit log, models."""

from __future__ import annotations

import json
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowvigil.sources.folders import Folders

TOPIC = "raw-security-events"


def store_by_date(df: DataFrame, path: str, at: str = "ts", mode: str = "append") -> None:
    """Snappy parquet partitioned by date.

    The rebalance hint evens out file sizes and splits a date that holds most rows,
    instead of sending each date to one task.
    """
    (df.withColumn("date", F.to_date(at)).hint("rebalance", "date")
     .write.mode(mode).partitionBy("date").option("compression", "snappy").parquet(path))


# Days that a kind of table is kept.
RETENTION_DAYS = {"events": 90, "audit": 365}
DROPPED = "path string, date date, files long, bytes long, expired boolean, dropped boolean"


def drop_expired(spark: SparkSession, path: str, kind: str = "events", days: int | None = None, as_of: date | None = None,
                 dry_run: bool = False) -> DataFrame:
    """Remove the date folders of ``path`` that are older than ``days`` (those of ``kind`` by default); a row for every folder found.

    ``path`` holds ``date=`` folders, below ``batch=`` folders where a stream writes them. Only the catalogue of
    paths is read, no data file. ``as_of`` (the newest folder's date by default, so that a result can be repeated) and the
    ``days`` before it stay, as in ``policies.retain``; folders without a date, as of rows without a time, stay too. Each folder is removed
    whole, so a call that was stopped is finished by the next. With ``dry_run`` nothing is removed.
    """
    days = RETENTION_DAYS[kind] if days is None else days
    folders = Folders(spark)
    found = [(e, _folder_date(e.name)) for depth in ("", "batch=*/") for e in folders.matching(f"{path}/{depth}date=*") if e.is_folder]
    dates = [at for _, at in found if at is not None]
    as_of = as_of or max(dates, default=date.min)
    rows = []
    for entry, at in found:
        files, size = folders.content(entry.path)
        expired = at is not None and (as_of - at).days > days
        rows.append((entry.path, at, files, size, expired, expired and not dry_run and folders.delete(entry.path)))
    return spark.createDataFrame(rows, DROPPED)


def _folder_date(name: str) -> date | None:
    try:
        return date.fromisoformat(name.removeprefix("date="))
    except ValueError:
        return None


def topic_records(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value): each record as one JSON text, the shape a topic sink takes."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def publish(df: DataFrame, target: str, fmt: str = "kafka", **options: str) -> None:
    """Send records to a topic (``fmt="kafka"``) or to text files for tests."""
    records = topic_records(df)
    if fmt == "kafka":
        records.write.format("kafka").option("topic", TOPIC).option(
            "kafka.bootstrap.servers", target).options(**options).save()
    else:
        records.write.format(fmt).mode("append").options(**options).save(target)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_results(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Benchmark results; NaN becomes null."""
    df = spark.read.option("header", "true").schema(schema).csv(path)
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def append_audit(history: DataFrame, path: str) -> None:
    store_by_date(history, path, at="timestamp")


# --- models -----------------------------------------------------------------

def save_model(model: PipelineModel, root: str, suite: str, version: int, **metadata) -> None:
    """Model under root/suite/version plus one row of JSON metadata."""
    model.write().overwrite().save(f"{root}/{suite}/v{version}/model")
    spark = SparkSession.active()
    row = [(suite, version, json.dumps(metadata, sort_keys=True))]
    spark.createDataFrame(row, "suite string, version int, metadata string").coalesce(1).write.mode(
        "append").json(f"{root}/_metadata")


def model_table(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("suite string, version int, metadata string").json(f"{root}/_metadata")


def load_model(spark: SparkSession, root: str, suite: str, version: int | None = None) -> PipelineModel:
    """A version of a suite, the newest by default; switching suites is loading another one."""
    if version is None:
        version = model_table(spark, root).where(F.col("suite") == suite).agg(F.max("version")).first()[0]
    return PipelineModel.load(f"{root}/{suite}/v{version}/model")
