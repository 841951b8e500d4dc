"""Recent rows as keyed state: the newest N rows of each key, and events by stretch of time with a time-to-live.

Both keep their rows in list state (RocksDB, so state may be larger than memory) and are read back from the state itself,
after any batch, by ``recent_ring`` and ``recent_events``; the rows that the streams return only say what
changed. A key is cut into parts by a hash of the row, each a group of its own, so that a key with a third of all rows
fills no single task: a ring is exact because every part keeps as many rows as the whole ring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType, TimestampNTZType, TimestampType

from flowvigil.operators.temporal import latest_per_key
from flowvigil.sources.files import recent_cache

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 16


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State of the queries started inside is kept in RocksDB, which list state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _parted(df: DataFrame, parts: int) -> DataFrame:
    """With times as microseconds, which pass through state unchanged, and ``_part``; a watermark's column ``_at`` stays as it is."""
    names = [c for c in df.columns if c != "_at"]
    times = {f.name: F.unix_micros(F.col(f.name).cast("timestamp")) for f in df.schema
             if f.name != "_at" and isinstance(f.dataType, (TimestampType, TimestampNTZType))}
    return (df.withColumns(times) if times else df).withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))


def _restored(rows: DataFrame, schema: StructType) -> DataFrame:
    def column(f):
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return F.timestamp_micros(f.name).cast(f.dataType).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)
    return rows.select(*map(column, schema))


def _tuples(pdf: pd.DataFrame, whole: Sequence[str]) -> list[tuple]:
    """Rows of plain Python values; ``whole`` columns hold whole numbers or nothing."""
    columns = [[None if pd.isna(v) else int(v) if name in whole else v for v in pdf[name].tolist()] for name in pdf.columns]
    return list(zip(*columns))


def _state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The rows of a list state after the last batch, read in parallel by state partition."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    rows = reader.option("flattenCollectionTypes", "true").load().select("list_element.*")
    if "ttlExpirationMs" not in rows.columns:
        return rows
    return rows.where(F.col("ttlExpirationMs") > F.unix_millis(F.current_timestamp())).select("value.*")


class _Ring(StatefulProcessor):
    def __init__(self, schema: StructType, order: Sequence[str], keep: int):
        self.schema, self.order, self.keep = schema, list(order), keep
        self.whole = [f.name for f in schema if isinstance(f.dataType, LongType) or f.dataType.typeName() == "integer"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.ring.get()), columns=self.schema.names, dtype=object)
        arrived = 0
        for pdf in rows:
            arrived += len(pdf)
            both = pd.concat([held, pdf[self.schema.names].astype(object)], ignore_index=True)
            held = both.sort_values(self.order, ascending=False).head(self.keep)
        self.ring.put(_tuples(held, self.whole))
        yield pd.DataFrame({"key": [str(key[0])], "part": [key[1]], "arrived": [arrived], "held": [len(held)]})

    def close(self) -> None:
        pass


def keep_ring(stream: DataFrame, key: str, order: Sequence[str], keep: int, parts: int = PARTS) -> DataFrame:
    """Keep the newest ``keep`` rows of each key by ``order``; older ones leave the state with the batch that pushes them out.

    Returns (key, part, arrived, held) for every part that a batch changed. Start it inside ``rocksdb_state`` in update mode. State is
    bounded by keys x ``parts`` x ``keep`` rows; a task holds one part and one Arrow batch at a time.
    """
    rows = _parted(stream, parts)
    state = StructType([f for f in rows.schema if f.name in stream.columns])
    return rows.groupBy(key, "_part").transformWithStateInPandas(
        _Ring(state, order, keep), "key string, part int, arrived long, held long", "Update", "None")


def recent_ring(spark: SparkSession, checkpoint: str, schema: StructType, key: str, order: Sequence[str], keep: int) -> DataFrame:
    """The rings after the last batch: rows of ``schema`` with ``recent_no``, as ``temporal.latest_per_key`` gives them."""
    return latest_per_key(_restored(_state_rows(spark, checkpoint, "ring"), schema), key, order, keep)


class _Bucket(StatefulProcessor):
    """Events of one part of some minutes, gone when these are older than the time-to-live."""

    def __init__(self, schema: StructType, ttl_seconds: int, by_arrival: bool, minutes: int):
        self.schema, self.ttl, self.by_arrival, self.minutes = schema, ttl_seconds * 1000, by_arrival, minutes  # the watermark is the time-to-live behind
        self.whole = [f.name for f in schema if isinstance(f.dataType, LongType) or f.dataType.typeName() == "integer"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", self.schema, self.ttl if self.by_arrival else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = 0
        end = (int(key[0]) + self.minutes) * 60_000
        late = not self.by_arrival and end <= timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            arrived += len(pdf)
            if not late:
                self.events.appendList(_tuples(pdf[self.schema.names], self.whole))
        if not self.by_arrival and not late:
            self.handle.registerTimer(end)
        yield pd.DataFrame({"minute": [int(key[0])], "part": [key[1]], "arrived": [arrived], "expired": [late]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        yield pd.DataFrame({"minute": [int(key[0])], "part": [key[1]], "arrived": [0], "expired": [True]})

    def close(self) -> None:
        pass


def keep_recent(stream: DataFrame, at: str = "ts", ttl_seconds: int = 3600, by_arrival: bool = False,
                parts: int = PARTS) -> DataFrame:
    """Keep events under a bucket of minutes until it is older than the time-to-live; then the bucket leaves the state.

    A bucket is a 24th of the time-to-live (a minute at least): each is a call into Python with its rows and one when it leaves, so
    buckets of single minutes would cost a call for every few rows. It is named by its first minute.
    Age is measured in event time against the watermark (the latest time seen by earlier batches, less the time-to-live), or with
    ``by_arrival`` in processing time since the rows came, as a cache with expiry does. Events without a time are not kept. Returns (minute, part,
    arrived, expired) for what a batch changed. Start it inside ``rocksdb_state`` in append mode; with ``by_arrival`` on a processing-time
    trigger (``every``), since its state can change without new rows and a job for what is available would not end.
    """
    timed = stream.where(F.col(at).isNotNull())
    if not by_arrival:
        timed = timed.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", f"{ttl_seconds} seconds")
    minutes = max(1, ttl_seconds // (24 * 60))
    rows = _parted(timed, parts).withColumn("_minute", F.floor(F.col(at) / (minutes * 60_000_000)).cast("bigint") * minutes)
    state = StructType([f for f in rows.schema if f.name in stream.columns])
    return rows.groupBy("_minute", "_part").transformWithStateInPandas(
        _Bucket(state, ttl_seconds, by_arrival, minutes), "minute long, part int, arrived long, expired boolean", "Append",
        "ProcessingTime" if by_arrival else "EventTime")


def recent_events(spark: SparkSession, checkpoint: str, schema: StructType, at: str = "ts", ttl_seconds: int = 3600) -> DataFrame:
    """The kept events younger than the time-to-live at the latest one, with their bucket, as ``files.recent_cache`` gives them."""
    return recent_cache(_restored(_state_rows(spark, checkpoint, "events"), schema), at, ttl_seconds)
