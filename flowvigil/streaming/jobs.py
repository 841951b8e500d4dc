"""Structured Streaming jobs: ingest, live detection, alerts, windows, running counts, throttle, dedupe.

Every job takes a streaming DataFrame and gives one, or a writer with the checkpoint that
the caller names. Sinks written from ``foreachBatch`` put a batch under its own
``batch=<id>`` folder with overwrite, so a batch that is run again after a failure
replaces its rows instead of adding them twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from flowvigil.functions.stats import entropy_from_counts, ratio, zero_if_null
from flowvigil.operators import risk
from flowvigil.operators.history import worth_alert
from flowvigil.operators.throttle import NEVER, walk
from flowvigil.plans.detect import Models, detect
from flowvigil.sources.sinks import TOPIC, topic_records


def file_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def topic_stream(spark: SparkSession, servers: str, schema: StructType, topic: str = TOPIC) -> DataFrame:
    """Records of a topic (needs the Kafka package on the cluster), as ``topic_rows`` gives them."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return topic_rows(raw, schema)


def topic_rows(raw: DataFrame, schema: StructType) -> DataFrame:
    """The fields of JSON records in ``value``, and ``_bad``: null, or the text of a record that fails.

    A record fails when it is no JSON object or a field has another type; a null record has the
    text ''. ``files.accepted`` and ``files.rejected`` part the two.
    """
    text = F.col("value").cast("string")
    record = raw.select(text.alias("_text"), F.from_json(text, StructType([*schema.fields, StructField("_corrupt", StringType())]), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    failed = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return record.select(*[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields],
                         F.when(failed, F.coalesce("_text", F.lit(""))).alias("_bad"))


def start(stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None] | None = None,
          path: str | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a job: ``foreachBatch`` when a function is given, else a parquet file sink.

    ``checkpoint`` is a lasting folder of this job and its sink, in a store that all executors
    reach. A job started again with it goes on behind the last batch, with its state; batch numbers
    go on too, so a stored batch is replaced only by a repetition of itself. ``every`` is a processing-time
    trigger; without it what is available is processed and the job ends.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if each_batch is not None:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", path).start()


def run(stream: DataFrame, checkpoint: str, **options) -> None:
    start(stream, checkpoint, **options).awaitTermination()


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(store_path: str, publish_to: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: store the rows by date and publish them as topic records."""
    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            (df.withColumn("date", F.to_date("ts")).hint("rebalance", "date").write.mode("overwrite")
             .partitionBy("date").option("compression", "snappy").parquet(f"{store_path}/batch={batch}"))
            if publish_to is not None:
                publish_to(topic_records(df), batch)
        finally:
            df.unpersist()
    return each


def live_detection(models: Models, detections_path: str, queue_path: str | None = None,
                   callback: Callable[[DataFrame, int], None] | None = None, history_path: str | None = None,
                   source: str = "realtime") -> Callable[[DataFrame, int], None]:
    """Batch function: flows through detection with frozen models; detections and approval queue are kept.

    ``history_path`` gets the nested entries that the reports of ``operators.history`` read, and
    ``callback`` the detections of each batch. ``source`` is named in flows that name none.
    """
    def each(flows: DataFrame, batch: int) -> None:
        if "source" not in flows.columns:
            flows = flows.withColumn("source", F.lit(source))
        # ids are numbered per day in one batch only, so live ones follow the event's id
        found = detect(flows, models, "RT").withColumn("threat_id", F.concat_ws(
            "-", F.lit("RT"), F.date_format("ts", "yyyyMMdd"), F.col("seq").cast("string"))).persist()
        try:
            write_batch(risk.audit_rows(found), detections_path, batch)
            if history_path is not None:
                carried_out = risk.audit_rows(found).withColumnRenamed("recommended_action", "action")
                write_batch(risk.history_entries(carried_out), history_path, batch)
            if queue_path is not None:
                write_batch(risk.approval_queue(found), queue_path, batch)
            if callback is not None:
                callback(found, batch)
        finally:
            found.unpersist()
    return each


def stored_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that another job's file sink writes, as a stream: only files of whole batches are read.

    So a job detects once (``plans.detect.live_detections``), and audit, approval queue, alerts and history are
    jobs of their own on its table, each with its own checkpoint.
    """
    return spark.readStream.schema(schema).parquet(path)


def live_alerts(detections: DataFrame) -> DataFrame:
    """One alert per detection, ``logged`` where it is worth a line in the log; a plain projection, so no state."""
    scored = risk.score_detections(detections).withColumns({"threat_id": risk.event_threat_id(), "logged": worth_alert()})
    more = [c for c in ("threat_id", "dst_port", "risk_score", "action", "process", "source", "logged") if c in scored.columns]
    return risk.alert_record(scored, *more)


def window_features(flows: DataFrame, window: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Traffic features per source and event-time window, emitted when a window closes.

    Two chained aggregations: counts per (window, source, kind, value), then the
    features per (window, source). Kind 0 carries the sums of all rows.
    """
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("").alias("value")),
        *[F.struct(F.lit(i + 1).alias("kind"), F.col(c).cast("string").alias("value"))
          for i, c in enumerate(("protocol", "dst_port", "dst_ip"))])
    spread = flows.withWatermark("ts", delay).select(
        "ts", "src_ip", "packets", "bytes", "flow_duration", F.inline(kinds))
    counts = spread.groupBy(F.window("ts", window).alias("w"), "src_ip", "kind", "value").agg(
        F.count("*").alias("n"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.sum("flow_duration").alias("seconds"), zero_if_null(F.var_samp("bytes")).alias("spread"))

    def whole(c: str):
        return F.max(F.when(F.col("kind") == 0, F.col(c)))

    def of(kind: int):
        return F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.col("n"))

    per_source = counts.groupBy(F.window(F.window_time("w"), window).alias("w2"), "src_ip").agg(
        whole("packets").alias("packet_count"), whole("bytes").alias("byte_count"), whole("seconds").alias("duration"),
        entropy_from_counts(of(1)).alias("protocol_entropy"), entropy_from_counts(of(2)).alias("port_entropy"),
        F.count(of(3)).alias("unique_dst_ips"), F.count(of(2)).alias("unique_dst_ports"),
        whole("spread").alias("packet_size_variance"))
    return per_source.select(
        F.col("w2.start").alias("window_start"), F.col("w2.end").alias("window_end"), "src_ip", "packet_count", "byte_count",
        "duration", ratio(F.col("packet_count"), F.col("duration")).alias("packets_per_second"),
        ratio(F.col("byte_count"), F.col("duration")).alias("bytes_per_second"),
        ratio(F.col("byte_count"), F.col("packet_count")).alias("avg_packet_size"), "protocol_entropy", "port_entropy",
        "unique_dst_ips", "unique_dst_ports", "packet_size_variance", F.sqrt("packet_size_variance").alias("packet_size_std"))


def running_stats(detections: DataFrame, by: str = "src_ip") -> DataFrame:
    """Running totals per source; in update mode only changed sources are written."""
    scored = risk.score_detections(detections)
    return scored.groupBy(by).agg(
        F.count("*").alias("events"), F.max("risk_score").alias("max_risk_score"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")])


def latest_state(spark: SparkSession, path: str, by: str = "src_ip") -> DataFrame:
    """The newest written row per key of a job in update mode."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (by, "batch")]
    newest = rows.groupBy(by).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return newest.select(by, "r.*")


def throttled(alerts: DataFrame, key: str = "src_ip", at: str = "ts", row_id: str = "seq", seconds: float = 60,
              delay: str = "10 minutes") -> DataFrame:
    """At most one row per key and cool-down, with the last sent time as state.

    The rows of a key are put in time order inside each micro-batch; a row that
    arrives late never opens a closed key again. Rows later than the watermark ``delay`` are
    left out, and a key's state goes when the watermark has passed its cool-down: a row that
    comes after that finds the key open anyway.
    """
    gap = int(seconds * 1_000_000)
    rows = alerts.withWatermark(at, delay).select(key, at, row_id, F.unix_micros(at).alias("_t"))
    schema = rows.drop("_t").schema

    def step(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["_t", row_id])
        open_at = state.get[0] if state.exists else NEVER
        times = pdf["_t"].to_numpy()
        picked = walk(times, open_at, gap)
        if len(picked):
            open_at = int(times[picked[-1]]) + gap
            state.update((open_at,))
        if state.exists:
            state.setTimeoutTimestamp(max(open_at // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pdf.iloc[np.asarray(picked, dtype=int)][[key, at, row_id]]

    return rows.groupBy(key).applyInPandasWithState(
        step, schema, "open_at long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe(events: DataFrame, row_id: str = "event_id", at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark delay; state is dropped behind it."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([row_id])


def correlated_alerts(alerts: DataFrame, key: str = "src_ip", seconds: int = 300, min_events: int = 2,
                      delay: str = "10 minutes") -> DataFrame:
    """Incidents as event-time sessions of one source, emitted when a session closes.

    Alerts exactly ``seconds`` apart are one incident, as in ``policies.correlate_alerts``: a session's
    end is exclusive, so its gap is a microsecond longer.
    """
    sessions = alerts.withWatermark("ts", delay).groupBy(
        F.session_window("ts", f"{seconds} seconds 1 microsecond").alias("w"), key).agg(
        F.count("*").alias("alerts"), F.max("risk_score").alias("max_risk_score"))
    return sessions.where(F.col("alerts") >= min_events).select(
        key, F.col("w.start").alias("first_seen"), "alerts", "max_risk_score")


def observed(stream: DataFrame, name: str = "counters", **counted: Column) -> DataFrame:
    """Count the rows of every micro-batch, and those where each condition ``counted`` holds, without a pass of their own."""
    return stream.observe(name, F.count("*").alias("events_processed"), *[F.count_if(c).alias(n) for n, c in counted.items()])
