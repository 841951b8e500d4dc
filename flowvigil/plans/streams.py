"""Queries that run the streaming jobs over the event table and read their sinks back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.operators import context, history, isolation, risk, sketches
from flowvigil.plans.detect import Models, live_detections
from flowvigil.plans.models import given_forest, given_score_sql
from flowvigil.plans.registry import PARTS, query
from flowvigil.plans.response import _SENT_SQL
from flowvigil.plans.views import Tables, view_over
from flowvigil.session import materialise, scratch_path
from flowvigil.streaming import jobs, recent

FILE_ROWS = 50_000  # rows that one task of a micro-batch reads


def _stream(t: Tables) -> DataFrame:
    events = jobs.file_stream(t.spark, t.sf_dir, t.table("events").schema, "events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _split_stream(t: Tables, parts: int = 4, file_rows: int = FILE_ROWS) -> DataFrame:
    """The same events cut by time, one part per micro-batch; a part has a file for every ``file_rows`` rows.

    Files are taken in the order in which they were written, so parts of several files are written one after the other.
    """
    path = scratch_path(t.spark, "arriving")
    files = max(1, -(-t.events.count() // (parts * file_rows)))
    if files == 1:
        t.events.repartitionByRange(parts, "ts").write.parquet(path)
    else:
        at = F.unix_micros("ts")
        cuts = t.events.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
        part = sum((F.coalesce((at > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0))
        for i in range(parts):
            t.events.where(part == i).repartition(files).write.mode("append").parquet(path)
    return jobs.file_stream(t.spark, path, t.events.schema, files_per_batch=files)


def _checkpoint(t: Tables, name: str) -> str:
    """A query runs its job once over all events, so its checkpoint is its own."""
    return scratch_path(t.spark, f"{name}-checkpoint")


def _sunk(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path = scratch_path(t.spark, name)
    jobs.run(stream, _checkpoint(t, name), path=path)
    return t.spark.read.schema(stream.schema).parquet(path)


@query("st1_ingest_loop", "select flow_id, ts, src_ip, dst_ip, bytes, cast(ts as date) as date, true as published from flows")
def _ingest(t):
    store, topic = scratch_path(t.spark, "store"), scratch_path(t.spark, "topic")
    flows = view_over(_split_stream(t), "flows").select("flow_id", "ts", "src_ip", "dst_ip", "bytes")

    def publish(records: DataFrame, batch: int) -> None:
        records.write.mode("overwrite").text(f"{topic}/batch={batch}")

    jobs.run(flows, _checkpoint(t, "ingest"), each_batch=jobs.ingest(store, publish))
    sent = t.spark.read.text(topic).select(F.get_json_object("value", "$.flow_id").cast("bigint").alias("flow_id"),
                                           F.lit(True).alias("published"))
    return t.spark.read.parquet(store).drop("batch").join(sent, "flow_id", "left")


def _kept(t: Tables, changes: DataFrame, name: str, mode: str) -> str:
    """Run a job whose result is its state; the checkpoint that holds it."""
    checkpoint = _checkpoint(t, name)
    with recent.rocksdb_state(t.spark):
        jobs.run(changes, checkpoint, mode=mode, each_batch=lambda df, batch: jobs.write_batch(df, scratch_path(t.spark, name), batch))
    return checkpoint


@query("t8_recent_ring_stream", """
select source, seq, ts, recent_no from (
  select source, seq, ts, row_number() over (partition by source order by ts desc, seq desc) as recent_no
  from detections) as r where recent_no <= 1000""")
def _ring(t):
    """The ring after four micro-batches, read from the state."""
    rows = view_over(_split_stream(t), "detections").select("source", "seq", "ts")
    checkpoint = _kept(t, recent.keep_ring(rows, "source", ["ts", "seq"], 1000), "ring", "update")
    ring = recent.recent_ring(t.spark, checkpoint, rows.schema, "source", ["ts", "seq"], 1000)
    return ring.withColumn("recent_no", F.col("recent_no").cast("bigint"))


@query("s8_recent_cache_stream", """
select event_id, 'recent_events:' || strftime(ts, '%Y%m%d%H%M') as cache_key from events
where ts > (select max(ts) from events) - interval '1 day'""")
def _cache(t):
    """What is younger than a day after four micro-batches, read from the state; older minutes have left it."""
    rows = _split_stream(t).select("event_id", "ts")
    checkpoint = _kept(t, recent.keep_recent(rows, ttl_seconds=86400), "cache", "append")
    return recent.recent_events(t.spark, checkpoint, rows.schema, ttl_seconds=86400).select("event_id", "cache_key")


@query("st2_live_detect")
def _live(t):
    features = materialise(context.model_features(t.flows))
    models = Models(isolation.fit_isolation_forest(features, context.MODEL_COLUMNS, "flow_id"))
    path = scratch_path(t.spark, "live")
    jobs.run(view_over(_split_stream(t, 2), "flows"), _checkpoint(t, "live"), each_batch=jobs.live_detection(models, path))
    return t.spark.read.parquet(path)


PARTS["live_scored"] = f"""
select *, greatest(0e0, least(1e0, (raw - 4e-1)/(2e-1 + 1e-8))) as anomaly_score
from (select *, {given_score_sql('packets', 'bytes', ('60e0', '6000e0'))} as raw from flows) as f"""
_LIVE_COLUMNS = ("seq", "threat_id", "ts", "src_ip", "dst_port", "source", "is_anomaly", "anomaly_score", "risk_score", "severity",
                 "recommended_action", "status")


def _live_table(t):
    """Detections with the given forest, written by one query in append mode."""
    models = Models(given_forest(["packet_count", "byte_count"], (60.0, 6000.0)))
    found = live_detections(view_over(_split_stream(t, 3), "flows"), models)
    path = scratch_path(t.spark, "live-table")
    jobs.run(found, _checkpoint(t, "live-table"), path=path)
    return path, found.schema


@query("st2_live_transform", """
select flow_id as seq, 'RT-' || strftime(ts, '%Y%m%d') || '-' || cast(flow_id as varchar) as threat_id, ts, src_ip, dst_port, 'realtime' as source,
  raw > 48e-2 as is_anomaly, anomaly_score, 28 + 20*anomaly_score as risk_score,
  case when 28 + 20*anomaly_score < 40 then 'low' else 'medium' end as severity,
  (select min_by(a.action, a.ord) from action_ranges a where 28 + 20*anomaly_score between a.lo and a.hi) as recommended_action,
  'executed' as status from live_scored""", "anomaly_score risk_score")
def _live_transform(t):
    path, schema = _live_table(t)
    return t.spark.read.schema(schema).parquet(path).select(*_LIVE_COLUMNS)


@query("st2_live_transform_audit", """
select src_ip, count(*) as events, count(*) filter (where raw > 48e-2) as anomalies, max(28 + 20*anomaly_score) as max_risk_score
from live_scored group by 1""", "max_risk_score")
def _live_audit(t):
    """A second job reads the detections of the first as a stream and keeps its own table."""
    path, schema = _live_table(t)
    log = scratch_path(t.spark, "live-audit")
    jobs.run(risk.audit_rows(jobs.stored_stream(t.spark, path, schema)), _checkpoint(t, "live-audit"), path=log)
    return t.spark.read.schema(schema).parquet(log).groupBy("src_ip").agg(
        F.count("*").alias("events"), F.count_if("is_anomaly").alias("anomalies"), F.max("risk_score").alias("max_risk_score"))


@query("st2_live_detect_safe_mode", """
select flow_id as seq, ts, src_ip, dst_ip, dst_port, 0e0 as anomaly_score, 'unknown' as threat_class, 28e0 as risk_score,
  'low' as severity, 'monitor' as recommended_action, 'executed' as status from flows""", "risk_score")
def _live_safe(t):
    path = scratch_path(t.spark, "live-safe")
    jobs.run(view_over(_split_stream(t, 3), "flows"), _checkpoint(t, "live-safe"), each_batch=jobs.live_detection(Models(), path))
    return t.spark.read.parquet(path).select("seq", "ts", "src_ip", "dst_ip", "dst_port", "anomaly_score", "threat_class",
                                             "risk_score", "severity", "recommended_action", "status")


def _live_history(t):
    path, log = scratch_path(t.spark, "live-seen"), scratch_path(t.spark, "live-history")
    jobs.run(view_over(_split_stream(t, 3), "flows"), _checkpoint(t, "live-history"),
             each_batch=jobs.live_detection(Models(), path, history_path=log))
    return t.spark.read.parquet(log)


query("st2_live_history_stats", """
select count(*) as total_actions, cast(0 as bigint) as high_risk_threats, cast(0 as bigint) as blocked_ips, count(*) as monitored_flows
from flows""")(lambda t: history.stats(_live_history(t), "realtime"))
query("st2_live_history_sources", "select src_ip as ip, count(*) as count from flows group by 1 order by 2 desc, 1 limit 10")(
    lambda t: history.top_counts(_live_history(t), "src_ip", "ip"))
query("st2_live_history_detailed", """
select flow_id as seq, ts as timestamp, 'RT-' || strftime(ts, '%Y%m%d') || '-' || cast(flow_id as varchar) as threat_id,
  'low' as severity, 'monitor' as action, 28e0 as risk_score, src_ip, dst_ip, cast(src_port as varchar) as src_port,
  cast(protocol as varchar) as protocol, 'unknown' as threat_class, 'realtime' as source, 'unknown' as process,
  cast(dst_port as varchar) as dst_port, coalesce(service, 'UNKNOWN') as service,
  coalesce(service_desc, 'Unknown Service') as service_desc
from flows left join ports on dst_port = port""", "risk_score")(lambda t: history.detailed_history(_live_history(t)))

query("st3_live_alerts", """
select threat_id, dst_port, risk_score, action, source, severity in ('medium', 'high', 'critical') or risk_score > 30 as logged,
  seq, ts, threat_class, src_ip as source_ip, dst_ip as destination, severity,
  'Detected ' || threat_class || ' attack from ' || src_ip || ' targeting ' || dst_ip
    || '. Immediate investigation recommended.' as description
from scored""", "risk_score")(
    lambda t: _sunk(t, jobs.live_alerts(view_over(_split_stream(t), "detections")), "alerts"))

query("st4_window_features", """
with w as (select to_timestamp(floor(epoch(ts)/300)*300) at time zone 'UTC' as ws, f.* from flows f),
closed as (select * from w where ws + interval '5 minutes' <= (select max(ts) from flows) - interval '10 minutes'),
pe as (select ws, src_ip, abs(-sum((n*1e0/total)*ln(n*1e0/total))) as h from (select ws, src_ip, protocol, count(*) as n,
  sum(count(*)) over (partition by ws, src_ip) as total from closed group by 1, 2, 3) as c group by 1, 2),
de as (select ws, src_ip, abs(-sum((n*1e0/total)*ln(n*1e0/total))) as h from (select ws, src_ip, dst_port, count(*) as n,
  sum(count(*)) over (partition by ws, src_ip) as total from closed group by 1, 2, 3) as c group by 1, 2)
select c.ws as window_start, c.ws + interval '5 minutes' as window_end, c.src_ip, cast(sum(packets) as bigint) as packet_count,
  cast(sum(bytes) as bigint) as byte_count, sum(flow_duration) as duration, sum(packets)/(sum(flow_duration) + 1e-6) as packets_per_second,
  sum(bytes)/(sum(flow_duration) + 1e-6) as bytes_per_second, sum(bytes)/(sum(packets) + 1e-6) as avg_packet_size,
  any_value(pe.h) as protocol_entropy, any_value(de.h) as port_entropy, count(distinct dst_ip) as unique_dst_ips,
  count(distinct dst_port) as unique_dst_ports, coalesce(var_samp(bytes), 0e0) as packet_size_variance,
  coalesce(stddev_samp(bytes), 0e0) as packet_size_std
from closed c join pe on c.ws = pe.ws and c.src_ip = pe.src_ip join de on c.ws = de.ws and c.src_ip = de.src_ip group by 1, 2, 3""",
      "duration:4 packets_per_second:4 bytes_per_second:3 avg_packet_size:4 protocol_entropy port_entropy packet_size_variance:3 packet_size_std:4")(
    lambda t: _sunk(t, jobs.window_features(view_over(_stream(t), "flows")), "windows"))

_SKETCHED = """
select {start} as window_start, {start} + interval '{length}' as window_end, src_ip, count(*) as flow_count, cast(sum(packets) as bigint) as packet_count,
  cast(sum(bytes) as bigint) as byte_count, sum(flow_duration) as duration, sum(packets)/(sum(flow_duration) + 1e-6) as packets_per_second,
  sum(bytes)/(sum(flow_duration) + 1e-6) as bytes_per_second, sum(bytes)/(sum(packets) + 1e-6) as avg_packet_size,
  count(distinct dst_ip) as unique_dst_ips, count(distinct dst_port) as unique_dst_ports,
  coalesce(var_samp(bytes), 0e0) as packet_size_variance, coalesce(stddev_samp(bytes), 0e0) as packet_size_std
from (select to_timestamp(floor(epoch(ts)/300)*300) at time zone 'UTC' as ws, f.* from flows f) as w
where ws + interval '5 minutes' <= (select max(ts) from flows) - interval '10 minutes' group by 1, 2, 3"""
_SKETCH_DIGITS = "duration:4 packets_per_second:4 bytes_per_second:3 avg_packet_size:4 packet_size_variance:3 packet_size_std:4"


def _sketched(t: Tables) -> DataFrame:
    return _sunk(t, sketches.window_sketches(view_over(_stream(t), "flows")), "sketches")


query("st4_window_sketches", _SKETCHED.format(start="ws", length="5 minutes"), _SKETCH_DIGITS)(
    lambda t: sketches.sketch_features(_sketched(t)))
query("st4_window_sketches_hourly", _SKETCHED.format(start="date_trunc('hour', ws)", length="1 hour"), _SKETCH_DIGITS)(
    lambda t: sketches.sketch_features(sketches.roll_up(_sketched(t))))
query("st4_window_sketches_daily", _SKETCHED.format(start="date_trunc('day', ws)", length="1 day"), _SKETCH_DIGITS)(
    lambda t: sketches.sketch_features(sketches.roll_up(sketches.roll_up(_sketched(t)), "1 day")))


@query("st5_running_stats", """
select src_ip, count(*) as events, max(risk_score) as max_risk_score, count(*) filter (where severity = 'low') as low,
  count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'high') as high,
  count(*) filter (where severity = 'critical') as critical from scored group by 1""", "max_risk_score")
def _running(t):
    path = scratch_path(t.spark, "running")
    jobs.run(jobs.running_stats(view_over(_split_stream(t), "detections")), _checkpoint(t, "running"), mode="update",
             each_batch=lambda df, batch: jobs.write_batch(df, path, batch))
    return jobs.latest_state(t.spark, path)


query("st6_throttle_state", _SENT_SQL.replace("{seconds}", "86400"))(
    lambda t: _sunk(t, jobs.throttled(risk.score_detections(view_over(_stream(t), "detections")).where(
        F.col("severity").isin("high", "critical")), seconds=86400), "throttle"))


@query("st7_stream_dedupe", "select event_id, ts, user_id, event_type, value from events")
def _dedupe(t):
    path = scratch_path(t.spark, "repeated")
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    rows.union(rows.where("event_id % 40 = 0")).write.parquet(path)
    return _sunk(t, jobs.dedupe(jobs.file_stream(t.spark, path, rows.schema)), "dedupe")


query("x1_alert_correlation_stream", """
with g as (select src_ip, ts, seq, risk_score, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 300000000 then 0 else 1 end as s
  from scored window w as (partition by src_ip order by ts, seq)),
r as (select *, sum(s) over (partition by src_ip order by ts, seq) as no from g)
select src_ip, min(ts) as first_seen, count(*) as alerts, max(risk_score) as max_risk_score from r group by src_ip, no
having count(*) >= 2 and max(ts) + interval '5 minutes' < (select max(ts) from scored) - interval '10 minutes'""", "max_risk_score")(
    lambda t: _sunk(t, jobs.correlated_alerts(risk.score_detections(view_over(_stream(t), "detections"))), "incidents"))
