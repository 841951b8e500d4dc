"""Queries of sources, sinks, cleaning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowvigil.operators import clean, context, evaluate, risk
from flowvigil.plans.registry import PARTS, query
from flowvigil.session import scratch_path
from flowvigil.sources import files, sinks

# --- sources ----------------------------------------------------------------

query("s1_parquet_scan", """
select event_id, user_id, value from events where event_type = 'error' and value > 50""")(
    lambda t: files.read_parquet(t.spark, f"{t.sf_dir}/events.parquet").where(
        "event_type = 'error' and value > 50").select("event_id", "user_id", "value"))

_FLOW_CSV = "flow_id bigint, src_ip string, dst_port int, protocol int, packets bigint, bytes bigint, flow_duration double"


@query("s2_csv_scan", "select flow_id, src_ip, dst_port, protocol, packets, bytes, flow_duration from flows")
def _csv(t):
    path = scratch_path(t.spark, "flows-csv")
    t.flows.select("flow_id", "src_ip", "dst_port", "protocol", "packets", "bytes", "flow_duration").write.option(
        "header", "true").csv(path)
    return files.read_csv(t.spark, path, _FLOW_CSV)


@query("s3_arff_scan", """
select cast(event_id as double) as event_id, protocol_type, duration, cast(src_bytes as double) as src_bytes, class from kdd_raw""")
def _arff(t):
    path = scratch_path(t.spark, "kdd-arff")
    header = ["% flows", "@relation kdd", "@attribute event_id numeric", "@attribute 'protocol_type' {'tcp','udp','icmp','other'}",
              "@attribute duration real", "@attribute src_bytes numeric", "@attribute class {'normal','neptune'}", "", "@data"]
    t.spark.createDataFrame([(line,) for line in header], "value string").coalesce(1).write.text(f"{path}/a_header")
    t.kdd_raw.select(F.concat_ws(",", "event_id", F.concat(F.lit("'"), "protocol_type", F.lit("'")), "duration",
                                 "src_bytes", "class").alias("value")).write.text(f"{path}/b_data")
    return files.read_arff(t.spark, path)


def _json_lines(t):
    """Flow events as JSON text; every 50th is cut short, every 70th lacks its target."""
    whole = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "src_ip",
        F.when(F.col("flow_id") % 70 != 0, F.col("dst_ip")).alias("dst_ip"), "src_port", "dst_port", "protocol",
        "packets", "bytes", "flow_duration"))
    cut = F.substring(whole, 1, 40)
    return t.flows.select("flow_id", F.when(F.col("flow_id") % 50 == 0, cut).otherwise(whole).alias("value"))


query("s4_json_events", """
select flow_id, ts as timestamp, src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes, flow_duration,
  cast(null as varchar) as flags, cast(null as varchar) as service from flows where flow_id%50 <> 0 and flow_id%70 <> 0""")(
    lambda t: files.accepted(files.parse_json_events(_json_lines(t))))
query("s4_json_rejects", "select flow_id from flows where flow_id%50 = 0 or flow_id%70 = 0")(
    lambda t: files.rejected(files.parse_json_events(_json_lines(t))).select("flow_id"))

query("s5_recent_range_scan", """
select event_id, ts, user_id from events where ts >= (select max(ts) from events) - interval '5 minutes' order by ts desc limit 10000""")(
    lambda t: files.recent_range(t.table("events").select("event_id", "ts", "user_id"), limit=10_000))
query("s5_recent_range_scan_day", """
select event_id, ts, user_id from events where ts >= (select max(ts) from events) - interval '1 day' order by ts desc limit 10000""")(
    lambda t: files.recent_range(t.table("events").select("event_id", "ts", "user_id"), minutes=1440, limit=10_000))


@query("s6_raw_sink", """
select flow_id, ts, src_ip, dst_ip, dst_port, bytes, cast(ts as date) as date from flows""")
def _raw_sink(t):
    path = scratch_path(t.spark, "raw")
    sinks.store_by_date(t.flows.select("flow_id", "ts", "src_ip", "dst_ip", "dst_port", "bytes"), path)
    return t.spark.read.parquet(path)


@query("s7_topic_sink", "select flow_id, src_ip, dst_ip, dst_port, bytes, flow_duration from flows")
def _topic_sink(t):
    path = scratch_path(t.spark, "topic")
    sinks.publish(t.flows, path, fmt="text")
    schema = "flow_id bigint, src_ip string, dst_ip string, dst_port int, bytes bigint, flow_duration double"
    return t.spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


query("s8_recent_cache", """
select event_id, 'recent_events:' || strftime(ts, '%Y%m%d%H%M') as cache_key from events
where ts > (select max(ts) from events) - interval '1 hour'""")(
    lambda t: files.recent_cache(t.table("events")).select("event_id", "cache_key"))

PARTS["model_metrics"] = """
select model, (tp + tn)*1e0/samples as accuracy, coalesce(tp*1e0/nullif(tp + fp, 0), 0e0) as precision,
  coalesce(tp*1e0/nullif(tp + fn, 0), 0e0) as recall, coalesce(2e0*tp/nullif(2*tp + fp + fn, 0), 0e0) as f1_score, samples
from (select model, count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 1) as fp,
  count(*) filter (where y_true = 1 and y_pred = 0) as fn, count(*) filter (where y_true = 0 and y_pred = 0) as tn,
  count(*) as samples from predictions group by 1) as c"""


def _model_metrics(t):
    return evaluate.binary_metrics(t.predictions, by=["model"])


@query("s9_results_csv", """
select model, accuracy, case when model = 'pca' then null else f1_score end as f1_score, samples from model_metrics""",
       "accuracy f1_score")
def _results(t):
    path = scratch_path(t.spark, "results")
    nan_for_pca = F.when(F.col("model") == "pca", F.lit(float("nan"))).otherwise(F.col("f1_score"))
    sinks.write_results(_model_metrics(t).select("model", "accuracy", nan_for_pca.alias("f1_score"), "samples"), path)
    return sinks.read_results(t.spark, path, "model string, accuracy double, f1_score double, samples bigint")


@query("s11_audit_sink", """
select seq, threat_id, action, severity, risk_score, true as automated, cast(ts as date) as date, src_ip, threat_class from hist""",
       "risk_score")
def _audit(t):
    path = scratch_path(t.spark, "audit")
    log = risk.action_history(t.detections)
    sinks.append_audit(log.where("seq % 2 = 0"), path)
    sinks.append_audit(log.where("seq % 2 = 1"), path)
    return t.spark.read.parquet(path).select(
        "seq", "threat_id", "action", "severity", "risk_score", "automated", "date",
        "result.threat_details.src_ip", "result.threat_details.threat_class")


@query("o1_union_collectors", """
select 'netflow' as collector, flow_id as id, ts, src_ip, bytes, cast(null as varchar) as resource from flows
union all select 'siem', event_id, ts, null, null, resource from user_events""")
def _union(t):
    netflow = t.flows.select(F.lit("netflow").alias("collector"), F.col("flow_id").alias("id"), "ts", "src_ip", "bytes")
    siem = t.user_events.select(F.lit("siem").alias("collector"), F.col("event_id").alias("id"), "ts", "resource")
    return clean.union_sources(netflow, siem)


# --- cleaning ---------------------------------------------------------------

query("p1_column_map", """
select event_id, protocol_type as proto, duration as flow_duration, src_bytes, dst_bytes, count as packets, class as label from kdd_raw""")(
    lambda t: clean.map_columns(t.kdd_raw, "protocol_type=proto,duration=flow_duration,count=packets,class=label"))
query("p2_required_defaults", """
select flow_id, src_ip, '0.0.0.0' as dst_ip, 0 as src_port, dst_port, 6 as protocol, cast(1 as int) as packets, bytes,
  cast(0 as double) as flow_duration from flows""")(
    lambda t: clean.fill_required(t.flows.select("flow_id", "src_ip", "dst_port", "bytes")))
query("p3_connection_id", """
select flow_id, row_number() over (order by ts, flow_id) - 1 as connection_id from flows""")(
    lambda t: clean.ensure_connection_id(t.flows.select("flow_id", "ts"), ["ts", "flow_id"]).drop("ts"))


@query("p4_header_clean", "select event_id, flow_duration as \"Flow Duration\", label as \"Label\", 'Label' as label_column from dirty")
def _headers(t):
    messy = t.dirty.select("event_id", F.col("flow_duration").alias(" Flow Duration"), F.col("label").alias(" Label "))
    neat = clean.trim_headers(messy)
    return neat.withColumn("label_column", F.lit(clean.label_column(neat)))


query("p5_dedupe", "select distinct * from dirty")(lambda t: clean.drop_duplicates(t.dirty))
query("p5_duplicates_removed", """
select (select count(*) from dirty) as rows_before, count(*) as rows_after,
  (select count(*) from dirty) - count(*) as removed from (select distinct * from dirty) as d""")(
    lambda t: clean.duplicates_removed(t.dirty))

_NO_INF = """select event_id, flow_duration, case when isinf(byte_rate) then null else byte_rate end as byte_rate, proto, label from dirty"""
query("p6_inf_clean", _NO_INF)(lambda t: clean.clear_infinite(t.dirty))
query("p6_inf_to_zero", _NO_INF.replace("then null", "then 0e0"))(lambda t: clean.clear_infinite(t.dirty, 0.0))
_FULL_ENOUGH = f"""select * from ({_NO_INF}) as d where (event_id is not null)::int + (flow_duration is not null)::int
  + (byte_rate is not null)::int + (proto is not null)::int + (label is not null)::int >= 3"""
query("p7_sparse_row_drop", _FULL_ENOUGH)(lambda t: clean.drop_sparse_rows(clean.clear_infinite(t.dirty)))
query("p8_impute", f"""
with d as ({_NO_INF})
select event_id, coalesce(flow_duration, (select quantile_cont(flow_duration, 0.5) from d)) as flow_duration,
  coalesce(byte_rate, (select quantile_cont(byte_rate, 0.5) from d)) as byte_rate,
  coalesce(proto, (select proto from d where proto is not null group by 1 order by count(*) desc, 1 limit 1)) as proto,
  label from d""", "flow_duration byte_rate")(lambda t: clean.impute(clean.clear_infinite(t.dirty)))
query("p9_label_binarise", """
select event_id, case when upper(trim(label)) = 'BENIGN' then 0 else 1 end as trimmed,
  case when label = 'BENIGN' then 0 else 1 end as exact, case when lower(trim(label)) in ('benign', 'normal', '0') then 0 else 1 end as listed,
  case when event_id%3 <> 0 then 1 else 0 end as numbered from dirty""")(
    lambda t: t.dirty.select(
        "event_id", clean.binary_label(F.col("label")).alias("trimmed"),
        clean.binary_label(F.col("label"), ignore_case=False, trim=False).alias("exact"),
        clean.binary_label(F.col("label"), ["benign", "normal", "0"]).alias("listed"),
        clean.binary_number_label(F.col("event_id") % 3).alias("numbered")))
query("p10_label_encode", """
select event_id, cast(c as int) as proto from dirty left join (
  select proto as p, row_number() over (order by proto) - 1 as c from (select distinct proto from dirty where proto is not null) as u) as m
on proto = p""")(
    lambda t: clean.encode_labels(t.dirty.select("event_id", "proto"), ["proto"]))
query("p10_label_encode_unseen", """
select event_id, cast(case when event_type is null then null when c is null then 0 else c end as int) as event_type from events left join (
  select event_type as p, row_number() over (order by event_type) - 1 as c from (
    select distinct event_type from events where event_type <> 'purchase') as u) as m
on event_type = p""")(
    lambda t: clean.encode_labels(
        t.events.select("event_id", "event_type"), ["event_type"],
        {"event_type": context.fit_codes(t.events.where("event_type <> 'purchase'"), "event_type")}, unseen="first"))
query("p11_numeric_only", "select event_id, flow_duration, byte_rate from dirty")(lambda t: clean.numeric_only(t.dirty))
query("p12_kdd_normalise", """
select event_id, protocol_type, duration as flow_duration, src_bytes, dst_bytes, count as packets,
  case protocol_type when 'tcp' then 6 when 'udp' then 17 when 'icmp' then 1 else 0 end as protocol,
  src_bytes + dst_bytes as bytes, case when class = 'normal' then 0 else 1 end as label from kdd_raw""")(
    lambda t: clean.normalise_kdd(t.kdd_raw))


@query("p13_feature_align", """
select flow_id, cast(bytes as double) as bytes, cast(packets as double) as packets, 0e0 as diff_srv_rate,
  'diff_srv_rate' as missing, 'flow_id,protocol' as unexpected from flows""")
def _align(t):
    flows, expected = t.flows.select("flow_id", "packets", "bytes", "protocol"), ["bytes", "packets", "diff_srv_rate"]
    gaps = clean.feature_mismatch(flows, expected)
    return clean.align_features(flows, expected, ["flow_id"]).withColumns(
        {name: F.lit(",".join(columns)) for name, columns in gaps.items()})


query("p14_bootstrap_noise")(lambda t: clean.bootstrap_with_noise(
    t.flows.select("flow_id", "flow_duration", F.col("bytes").cast("double").alias("bytes")), ["flow_duration", "bytes"]))
query("p15_stratified_split", """
select flow_id, label, row_number() over (partition by label order by md5(cast(flow_id as varchar)), flow_id)
  <= floor(count(*) over (partition by label) * 2e-1) as held_out from flows""")(
    lambda t: clean.stratified_split(t.flows.select("flow_id", "label"), "label", "flow_id"))

query("p18_established_filter", """
select flow_id from (select flow_id, case when protocol = 6 then 'ESTABLISHED' else 'LISTEN' end as status,
  case when flow_id%9 <> 0 then dst_ip end as remote from flows) as c where status = 'ESTABLISHED' and remote is not null""")(
    lambda t: t.flows.select(
        "flow_id", F.when(F.col("protocol") == 6, "ESTABLISHED").otherwise("LISTEN").alias("status"),
        F.when(F.col("flow_id") % 9 != 0, F.col("dst_ip")).alias("remote")).where(
        (F.col("status") == "ESTABLISHED") & F.col("remote").isNotNull()).select("flow_id"))

# --- evaluation -------------------------------------------------------------

query("e1_binary_metrics", "select * from model_metrics", "accuracy precision recall f1_score")(_model_metrics)
query("e1_label_metrics", """
select (tp + tn)*1e0/samples as accuracy, coalesce(tp*1e0/nullif(tp + fp, 0), 0e0) as precision,
  coalesce(tp*1e0/nullif(tp + fn, 0), 0e0) as recall, coalesce(2e0*tp/nullif(2*tp + fp + fn, 0), 0e0) as f1_score, samples
from (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality <> 1 and toxic = 1) as fp,
  count(*) filter (where quality = 1 and toxic <> 1) as fn, count(*) filter (where quality <> 1 and toxic <> 1) as tn,
  count(*) as samples from labels) as c""", "accuracy precision recall f1_score")(
    lambda t: evaluate.binary_metrics(t.table("labels"), "quality", "toxic"))
query("e2_confusion_matrix", """
with n as (select distinct actual as c from predictions union select distinct predicted from predictions)
select a.c as actual, p.c as predicted, count(event_id) as count from n as a join n as p on true
left join predictions on actual = a.c and predicted = p.c group by 1, 2""")(
    lambda t: evaluate.confusion_matrix(t.predictions))
query("e3_class_report", """
with n as (select distinct actual as label from predictions union select distinct predicted from predictions),
c as (select label, (select count(*) from predictions where actual = label) as support,
  (select count(*) from predictions where predicted = label) as guessed,
  (select count(*) from predictions where actual = label and predicted = label) as tp from n),
r as (select label, coalesce(tp*1e0/nullif(guessed, 0), 0e0) as precision, coalesce(tp*1e0/nullif(support, 0), 0e0) as recall,
  coalesce(2e0*tp/nullif(support + guessed, 0), 0e0) as f1_score, support from c)
select label, precision, recall, f1_score, cast(support as bigint) as support from r
union all select 'accuracy', s, s, s, cast(n as bigint) from (select sum(tp)*1e0/sum(support) as s, sum(support) as n from c) as a
union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), cast(sum(support) as bigint) from r
union all select 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
  sum(f1_score*support)/sum(support), cast(sum(support) as bigint) from r""", "precision recall f1_score")(
    lambda t: evaluate.class_report(t.predictions))


@query("e4_benchmark_table")
def _benchmark(t):
    return evaluate.benchmark_table({
        name: (lambda name=name: t.predictions.where(F.col("model") == name)) for name in ("iforest", "kmeans", "pca")})


query("e5_benchmark_summary", """
select count(*) as models, max(accuracy) as best_accuracy, max(f1_score) as best_f1, avg(samples/1000e0) as avg_latency,
  (select model from model_metrics order by f1_score desc, model limit 1) as best_model,
  (select model from model_metrics order by f1_score, model limit 1) as worst_model, avg(recall) as avg_recall,
  avg(f1_score) as avg_f1, case when max(f1_score) >= 8e-1 then 'Excellent' when max(f1_score) >= 6e-1 then 'Good'
    when max(f1_score) >= 4e-1 then 'Fair' else 'Poor' end as quality from model_metrics""",
      "best_accuracy best_f1 avg_latency avg_recall avg_f1")(
    lambda t: evaluate.benchmark_summary(_model_metrics(t).withColumn("latency", F.col("samples") / 1000)))

query("m8_class_balance_report", "select label, count(*) as count from dirty group by 1")(
    lambda t: evaluate.label_counts(t.dirty, "label"))

_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("m3_soft_vote", """
with p as (select flow_id, c, sum((packets*(m + 1) + c*7) % 16)/16e0/4 as mean from flows
  join generate_series(0, 4) as s(c) on true join generate_series(0, 3) as g(m) on true group by 1, 2)
select flow_id, list_extract(['click','error','purchase','signup','view'], cast(max_by(c, mean*100 - c) + 1 as int)) as predicted,
  max(mean) as confidence from p group by 1""", "confidence")
def _soft(t):
    names = [f"p{m}" for m in range(4)]
    rows = t.flows.select("flow_id", *[F.array(*[
        ((F.col("packets") * (m + 1) + c * 7) % 16) / F.lit(16.0) for c in range(5)]).alias(n)
        for m, n in enumerate(names)])
    predicted, confidence = evaluate.soft_vote(names, _CLASSES)
    return rows.select("flow_id", predicted.alias("predicted"), confidence.alias("confidence"))


@query("m4_hard_vote", """
with v as (select flow_id, unnest([packets%3, bytes%3, flow_id%3, dst_port%3]) as code from flows)
select flow_id, code as vote from (select flow_id, code, row_number() over (partition by flow_id order by count(*) desc, code) as rn
  from v group by 1, 2) as r where rn = 1""")
def _hard(t):
    rows = t.flows.select("flow_id", (F.col("packets") % 3).alias("a"), (F.col("bytes") % 3).alias("b"),
                          (F.col("flow_id") % 3).alias("c"), (F.col("dst_port") % 3).cast("bigint").alias("d"))
    return rows.select("flow_id", evaluate.hard_vote(["a", "b", "c", "d"]).alias("vote"))
