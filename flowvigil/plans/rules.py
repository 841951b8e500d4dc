"""Queries of the detection rules and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowvigil.operators import evaluate, networks, policies, risk, rules
from flowvigil.plans.registry import PARTS, query
from flowvigil.session import scratch_path
from flowvigil.sources import sinks

query("g1_port_scan_rule", """
select src_ip, dst_ip, date_trunc('day', ts) as window_start, count(distinct dst_port) as ports from flows
where packets <= 40 and bytes <= 20000 group by 1, 2, 3 having count(distinct dst_port) >= 2""")(
    lambda t: rules.port_scan(t.flows, "1 day", min_ports=2, max_packets=40, max_bytes=20000))
query("g2_brute_force_rule", """
select src_ip, date_trunc('day', ts) as window_start, count(*) as attempts, count(distinct dst_port) as ports from flows
where dst_port in (22, 3389, 21, 23) group by 1, 2 having count(*) >= 3""")(
    lambda t: rules.brute_force(t.flows, "1 day", min_flows=3))
query("g3_ddos_rule", """
select dst_ip, date_trunc('hour', ts) as window_start, count(distinct src_ip) as sources,
  sum(bytes)/(sum(flow_duration) + 1e-6) as bytes_per_second from flows group by 1, 2
having count(distinct src_ip) >= 2 and sum(bytes)/(sum(flow_duration) + 1e-6) >= 999""", "bytes_per_second:3")(
    lambda t: rules.ddos(t.flows, "1 hour", min_sources=2, min_bytes_per_second=999))
query("g4_exfil_rule", """
select src_ip, cast(sum(bytes) as bigint) as bytes_out, sum(flow_duration) as seconds, count(*) as flows from flows
where (src_ip like '192.168.%' or src_ip like '203.0.113.%' or src_ip like '10.%') and dst_ip like '93.%'
group by 1 having sum(bytes) >= 50000 and sum(flow_duration) >= 30""", "seconds:4")(
    lambda t: rules.exfiltration(t.flows, min_bytes=50_000))
query("g5_c2_port_rule", """
select flow_id, src_ip, dst_ip, dst_port from flows where dst_port in (4444, 5555, 9001, 6666, 31337)
  and (src_ip like '192.168.%' or src_ip like '203.0.113.%' or src_ip like '10.%')""")(
    lambda t: rules.c2_ports(t.flows).select("flow_id", "src_ip", "dst_ip", "dst_port"))
query("g6_exploit_burst_rule", """
select flow_id, dst_port, flow_duration, bytes from flows where dst_port in (445, 139, 135, 8443, 9090)
  and flow_duration <= 2 and bytes >= 1000""")(
    lambda t: rules.exploit_burst(t.flows, max_seconds=2.0, min_bytes=1000).select(
        "flow_id", "dst_port", "flow_duration", "bytes"))

# the same rules with the published thresholds
query("g1_port_scan_rule_published", """
select src_ip, dst_ip, to_timestamp(floor(epoch(ts)/300)*300) at time zone 'UTC' as window_start, count(distinct dst_port) as ports from flows
where packets <= 3 and bytes <= 200 group by 1, 2, 3 having count(distinct dst_port) >= 20""")(lambda t: rules.port_scan(t.flows))
query("g2_brute_force_rule_published", """
select src_ip, to_timestamp(floor(epoch(ts)/300)*300) at time zone 'UTC' as window_start, count(*) as attempts, count(distinct dst_port) as ports
from flows where dst_port in (22, 3389, 21, 23) group by 1, 2 having count(*) >= 20""")(lambda t: rules.brute_force(t.flows))
query("g3_ddos_rule_published", """
select dst_ip, to_timestamp(floor(epoch(ts)/300)*300) at time zone 'UTC' as window_start, count(distinct src_ip) as sources,
  sum(bytes)/(sum(flow_duration) + 1e-6) as bytes_per_second from flows group by 1, 2
having count(distinct src_ip) >= 50 and sum(bytes)/(sum(flow_duration) + 1e-6) >= 1e7""", "bytes_per_second:3")(lambda t: rules.ddos(t.flows))
query("g4_exfil_rule_published", """
select src_ip, cast(sum(bytes) as bigint) as bytes_out, sum(flow_duration) as seconds, count(*) as flows from flows
where (src_ip like '192.168.%' or src_ip like '203.0.113.%' or src_ip like '10.%') and dst_ip like '93.%'
group by 1 having sum(bytes) >= 500000000 and sum(flow_duration) >= 30""", "seconds:4")(lambda t: rules.exfiltration(t.flows))
query("g6_exploit_burst_rule_published", """
select flow_id, dst_port, flow_duration, bytes from flows where dst_port in (445, 139, 135, 8443, 9090)
  and flow_duration <= 1e-1 and bytes >= 50000000""")(
    lambda t: rules.exploit_burst(t.flows).select("flow_id", "dst_port", "flow_duration", "bytes"))

query("x1_alert_correlation", """
with g as (select src_ip, ts, seq, risk_score, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 7200000000 then 0 else 1 end as s
  from scored window w as (partition by src_ip order by ts, seq)),
r as (select *, sum(s) over (partition by src_ip order by ts, seq) as incident_no from g)
select src_ip, cast(incident_no as bigint) as incident_no, count(*) as alerts, min(ts) as first_seen, max(ts) as last_seen,
  max(risk_score) as max_risk_score from r group by 1, 2 having count(*) >= 2""", "max_risk_score")(
    lambda t: policies.correlate_alerts(risk.score_detections(t.detections), seconds=7200))
query("x1_alert_correlation_300s", """
with g as (select src_ip, ts, seq, risk_score, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 300000000 then 0 else 1 end as s
  from scored window w as (partition by src_ip order by ts, seq)),
r as (select *, sum(s) over (partition by src_ip order by ts, seq) as incident_no from g)
select src_ip, cast(incident_no as bigint) as incident_no, count(*) as alerts, min(ts) as first_seen, max(ts) as last_seen,
  max(risk_score) as max_risk_score from r group by 1, 2 having count(*) >= 2""", "max_risk_score")(
    lambda t: policies.correlate_alerts(risk.score_detections(t.detections)))

query("x2_rolling_baseline", """
select user_id, count(data_volume) as samples, avg(data_volume) as mean, stddev_pop(data_volume) as std from user_events
where ts > (select max(ts) from user_events) - interval '28 days' group by 1 having count(data_volume) >= 50""", "mean std")(
    lambda t: policies.rolling_baseline(t.user_events, "user_id", "data_volume", min_samples=50))
query("x3_zone_thresholds", """
select event_id, u.zone, score, 8e-1*coalesce(multiplier, 1e0) as threshold, score > 8e-1*coalesce(multiplier, 1e0) as is_anomaly
from (select event_id, zone, least(data_volume/100e0, 1e0) as score from user_events) as u left join zones z on u.zone = z.zone""",
      "score threshold")(
    lambda t: policies.zone_flags(t.user_events.select(
        "event_id", "zone", F.least(F.col("data_volume") / 100, F.lit(1.0)).alias("score")), "score"))
query("x4_retention", """
select event_id, ts from events where ts >= cast((select max(ts) from events) as date) - interval '14 days'""")(
    lambda t: policies.retain(t.table("events"), days=14).select("event_id", "ts"))
query("x4_retention_90", """
select event_id, ts from events where ts >= cast((select max(ts) from events) as date) - interval '90 days'""")(
    lambda t: policies.retain(t.table("events")).select("event_id", "ts"))


def _stored(t) -> str:
    path = scratch_path(t.spark, "dated")
    sinks.store_by_date(t.events.select("event_id", "ts"), path)
    return path


@query("x4_retention_drop", """
select event_id, ts from events where cast(ts as date) >= cast((select max(ts) from events) as date) - interval '14 days'""")
def _retention_drop(t):
    """What is left in a dated store after its old folders were removed."""
    path = _stored(t)
    sinks.drop_expired(t.spark, path, days=14)
    return t.spark.read.parquet(path).select("event_id", "ts")


@query("x4_retention_report", """
select cast(ts as date) as date, cast(ts as date) < (select max(cast(ts as date)) from events) - interval '7 days' as expired,
  false as dropped from events group by 1""")
def _retention_report(t):
    """The dry run: every date folder and whether it would go."""
    return sinks.drop_expired(t.spark, _stored(t), days=7, dry_run=True).select("date", "expired", "dropped")


query("x5_anonymise", """
select flow_id, sha256('pepper' || cast(user_id as varchar)) as user_id, sha256('pepper' || src_ip) as src_ip,
  regexp_replace(dst_ip, '\\.[0-9]+$', '.0') as dst_ip from flows""")(
    lambda t: policies.anonymise(t.flows.select("flow_id", "user_id", "src_ip", "dst_ip"),
                                 ["user_id", "src_ip"], ["dst_ip"], "pepper"))
query("x6_drift", """
with b as (select (bytes >= 500)::int + (bytes >= 1000)::int + (bytes >= 2000)::int + (bytes >= 5000)::int + (bytes >= 10000)::int as bin,
  ts >= timestamp '2024-01-16' as cur from flows),
c as (select bin, count(*) filter (where cur) as c, count(*) filter (where not cur) as r from b group by 1),
s as (select greatest(c*1e0/sum(c) over (), 1e-6) as p, greatest(r*1e0/sum(r) over (), 1e-6) as q from c)
select sum((p - q)*ln(p/q)) as shift, sum((p - q)*ln(p/q)) > 15e-2 as drifted from s""", "shift:9")(
    lambda t: policies.population_shift(t.flows, "bytes", [500, 1000, 2000, 5000, 10000],
                                        F.col("ts") >= F.lit("2024-01-16").cast("timestamp")))

PARTS["period_metrics"] = """
select model, period, (tp + tn)*1e0/n as accuracy, coalesce(2e0*tp/nullif(2*tp + fp + fn, 0), 0e0) as f1_score from (
  select model, event_id%12 as period, count(*) filter (where y_true = 1 and y_pred = 1) as tp,
    count(*) filter (where y_true = 0 and y_pred = 1) as fp, count(*) filter (where y_true = 1 and y_pred = 0) as fn,
    count(*) filter (where y_true = 0 and y_pred = 0) as tn, count(*) as n from predictions group by 1, 2) as c"""


def _period_metrics(t):
    rows = t.predictions.withColumn("period", F.col("event_id") % 12)
    return evaluate.binary_metrics(rows, by=["model", "period"])


query("x6_score_drop", """
select model, max(case when period < 3 then f1_score end) as f1_before, max(case when period >= 9 then f1_score end) as f1_after,
  max(case when period < 3 then f1_score end) - max(case when period >= 9 then f1_score end) > 1e-1 as degraded
from period_metrics where period < 3 or period >= 9 group by 1""", "f1_before f1_after")(
    lambda t: policies.score_drop(
        _period_metrics(t).where("period < 3 or period >= 9").withColumn(
            "half", F.when(F.col("period") < 3, "old").otherwise("new")), "model", "half", "old", "new"))
query("x7_version_compare", """
select suite, version, accuracy, f1_score, accuracy_change, f1_change, age from (
  select model as suite, period as version, accuracy, f1_score, accuracy - lag(accuracy) over w as accuracy_change,
    f1_score - lag(f1_score) over w as f1_change, cast(row_number() over (partition by model order by period desc) as int) as age
  from period_metrics window w as (partition by model order by period)) as v where age <= 3""",
      "accuracy f1_score accuracy_change f1_change")(
    lambda t: policies.compare_versions(_period_metrics(t).select(
        F.col("model").alias("suite"), F.col("period").alias("version"), "accuracy", "f1_score"), keep=3))

query("x8_maintenance_suppress_long", """
select seq, dst_ip, confidence from detections d where confidence >= 75e-2 and not exists (
  select 1 from (select dst_ip, ts as s, case when seq%200 = 0 then ts + interval '9 days' when seq%300 = 100 then null
      else ts + interval '7000 years' end as e from detections where seq%100 = 0 and ts > timestamp '2024-01-15') as w
  where w.dst_ip = d.dst_ip and d.ts >= w.s and (w.e is null or d.ts <= w.e))""")(
    lambda t: policies.suppress_in_maintenance(t.detections, t.detections.where("seq % 100 = 0 and ts > timestamp '2024-01-15'").select(
        "dst_ip", F.col("ts").alias("start"),
        F.expr("case when seq % 200 = 0 then ts + interval 9 days when seq % 300 = 100 then null else ts + interval 7000 years end").alias("end"))
    ).select("seq", "dst_ip", "confidence"))
query("x8_maintenance_suppress", """
select seq, dst_ip, confidence from detections d where confidence >= 75e-2 and not exists (
  select 1 from (select dst_ip, ts as s, ts + interval '3 hours' as e from detections where seq%100 = 0) as w
  where w.dst_ip = d.dst_ip and d.ts between w.s and w.e)""")(
    lambda t: policies.suppress_in_maintenance(t.detections, t.detections.where("seq % 100 = 0").select(
        "dst_ip", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 3 hours")).alias("end"))).select(
        "seq", "dst_ip", "confidence"))
_FEED_SQL = """(select src_ip as ip, 'high' as level from flows where user_id%9 = 0
  union select dst_ip, 'low' from flows where dst_ip like '93.%.1')"""
query("x9_ioc_match", f"""
select flow_id, f.src_ip, f.dst_ip, s.level as src_level, d.level as dst_level from flows f
left join {_FEED_SQL} as s on f.src_ip = s.ip left join {_FEED_SQL} as d on f.dst_ip = d.ip
where s.level is not null or d.level is not null""")(
    lambda t: policies.match_indicators(
        t.flows.select("flow_id", "src_ip", "dst_ip"),
        t.flows.where("user_id % 9 = 0").select(F.col("src_ip").alias("ip"), F.lit("high").alias("level")).union(
            t.flows.where("dst_ip like '93.%.1'").select("dst_ip", F.lit("low"))).distinct()))

# nested networks with host bits set, single addresses, and texts that are no networks
_NETWORK_FEED_SQL = """
select concat('203.0.113.', cast(user_id%250 + 1 as varchar(10)), '/', cast(25 + user_id%7 as varchar(10))) as network,
  case when user_id%3 = 0 then 'high' else 'medium' end as level from flows where user_id%4 = 0
union select concat('203.', cast(user_id%3 as varchar(10)), '.113.9/', cast(8 + user_id%16 as varchar(10))), 'low' from flows where user_id%10 = 5
union select concat('10.0.', cast(packets%4 as varchar(10)), '.0/24'), 'low' from flows where packets%2 = 1
union select concat('8.8.4.', cast(user_id%250 + 1 as varchar(10)), '/', cast(user_id%40 as varchar(10))), 'critical' from flows where user_id%5 = 1 and user_id%40 > 24
union select dst_ip, 'critical' from flows where dst_ip like '93.%.1'
union select concat('93.184.216.300/', cast(user_id%3 as varchar(10))), 'high' from flows where user_id%7 = 0"""
PARTS["network_feed"] = _NETWORK_FEED_SQL
PARTS["networks"] = """
select bits, n - n%(cast(1 as bigint) << (32 - bits)) as lo, max_by(network, (rank, network)) as network, max_by(level, (rank, network)) as level from (
  select network, level, list_position(['low','medium','high','critical'], level) as rank,
    case when network like '%/%' then cast(split_part(network,'/',2) as int) else 32 end as bits,
    list_reduce(list_transform(string_split(split_part(network,'/',1),'.'), lambda x: cast(x as bigint)), lambda a, b: a*256 + b) as n
  from network_feed where network not like '%.300/%') as p where bits <= 32 group by 1, 2"""
PARTS["flow_numbers"] = """
select flow_id, src_ip, dst_ip, list_reduce(list_transform(string_split(src_ip,'.'), lambda x: cast(x as bigint)), lambda a, b: a*256 + b) as s,
  list_reduce(list_transform(string_split(dst_ip,'.'), lambda x: cast(x as bigint)), lambda a, b: a*256 + b) as d from flows"""
PARTS["covered"] = """
select n, max_by(network, bits) as network, max_by(level, bits) as level
from (select distinct s as n from flow_numbers union select d from flow_numbers) as a
join networks w on a.n between w.lo and w.lo + (cast(1 as bigint) << (32 - w.bits)) - 1 group by 1"""

query("x9_network_match", """
select flow_id, src_ip, dst_ip, s.network as src_network, s.level as src_level, d.network as dst_network, d.level as dst_level
from flow_numbers f left join covered s on f.s = s.n left join covered d on f.d = d.n
where s.network is not null or d.network is not null""")(
    lambda t: networks.match_networks(t.flows.select("flow_id", "src_ip", "dst_ip"), t.spark.sql(
        _NETWORK_FEED_SQL.replace("from flows", "from {flows}"), flows=t.flows)))
