"""Queries of enrichment, risk, response and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.functions.timeparts import duration_label
from flowvigil.operators import chains, enrich, history, risk, throttle
from flowvigil.plans.registry import PARTS, query

# --- shared check parts -----------------------------------------------------

_RISK = """greatest(0e0, least(100e0, coalesce(base_severity, 50e0)*5e-1 + anomaly_score*100*2e-1
  + confidence*100*2e-1 + 5e0*10*5e-2 + 1e0*10*5e-2))"""
_SEVERITY = """case when risk_score < 40 then 'low' when risk_score < 60 then 'medium'
  when risk_score < 80 then 'high' else 'critical' end"""

PARTS["risked"] = f"""
select d.*, coalesce(base_severity, 50e0) as base_severity, {_RISK} as risk_score
from detections d left join class_severity c on d.threat_class = c.threat_class"""

PARTS["scored"] = f"""
select r.*, {_SEVERITY} as severity,
  coalesce((select min_by(a.action, a.ord) from action_ranges a where r.risk_score between a.lo and a.hi), 'monitor') as action,
  case when risk_score >= 80 then 'pending_approval' else 'executed' end as status,
  'THR-' || strftime(ts, '%Y%m%d') || '-' || lpad(cast(seq as varchar), 6, '0') as threat_id
from risked r"""

PARTS["hist"] = "select * from scored where status <> 'pending_approval'"


def _scored(t):
    return risk.score_detections(t.detections)


def _history(t, **options):
    return risk.action_history(t.detections, **options)


# --- enrichment -------------------------------------------------------------

query("i1_port_service", """
select flow_id, f.dst_port, coalesce(service, 'UNKNOWN') as service,
  coalesce(service_desc, 'Unknown Service') as service_desc, coalesce(port_risk, 'unknown') as port_risk
from flows f left join ports p on f.dst_port = p.port""")(
    lambda t: enrich.port_service(t.flows.select("flow_id", "dst_port")))

# addresses spread over all of IPv4, some with an octet above 255
_ADDRESS_SQL = """
select event_id, case when event_id%7 = 0 then '127.0.0.1' when event_id%7 = 1 then '192.168.1.' || cast(user_id as varchar(10))
  when event_id%7 = 2 then '172.' || cast(user_id%40 as varchar(10)) || '.0.1' when event_id%7 = 3 then '192.0.0.' || cast(event_id%12 as varchar(10))
  else cast(event_id*37%260 as varchar(10)) || '.' || cast(event_id%256 as varchar(10)) || '.' || cast(user_id%256 as varchar(10)) || '.1' end as ip
from events"""
PARTS["addresses"] = _ADDRESS_SQL
PARTS["typed_addresses"] = """
select a.event_id, a.ip, case when bad then 'invalid' else coalesce(min_by(kind, prio), 'public') end as ip_type
from (select event_id, ip, n, exists (select 1 from (select unnest(string_split(ip, '.')) as o) as u where cast(o as int) > 255) as bad
  from (select event_id, ip, cast(split_part(ip,'.',1) as bigint)*16777216 + cast(split_part(ip,'.',2) as bigint)*65536
    + cast(split_part(ip,'.',3) as bigint)*256 + cast(split_part(ip,'.',4) as bigint) as n from addresses) as x) as a
left join ip_ranges r on a.n between r.lo and r.hi
group by a.event_id, a.ip, bad"""


def _addresses(t):
    return t.spark.sql(_ADDRESS_SQL.replace("from events", "from {events}"), events=t.events)


query("i2_ip_type", "select event_id, ip, ip_type from typed_addresses")(
    lambda t: enrich.ip_types(_addresses(t), "ip"))

query("i2_network_type", """
select event_id, ip, case when ip_type in ('invalid', 'public') then null else ip_type end as kind from typed_addresses""")(
    lambda t: enrich.network_labels(_addresses(t), "ip", t.spark.createDataFrame(
        [(f"{network}/{bits}", None if kind == "public" else kind) for _, network, bits, kind in dims.IPV4_TYPES],
        "network string, kind string"), "event_id"))

query("i3_ip_location", """
select event_id, ip, case ip_type when 'loopback' then 'Local Machine' when 'private' then 'Local Network'
  else 'Internet' end as location from typed_addresses""")(
    lambda t: enrich.ip_locations(_addresses(t), "ip"))

# --- risk and response ------------------------------------------------------

query("r1_risk_score", """
select seq, risk_score, base_severity, anomaly_score, confidence as classification_confidence,
  5e0 as asset_criticality, 1e0 as user_risk_score from risked""", "risk_score")(
    lambda t: risk.assess_risk(t.detections).select("seq", "risk_score", "factors.*"))

query("r2_severity", f"select seq, {_SEVERITY} as severity from risked")(
    lambda t: risk.assess_risk(t.detections).select("seq", "severity"))

query("r3_action_range", "select seq, action from scored")(
    lambda t: risk.choose_action(risk.assess_risk(t.detections)).select("seq", "action"))

query("r4_approval_routing", "select seq, action, status from scored")(
    lambda t: _scored(t).select("seq", "action", "status"))

query("r4_approval_queue", """
select seq, threat_id, severity, action as recommended_action, status from scored where status = 'pending_approval'""")(
    lambda t: risk.approval_queue(_scored(t)).select(
        "seq", F.format_string("THR-%s-%06d", F.date_format("ts", "yyyyMMdd"), F.col("seq")).alias("threat_id"),
        "severity", F.col("action").alias("recommended_action"), "status"))

query("r5_response_plan", """
select seq, 'success' as status, action, case when action = 'monitor' then true end as monitoring_enabled,
  case when action = 'alert' then true end as alert_sent, case when action = 'alert' then 'email,slack,siem' end as channels,
  case when action = 'isolate' then src_ip end as isolated_ip, case when action = 'isolate' then 'quarantine' end as vlan,
  case when action = 'isolate' then true end as forensics_collected, case when action = 'block' then src_ip end as blocked_ip,
  case when action = 'block' then 'auto_block_001' end as rule_id, case when action = 'block' then true end as firewall_updated
from scored""")(
    lambda t: risk.plan_response(_scored(t)).select(
        "seq", *[F.col(f"result.{c}").alias(c) for c in (
            "status", "action", "monitoring_enabled", "alert_sent", "isolated_ip", "forensics_collected",
            "blocked_ip", "firewall_updated")],
        F.array_join("result.channels", ",").alias("channels"),
        F.col("result.isolation_result.vlan").alias("vlan"), F.col("result.block_result.rule_id").alias("rule_id")))

query("r6_alert_record", """
select seq, ts, threat_class, src_ip as source_ip, dst_ip as destination, severity,
  'Detected ' || threat_class || ' attack from ' || src_ip || ' targeting ' || dst_ip
    || '. Immediate investigation recommended.' as description from scored""")(
    lambda t: risk.alert_record(_scored(t)))

_SENT_SQL = """
select src_ip, ts, seq from (
with recursive a as (select src_ip, ts, seq, row_number() over (partition by src_ip order by ts, seq) as rn
  from scored where severity in ('high', 'critical')),
step as (select a.src_ip, a.rn, min(b.rn) as next_rn from a left join a as b
  on a.src_ip = b.src_ip and b.ts >= a.ts + interval '{seconds} seconds' group by 1, 2),
sent as (select src_ip, rn from a where rn = 1
  union all select s.src_ip, step.next_rn from sent s join step on s.src_ip = step.src_ip and s.rn = step.rn
    where step.next_rn is not null)
select a.src_ip, a.ts, a.seq from sent join a on sent.src_ip = a.src_ip and sent.rn = a.rn) as r"""

query("r7_notify_throttle", _SENT_SQL.replace("{seconds}", "60"))(
    lambda t: throttle.notifications(_scored(t)))

query("r7_notify_throttle_day", _SENT_SQL.replace("{seconds}", "86400"))(
    lambda t: throttle.notifications(_scored(t), seconds=86400))

query("r8_threat_ids", """
select seq, 'THR-' || strftime(ts, '%Y%m%d') || '-' || lpad(cast(row_number() over (
  partition by strftime(ts, '%Y%m%d') order by ts, seq) - 1 as varchar), 6, '0') as threat_id from detections""")(
    lambda t: risk.threat_ids(t.detections.select("seq", "ts")).drop("ts"))

query("r9_detection_summary", """
select count(*) as total_events, count(*) filter (where anomaly_score > 0.7e0) as anomalies_detected,
  count(*) filter (where severity = 'low') as low_count, count(*) filter (where severity = 'medium') as medium_count,
  count(*) filter (where severity = 'high') as high_count, count(*) filter (where severity = 'critical') as critical_count,
  avg(anomaly_score) as avg_anomaly_score, max(risk_score) as max_risk_score, avg(risk_score) as avg_risk_score
from scored""", "avg_anomaly_score max_risk_score avg_risk_score")(
    lambda t: risk.detection_summary(_scored(t).withColumn("is_anomaly", F.col("anomaly_score") > 0.7)))

query("f2_custom_action", """
select seq, case when risk_score >= 90 then 'sinkhole' else action end as action,
  case when risk_score >= 90 then 'dns:' || dst_ip end as sinkhole_target, 'success' as status
from scored""")(
    lambda t: risk.plan_response(
        risk.choose_action(risk.assess_risk(t.detections), [(0, 90.0, 100.0, "sinkhole"), *dims.ACTION_RANGES]),
        {"sinkhole": {"sinkhole_target": F.concat(F.lit("dns:"), F.col("dst_ip"))}},
    ).select("seq", "action", "result.sinkhole_target", "result.status"))

query("p16_history_filter", """
select seq, severity, action from (select * from hist order by seq desc limit 1000) as h where severity = 'high'""")(
    lambda t: history.recent_history(_history(t), 1000, "high").select("seq", "severity", "action"))

query("p16_source_filter", """
select seq, severity, source from hist where source = 'simulation' order by seq desc limit 1000""")(
    lambda t: history.recent_of_source(_history(t), 1000, "simulation").select(
        "seq", "severity", "result.threat_details.source"))

query("p17_alert_filter", """
select seq, severity from scored where severity in ('medium', 'high', 'critical') or risk_score > 30""")(
    lambda t: history.alert_filter(_scored(t)).select("seq", "severity"))

# --- history ----------------------------------------------------------------

_STATS = """count(*) as total_actions, count(*) filter (where risk_score > 80) as high_risk_threats,
  count(*) filter (where action = 'block') as blocked_ips, count(*) filter (where action = 'monitor') as monitored_flows"""

query("q1_stats", f"select {_STATS} from hist")(lambda t: history.stats(_history(t)))
query("q1_stats_of_source", f"select {_STATS} from scored where source = 'realtime'")(
    lambda t: history.stats(_history(t, include_pending=True), "realtime"))

query("q2_top_sources", """
select src_ip as ip, count(*) as count from hist group by 1 order by 2 desc, 1 limit 10""")(
    lambda t: history.top_counts(_history(t), "src_ip", "ip"))
query("q3_top_ports", """
select dst_port as port, count(*) as count from hist group by 1 order by 2 desc, 1 limit 10""")(
    lambda t: history.top_counts(_history(t), "dst_port", "port"))
query("q4_attack_types", "select threat_class, count(*) as count from hist group by 1")(
    lambda t: history.attack_types(_history(t)))
query("q5_severity_dist", """
select count(*) filter (where severity = 'low') as low, count(*) filter (where severity = 'medium') as medium,
  count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'critical') as critical
from hist""")(lambda t: history.severity_distribution(_history(t)))

query("q6_detailed_history", """
select seq, ts as timestamp, threat_id, severity, action, risk_score, src_ip, dst_ip, 'N/A' as src_port, 'N/A' as protocol,
  threat_class, source, 'unknown' as process, cast(dst_port as varchar) as dst_port,
  coalesce(service, 'UNKNOWN') as service, coalesce(service_desc, 'Unknown Service') as service_desc
from hist left join ports on dst_port = port""", "risk_score")(
    lambda t: history.detailed_history(_history(t), None))

query("q7_enhanced_threats", """
select seq, ts as timestamp, cast(hour(ts) as int) as hour, threat_id, severity, action, risk_score, src_ip, dst_ip, dst_port,
  threat_class, source, threat_class = 'zero_day' as is_zero_day, hour(ts) < 9 or hour(ts) >= 17 as is_off_hours,
  isodow(ts) >= 6 as is_weekend, coalesce(service, 'UNKNOWN') as port_service, coalesce(port_risk, 'unknown') as port_risk,
  coalesce(service_desc, 'Unknown Service') as port_desc, 'private' as src_ip_type, 'Local Network' as src_location
from hist left join ports on dst_port = port""", "risk_score")(
    lambda t: history.enhanced_threats(_history(t), None))

query("q8_hourly", """
select cast(h as int) as hour, count(seq) as count from generate_series(0, 23) as s(h)
left join hist on hour(ts) = h group by 1""")(lambda t: history.hourly(_history(t)))
query("q9_daily", "select day, count(seq) as count from day_names left join hist on isodow(ts) - 1 = dow group by 1")(
    lambda t: history.daily(_history(t)))
query("q10_heatmap", """
with c as (select day, cast(h as int) as hour, count(seq) as count from day_names join generate_series(0, 23) as s(h) on true
  left join hist on isodow(ts) - 1 = dow and hour(ts) = h group by 1, 2)
select day, hour, count, case when count = 0 then 0 when count*1e0/m < 2e-1 then 1 when count*1e0/m < 4e-1 then 2
  when count*1e0/m < 6e-1 then 3 when count*1e0/m < 8e-1 then 4 else 5 end as level
from c join (select max(count) as m from c) as top on true""")(lambda t: history.heatmap(_history(t)))
query("q11_severity_by_hour", """
select cast(h as int) as hour, count(*) filter (where severity = 'low') as low, count(*) filter (where severity = 'medium') as medium,
  count(*) filter (where severity = 'high') as high, count(*) filter (where severity = 'critical') as critical
from generate_series(0, 23) as s(h) left join hist on hour(ts) = h group by 1""")(
    lambda t: history.severity_by_hour(_history(t)))
query("q12_time_class", """
select count(*) filter (where hour(ts) < 9 or hour(ts) >= 17) as off_hours_count,
  count(*) filter (where hour(ts) >= 9 and hour(ts) < 17) as business_hours_count,
  count(*) filter (where isodow(ts) >= 6) as weekend_count, count(*) as total_analyzed from hist""")(
    lambda t: history.time_classes(_history(t)))
query("q13_peaks", """
select (select cast(hour(ts) as int) from hist group by hour(ts) order by count(*) desc, hour(ts) limit 1) as peak_hour,
  (select day from hist join day_names on isodow(ts) - 1 = dow group by day, dow order by count(*) desc, dow limit 1) as peak_day""")(
    lambda t: history.peaks(_history(t)))
query("q14_action_counts", """
select count(*) filter (where action = 'monitor') as monitor_count, count(*) filter (where action = 'alert') as alert_count,
  count(*) filter (where action = 'isolate') as isolate_count, count(*) filter (where action = 'block') as block_count
from hist""")(lambda t: history.action_counts(_history(t)))

query("q15_blocklist", """
select src_ip as ip, min_by(ts, seq) as blocked_at, min_by(threat_id, seq) as threat_id, min_by(risk_score, seq) as risk_score
from scored where action = 'block' group by 1""", "risk_score")(
    lambda t: history.blocklist(_history(t, include_pending=True)))
query("q15_blocklist_unblocked", """
select src_ip as ip, min_by(ts, seq) as blocked_at, min_by(threat_id, seq) as threat_id, min_by(risk_score, seq) as risk_score
from scored left join (select src_ip as ip, max(seq) as lifted from scored where action = 'monitor' and seq%5 = 0 group by 1) as u
  on src_ip = u.ip
where action = 'block' and (lifted is null or seq > lifted) group by 1""", "risk_score")(
    lambda t: history.blocklist(
        _history(t, include_pending=True),
        _scored(t).where("action = 'monitor' and seq % 5 = 0").select(F.col("src_ip").alias("ip"), "seq")))

PARTS["chain_rows"] = "select src_ip || '/' || strftime(ts, '%Y-%m-%d') as chain_key, h.* from hist h"
PARTS["chain_list"] = """
select chain_key, count(*) as event_count, min(ts) as first_seen, max(ts) as last_seen, min(seq) as first_seq,
  array_to_string(list_filter([case when bool_or(threat_class = 'port_scan') then 'reconnaissance' end,
    case when bool_or(threat_class = 'brute_force') then 'initial_access' end,
    case when bool_or(threat_class = 'privilege_escalation') then 'privilege_escalation' end,
    case when bool_or(threat_class = 'lateral_movement') then 'lateral_movement' end,
    case when bool_or(threat_class = 'data_exfiltration') then 'exfiltration' end], lambda x: x is not null), ',') as stages,
  count(distinct threat_class) filter (where threat_class in (select k.threat_class from kill_chain k)) as stage_count,
  (epoch_us(max(ts)) - epoch_us(min(ts)))/1e6 as duration_seconds
from chain_rows group by 1"""
_CHAIN_SEVERITY = """case when stage_count >= 4 then 'critical' when stage_count >= 2 then 'high'
  when stage_count >= 1 then 'medium' else 'low' end as severity"""


def _chain_rows(t):
    return chains.chain_input(_history(t), by_day=True)


query("q16_attack_chains", f"""
select chain_key, event_count, first_seen, last_seen, first_seq, stages, cast(stage_count as int) as stage_count,
  duration_seconds, {_CHAIN_SEVERITY} from chain_list""", "duration_seconds")(
    lambda t: chains.attack_chains(_chain_rows(t)).withColumn("stages", F.array_join("stages", ",")))

query("q16_chain_events", """
select chain_key, seq, threat_class, row_number() over (partition by chain_key order by ts, seq) as event_no from chain_rows""")(
    lambda t: chains.chain_events(_chain_rows(t)).select("chain_key", "seq", "threat_class", "event_no"))

_RANK_SQL = """
select l.chain_key, event_count, stages, cast(stage_count as int) as stage_count, duration_seconds, {severity},
  (select string_agg(cast(seq as varchar), ',' order by rn) from (select seq, row_number() over (order by ts, seq) as rn
    from chain_rows c where c.chain_key = l.chain_key) as e where rn <= 10) as events
from ({chains}) as l order by stage_count desc, event_count desc, l.chain_key limit 10"""


def _ranking(t, **options):
    return chains.chain_ranking(_chain_rows(t), **options).select(
        "chain_key", "event_count", F.array_join("stages", ",").alias("stages"), "stage_count", "duration_seconds",
        "severity", F.array_join(F.transform("events", lambda e: e["seq"].cast("string")), ",").alias("events"))


query("q17_chain_ranking", _RANK_SQL.format(severity=_CHAIN_SEVERITY, chains="select * from chain_list"),
      "duration_seconds")(_ranking)
query("q17_chain_ranking_first_seen", _RANK_SQL.format(
    severity=_CHAIN_SEVERITY, chains="select * from chain_list order by first_seq limit 10"), "duration_seconds")(
    lambda t: _ranking(t, pick="first_seen"))

query("q18_risk_trend", """
select seq, ts as timestamp, risk_score from hist order by ts desc, seq desc limit 20""", "risk_score")(
    lambda t: history.risk_trend(_history(t)))

query("q19_duration_label", """
select flow_id, case when s < 60 then cast(cast(floor(s + 5e-1) as bigint) as varchar) || 's'
  when s < 3600 then cast(cast(floor(s/60 + 5e-1) as bigint) as varchar) || 'm'
  else cast(cast(floor(s/3600 + 5e-1) as bigint) as varchar) || 'h' end as duration
from (select flow_id, flow_duration*flow_duration as s from flows) as f""")(
    lambda t: t.flows.select("flow_id", duration_label(F.col("flow_duration") * F.col("flow_duration")).alias("duration")))

query("q20_system_counters", """
select (select count(*) from hist) as total_actions, (select count(*) filter (where action = 'block') from hist) as blocked_count,
  (select count(*) from flows) as events_processed, (select count(distinct connection_id) from flows) as connections_seen,
  (select count(*) from scored) as alerts_generated""")(
    lambda t: history.system_counters(_history(t), t.flows, risk.alert_record(_scored(t))))
