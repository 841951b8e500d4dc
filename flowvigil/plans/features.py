"""Queries of the feature groups: connections, users, time, context, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowvigil.operators import context, network, temporal, user
from flowvigil.plans.registry import PARTS, query

# --- connections ------------------------------------------------------------


def _entropy_sql(source: str, key: str, value: str, name: str) -> str:
    return f"""
with c as (select {key}, {value}, count(*) as n from {source} group by 1, 2),
t as (select {key}, sum(n) as total from c group by 1)
select c.{key}, abs(-sum((n*1e0/total) * ln(n*1e0/total))) as {name}
from c join t on c.{key} = t.{key} group by 1"""


query("n1_flow_totals", """
select connection_id, cast(sum(packets) as bigint) as packet_count, cast(sum(bytes) as bigint) as byte_count,
  sum(flow_duration) as duration from flows group by 1""", "duration:4")(
    lambda t: network.flow_totals(t.flows))

query("n2_flow_rates", """
select connection_id, sum(packets)/(sum(flow_duration)+1e-6) as packets_per_second,
  sum(bytes)/(sum(flow_duration)+1e-6) as bytes_per_second, sum(bytes)/(sum(packets)+1e-6) as avg_packet_size
from flows group by 1""", "packets_per_second:4 bytes_per_second:3 avg_packet_size:4")(
    lambda t: network.flow_rates(t.flows))

query("n3_protocol_entropy", _entropy_sql("flows", "connection_id", "protocol", "protocol_entropy"),
      "protocol_entropy")(lambda t: network.protocol_entropy(t.flows))

query("n4_port_entropy", _entropy_sql("flows", "connection_id", "dst_port", "port_entropy"),
      "port_entropy")(lambda t: network.port_entropy(t.flows))

query("n5_unique_targets", """
select connection_id, count(distinct dst_ip) as unique_dst_ips, count(distinct dst_port) as unique_dst_ports
from flows group by 1""")(lambda t: network.unique_targets(t.flows))

query("n6_size_spread", """
select connection_id, coalesce(var_samp(bytes), 0e0) as packet_size_variance,
  coalesce(stddev_samp(bytes), 0e0) as packet_size_std from flows group by 1""",
      "packet_size_variance:3 packet_size_std:4")(lambda t: network.size_spread(t.flows))

query("n7_flow_asymmetry", """
select connection_id, coalesce(abs(f - b)/(f + b + 1e-6), 0e0) as flow_asymmetry from (
  select connection_id, sum(bytes) filter (where direction = 'forward') as f,
    sum(bytes) filter (where direction = 'backward') as b from flows group by 1) as s""",
      "flow_asymmetry")(lambda t: network.flow_asymmetry(t.flows))

PARTS["connection_entropies"] = """
select p.connection_id, protocol_entropy, port_entropy from
  (select c.connection_id, abs(-sum((n*1e0/total)*ln(n*1e0/total))) as protocol_entropy
   from (select connection_id, protocol, count(*) as n from flows group by 1, 2) as c
   join (select connection_id, count(*) as total from flows group by 1) as t on c.connection_id = t.connection_id group by 1) as p
join
  (select c.connection_id, abs(-sum((n*1e0/total)*ln(n*1e0/total))) as port_entropy
   from (select connection_id, dst_port, count(*) as n from flows group by 1, 2) as c
   join (select connection_id, count(*) as total from flows group by 1) as t on c.connection_id = t.connection_id group by 1) as q
on p.connection_id = q.connection_id"""

PARTS["connection_features"] = """
select b.connection_id, packet_count, byte_count, duration, packet_count/(duration+1e-6) as packets_per_second,
  byte_count/(duration+1e-6) as bytes_per_second, byte_count/(packet_count+1e-6) as avg_packet_size,
  protocol_entropy, port_entropy, unique_dst_ips, unique_dst_ports, packet_size_variance, packet_size_std,
  coalesce(abs(f - b)/(f + b + 1e-6), 0e0) as flow_asymmetry
from (select connection_id, cast(sum(packets) as bigint) as packet_count, cast(sum(bytes) as bigint) as byte_count,
    sum(flow_duration) as duration, count(distinct dst_ip) as unique_dst_ips, count(distinct dst_port) as unique_dst_ports,
    coalesce(var_samp(bytes), 0e0) as packet_size_variance, coalesce(stddev_samp(bytes), 0e0) as packet_size_std,
    sum(bytes) filter (where direction = 'forward') as f, sum(bytes) filter (where direction = 'backward') as b
  from flows group by 1) as b
join connection_entropies e on b.connection_id = e.connection_id"""

_NETWORK_ROUNDS = ("duration:4 packets_per_second:4 bytes_per_second:3 avg_packet_size:4 protocol_entropy "
                   "port_entropy packet_size_variance:3 packet_size_std:4 flow_asymmetry")

query("n8_network_features", "select * from connection_features", _NETWORK_ROUNDS)(
    lambda t: network.network_features(t.flows).drop("flow_count"))

# --- users ------------------------------------------------------------------

_SPAN = "(epoch_us(max(ts)) - epoch_us(min(ts)))/1e6"

query("u1_login_frequency", f"""
select user_id, count(*)/({_SPAN}/3600 + 1) as login_frequency from user_events group by 1""",
      "login_frequency")(lambda t: user.login_frequency(t.user_events))

query("u2_resource_access", """
with c as (select user_id, resource, count(*) as n from user_events group by 1, 2),
s as (select user_id, sum(n) as total from c group by 1)
select c.user_id, count(*) as unique_resources_accessed,
  abs(-sum((n*1e0/total)*ln(n*1e0/total))) as resource_access_entropy
from c join s on c.user_id = s.user_id group by 1""", "resource_access_entropy")(
    lambda t: user.resource_access(t.user_events))

query("u3_data_movement", """
select user_id, sum(data_volume) as total_data_transfer, avg(data_volume) as avg_data_transfer,
  max(data_volume) as max_data_transfer from user_events group by 1""",
      "total_data_transfer:4 avg_data_transfer max_data_transfer")(
    lambda t: user.data_movement(t.user_events))

PARTS["unusual_flags"] = """
select e.event_id, e.user_id, case when m.h is null then 1 else 0 end as unusual_time_access
from user_events e left join (
  select user_id, h from (
    select user_id, hour(ts) as h, rank() over (partition by user_id order by count(*) desc) as rk
    from user_events group by 1, 2) as ranked where rk = 1) as m
on e.user_id = m.user_id and hour(e.ts) = m.h"""

query("u4_unusual_time", "select event_id, user_id, unusual_time_access from unusual_flags")(
    lambda t: user.unusual_time(t.user_events).select("event_id", "user_id", "unusual_time_access"))

query("u4_unusual_time_per_user", """
select user_id, cast(sum(unusual_time_access) as bigint) as unusual_time_access from unusual_flags group by 1""")(
    lambda t: user.unusual_time(t.user_events).groupBy("user_id").agg(
        F.sum("unusual_time_access").alias("unusual_time_access")))

query("u5_location_changes", """
select user_id, count(distinct geolocation) as location_changes from user_events group by 1""")(
    lambda t: user.location_changes(t.user_events))

PARTS["travel_flags"] = """
select event_id, user_id, case when geolocation <> lag(geolocation) over w
  and (epoch_us(ts) - epoch_us(lag(ts) over w))/1e6 < 3600 then 1 else 0 end as impossible_travel
from user_events window w as (partition by user_id order by ts, event_id)"""

query("u6_impossible_travel", "select * from travel_flags")(
    lambda t: user.impossible_travel(t.user_events).select("event_id", "user_id", "impossible_travel"))

query("u7_device_consistency", """
select user_id, count(*) as unique_devices, max(n)*1e0/sum(n) as device_consistency
from (select user_id, device_id, count(*) as n from user_events group by 1, 2) as c group by 1""",
      "device_consistency")(lambda t: user.device_consistency(t.user_events))

PARTS["user_profile"] = f"""
select a.user_id, login_frequency, unique_resources_accessed, resource_access_entropy, total_data_transfer,
  avg_data_transfer, max_data_transfer, unusual_time_access, location_changes, impossible_travel
from (select user_id, count(*)/({_SPAN}/3600 + 1) as login_frequency, sum(data_volume) as total_data_transfer,
    avg(data_volume) as avg_data_transfer, max(data_volume) as max_data_transfer,
    count(distinct geolocation) as location_changes from user_events group by 1) as a
join (select c.user_id, count(*) as unique_resources_accessed,
    abs(-sum((n*1e0/total)*ln(n*1e0/total))) as resource_access_entropy
  from (select user_id, resource, count(*) as n from user_events group by 1, 2) as c
  join (select user_id, count(*) as total from user_events group by 1) as s on c.user_id = s.user_id group by 1) as r
  on a.user_id = r.user_id
join (select user_id, cast(sum(unusual_time_access) as bigint) as unusual_time_access from unusual_flags group by 1) as q
  on a.user_id = q.user_id
join (select user_id, cast(sum(impossible_travel) as bigint) as impossible_travel from travel_flags group by 1) as v
  on a.user_id = v.user_id"""

_USER_ROUNDS = ("login_frequency resource_access_entropy total_data_transfer:4 avg_data_transfer max_data_transfer")

query("u8_user_features", "select * from user_profile", _USER_ROUNDS)(
    lambda t: user.user_features(t.user_events).drop("event_count"))

# --- time -------------------------------------------------------------------

_PARTS_SQL = """cast(hour(ts) as int) as hour_of_day, cast(isodow(ts) - 1 as int) as day_of_week,
  cast(day(ts) as int) as day_of_month"""
_FLAGS_SQL = """case when isodow(ts) >= 6 then 1 else 0 end as is_weekend,
  case when hour(ts) between 9 and 17 then 1 else 0 end as is_business_hours"""
_CYCLE_SQL = """sin(2*pi()*hour(ts)/24) as hour_sin, cos(2*pi()*hour(ts)/24) as hour_cos,
  sin(2*pi()*(isodow(ts)-1)/7) as day_sin, cos(2*pi()*(isodow(ts)-1)/7) as day_cos"""
_CYCLE = "hour_sin hour_cos day_sin day_cos"

query("t1_time_parts", f"select event_id, {_PARTS_SQL} from user_events")(
    lambda t: temporal.time_parts(t.user_events.select("event_id", "ts")).drop("ts"))

query("t2_time_flags", f"select event_id, {_FLAGS_SQL} from user_events")(
    lambda t: temporal.time_flags(t.user_events.select("event_id", "ts")).drop("ts"))

query("t3_cyclic_encoding", f"select event_id, {_CYCLE_SQL} from user_events", _CYCLE)(
    lambda t: temporal.cyclic_encoding(t.user_events.select("event_id", "ts")).drop("ts"))

PARTS["event_rhythm"] = """
select event_id, coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)))/1e6, 0e0)
    as time_since_last_event,
  count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as events_last_hour,
  count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) as events_last_day
from user_events"""

query("t4_since_last_event", "select event_id, time_since_last_event from event_rhythm",
      "time_since_last_event")(
    lambda t: temporal.since_last_event(t.user_events.select("event_id", "user_id", "ts")).select(
        "event_id", "time_since_last_event"))

query("t5_trailing_counts", "select event_id, events_last_hour, events_last_day from event_rhythm")(
    lambda t: temporal.recent_event_counts(t.user_events.select("event_id", "user_id", "ts")).select(
        "event_id", "events_last_hour", "events_last_day"))

query("t6_temporal_features", f"""
select e.event_id, {_PARTS_SQL}, {_FLAGS_SQL}, {_CYCLE_SQL},
  time_since_last_event, events_last_hour, events_last_day
from user_events e join event_rhythm r on e.event_id = r.event_id""", _CYCLE + " time_since_last_event")(
    lambda t: temporal.temporal_features(t.user_events.select("event_id", "user_id", "ts")).drop("user_id", "ts"))

query("t7_counter_deltas", """
select host, scan_id, bytes_delta, packets_delta, greatest(64, bytes_delta) as est_bytes,
  greatest(1, packets_delta) as est_packets from (
  select host, scan_id, coalesce(bytes_sent - lag(bytes_sent) over w, 1000) as bytes_delta,
    coalesce(packets_sent - lag(packets_sent) over w, 10) as packets_delta
  from counters window w as (partition by host order by scan_id)) as d""")(
    lambda t: temporal.counter_deltas(t.counters).select(
        "host", "scan_id", "bytes_delta", "packets_delta", "est_bytes", "est_packets"))

query("t8_recent_ring", """
select source, seq, ts, recent_no from (
  select source, seq, ts, row_number() over (partition by source order by ts desc, seq desc) as recent_no
  from detections) as r where recent_no <= 1000""")(
    lambda t: temporal.latest_per_key(t.detections.select("source", "seq", "ts"), "source", ["ts", "seq"], 1000)
    .withColumn("recent_no", F.col("recent_no").cast("bigint")))

query("t9_sequence_windows", """
select user_id, event_id, array_to_string([cast(x as varchar) for x in seq], ',') as sequence, target from (
  select user_id, event_id, bytes as target,
    list(bytes) over (partition by user_id order by ts, event_id rows between 50 preceding and 1 preceding) as seq
  from (select user_id, flow_id as event_id, ts, bytes from flows) as f) as w
where len(seq) = 50""")(
    lambda t: temporal.sequences(t.flows.withColumnRenamed("flow_id", "event_id"), "user_id",
                                 ["ts", "event_id"], ["bytes"]).select(
        "user_id", "event_id",
        F.concat_ws(",", F.transform(F.flatten("sequence"), lambda x: x.cast("bigint").cast("string"))).alias("sequence"),
        F.element_at("target", 1).cast("bigint").alias("target")))

# --- context, assembly, scaling ---------------------------------------------

query("c1_geo_dept_codes", """
select event_id, geolocation, department, geo_encoded, department_encoded from user_events
join (select geolocation as g, cast(row_number() over (order by geolocation) - 1 as int) as geo_encoded
  from (select distinct geolocation from user_events) as a) as gc on geolocation = g
join (select department as d, cast(row_number() over (order by department) - 1 as int) as department_encoded
  from (select distinct department from user_events) as b) as dc on department = d""")(
    lambda t: context.geo_department_codes(t.user_events.select("event_id", "geolocation", "department")))

query("c2_asset_criticality", """
select event_id, u.asset_id, coalesce(score, 0e0) as asset_criticality
from user_events u left join asset_scores s on u.asset_id = s.asset_id""")(
    lambda t: context.asset_criticality(t.user_events.select("event_id", "asset_id")))

_A1_COLUMNS = "packet_count, byte_count, duration, packets_per_second, bytes_per_second, avg_packet_size, " \
    "protocol_entropy, port_entropy, unique_dst_ips, unique_dst_ports, packet_size_variance, packet_size_std, " \
    "flow_asymmetry, login_frequency, unique_resources_accessed, resource_access_entropy, total_data_transfer, " \
    "avg_data_transfer, max_data_transfer, unusual_time_access, location_changes, impossible_travel"

query("a1_feature_join", f"""
select f.flow_id, f.user_id, f.connection_id, {_PARTS_SQL}, {_FLAGS_SQL}, {_CYCLE_SQL},
  time_since_last_event, events_last_hour, events_last_day, {_A1_COLUMNS}
from flows f join event_rhythm r on f.flow_id = r.event_id
left join connection_features c on f.connection_id = c.connection_id
left join user_profile u on f.user_id = u.user_id""",
      f"{_CYCLE} time_since_last_event {_NETWORK_ROUNDS} {_USER_ROUNDS}")(
    lambda t: context.assemble_features(t.flows, t.user_events, groups=("network", "user", "temporal"), custom=()).drop("ts"))


@query("a1_feature_join_all", f"""
select f.flow_id, f.user_id, f.connection_id, {_PARTS_SQL}, {_FLAGS_SQL}, {_CYCLE_SQL},
  time_since_last_event, events_last_hour, events_last_day, {_A1_COLUMNS},
  geo_encoded, department_encoded, asset_criticality, unique_devices, device_consistency, mean_packets
from flows f join event_rhythm r on f.flow_id = r.event_id
left join connection_features c on f.connection_id = c.connection_id
left join user_profile u on f.user_id = u.user_id
left join (select event_id as coded_id, geo_encoded, department_encoded, coalesce(score, 0e0) as asset_criticality from user_events
  join (select g, cast(row_number() over (order by g) - 1 as int) as geo_encoded
    from (select distinct geolocation as g from user_events) as a) as gc on geolocation = g
  join (select d, cast(row_number() over (order by d) - 1 as int) as department_encoded
    from (select distinct department as d from user_events) as b) as dc on department = d
  left join asset_scores s on user_events.asset_id = s.asset_id) as x on f.flow_id = coded_id
left join (select user_id as device_user, count(*) as unique_devices, max(n)*1e0/sum(n) as device_consistency
  from (select user_id, device_id, count(*) as n from user_events group by 1, 2) as dc group by 1) as dv on f.user_id = device_user
left join (select connection_id as own_connection, avg(packets) as mean_packets from flows group by 1) as p
  on f.connection_id = own_connection""",
       f"{_CYCLE} time_since_last_event {_NETWORK_ROUNDS} {_USER_ROUNDS} device_consistency mean_packets")
def _all_groups(t):
    """Every group of the library and a registered one."""
    context.register_feature("mean_packets", lambda flows: flows.groupBy("connection_id").agg(
        F.avg("packets").alias("mean_packets")), "connection_id")
    try:
        return context.assemble_features(t.flows, t.user_events, custom=["mean_packets"]).drop("ts")
    finally:
        context.unregister_feature("mean_packets")


@query("a2_standard_scale", """
select flow_id, (packets - mp)/sp as packets, (bytes - mb)/sb as bytes, (flow_duration - md)/sd as flow_duration,
  0e0 as constant_column
from flows join (select avg(packets) as mp, stddev_pop(packets) as sp, avg(bytes) as mb, stddev_pop(bytes) as sb,
  avg(flow_duration) as md, stddev_pop(flow_duration) as sd from flows) as s on true""",
       "packets bytes flow_duration constant_column")
def _standard_scale(t):
    flows = t.flows.select("flow_id", "packets", "bytes", "flow_duration", F.lit(3.0).alias("constant_column"))
    columns = ["packets", "bytes", "flow_duration", "constant_column"]
    return context.apply_scaler(flows, context.fit_scaler(flows, columns))


@query("f1_custom_feature", """
select flow_id, packets_per_byte from flows f join (
  select connection_id as c, sum(packets)/(sum(bytes)+1e-6) as packets_per_byte from flows group by 1) as p
on f.connection_id = p.c""", "packets_per_byte")
def _custom_feature(t):
    def packets_per_byte(flows):
        return flows.groupBy("connection_id").agg(
            (F.sum("packets") / (F.sum("bytes") + 1e-6)).alias("packets_per_byte"))
    context.register_feature("packets_per_byte", packets_per_byte, "connection_id")
    flows = t.flows.withColumnRenamed("flow_id", "event_id")
    out = context.custom_features(flows, ["packets_per_byte"])
    return out.select(F.col("event_id").alias("flow_id"), "packets_per_byte")
