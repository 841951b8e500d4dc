"""Security views over the event table, in one text for Spark and for the SQL check.

Tokens: ``{k}`` is the number in the JSON properties, ``{at}`` the 1-based list
look-up, ``{a}`` ... ``{z}`` enclose a list literal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.operators import skew

VIEWS: dict[str, str] = {}

VIEWS["flows"] = """
select event_id as flow_id, ts, user_id, user_id*8 + event_id%8 as connection_id,
  concat(case when user_id%5=0 then '203.0.113.' when user_id%5=1 then '8.8.4.' else '192.168.1.' end, cast(user_id%250+1 as varchar(10))) as src_ip,
  concat(case when {k}%6=0 then '93.184.216.' else concat('10.0.', cast({k}%4 as varchar(10)), '.') end, cast({k}%16+1 as varchar(10))) as dst_ip,
  cast(1024 + event_id%50000 as int) as src_port,
  {at}({a}80,443,22,53,3389,3306,8080,4444,445,12345{z}, cast({k}%10+1 as int)) as dst_port,
  cast(case when event_id%10<7 then 6 when event_id%10<9 then 17 else 1 end as int) as protocol,
  1 + {k} as packets, cast(floor(value*100) as bigint) as bytes, value/1e1 as flow_duration,
  case when event_type in ('click','view') then 'forward' else 'backward' end as direction,
  case when event_type = 'error' then 1 else 0 end as label
from events
"""

VIEWS["user_events"] = """
select event_id, ts, user_id, concat('res_', cast({k}%20 as varchar(10))) as resource, value as data_volume,
  {at}({a}'US','DE','FR','JP','BR'{z}, cast(event_id%5+1 as int)) as geolocation,
  concat('dev_', cast(user_id%7 as varchar(10)), '_', cast({k}%3 as varchar(10))) as device_id,
  {at}({a}'eng','fin','hr','ops'{z}, cast(user_id%4+1 as int)) as department,
  {at}({a}'database_server','file_server','web_server','workstation','iot_device','printer'{z}, cast({k}%6+1 as int)) as asset_id,
  {at}({a}'dmz','internal','critical'{z}, cast(event_id%3+1 as int)) as zone
from events
"""

VIEWS["detections"] = """
select event_id as seq, ts, user_id,
  concat('192.168.1.', cast(user_id%250+1 as varchar(10))) as src_ip,
  concat('10.0.0.', cast(event_id%16+1 as varchar(10))) as dst_ip,
  {at}({a}80,443,22,53,3389,3306,8080,4444,445,12345{z}, cast({k}%10+1 as int)) as dst_port,
  least(value/200e0, 1e0) as anomaly_score, {k}/100e0 as confidence,
  {at}({a}'normal','dos','ddos','port_scan','brute_force','sql_injection','xss','malware','data_exfiltration','lateral_movement','privilege_escalation','ransomware','phishing','botnet','zero_day'{z}, cast(event_id%15+1 as int)) as threat_class,
  case when event_id%2=0 then 'simulation' else 'realtime' end as source
from events
"""

VIEWS["dirty"] = """
select event_id, case when event_id%7=0 then null else value end as flow_duration,
  case when event_id%11=0 then cast('Infinity' as double) else value*2e0 end as byte_rate,
  case when event_id%13=0 or event_id%97=0 then null else event_type end as proto,
  case when event_id%3=0 then 'BENIGN' when event_id%3=1 then ' benign ' else 'DDoS' end as label
from events
union all
select event_id, case when event_id%7=0 then null else value end,
  case when event_id%11=0 then cast('Infinity' as double) else value*2e0 end,
  case when event_id%13=0 or event_id%97=0 then null else event_type end,
  case when event_id%3=0 then 'BENIGN' when event_id%3=1 then ' benign ' else 'DDoS' end
from events where event_id%40=0
"""

VIEWS["predictions"] = """
select event_id, case when event_type='error' then 1 else 0 end as y_true, case when value > 50 then 1 else 0 end as y_pred,
  event_type as actual, {at}({a}'click','error','purchase','signup','view'{z}, cast({k}%5+1 as int)) as predicted,
  {at}({a}'iforest','kmeans','pca'{z}, cast(event_id%3+1 as int)) as model
from events
"""

VIEWS["kdd_raw"] = """
select event_id, {at}({a}'tcp','udp','icmp','other'{z}, cast({k}%4+1 as int)) as protocol_type, value as duration,
  {k}*10 as src_bytes, event_id%500 as dst_bytes, event_id%100 as count, case when event_type='error' then 'neptune' else 'normal' end as class
from events
"""

# The check's dialect takes the running sums as a window; Spark takes them from
# skew.scan_in_order, because a host is one of only eight keys.
VIEWS["counters"] = """
select user_id%8 as host, event_id as scan_id, ts,
  cast(sum(cast(floor(value*100) as bigint)) over (partition by user_id%8 order by event_id) as bigint) as bytes_sent,
  cast(sum({k}) over (partition by user_id%8 order by event_id) as bigint) as packets_sent
from events
"""

_DUCK = {"{k}": "cast(json_extract_string(props, '$.k') as bigint)", "{at}": "list_extract",
         "{a}": "[", "{z}": "]"}
_SPARK = {"{k}": "k", "{at}": "element_at", "{a}": "array(", "{z}": ")"}


def _fill(text: str, tokens: dict[str, str]) -> str:
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def duck_sql(name: str) -> str:
    return _fill(VIEWS[name], _DUCK).strip()


def needed_views(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


class Tables:
    """The driver tables of one folder and the security views on top of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def view(self, name: str) -> DataFrame:
        return view_over(self.events, name)

    flows = property(lambda self: self.view("flows"))
    user_events = property(lambda self: self.view("user_events"))
    detections = property(lambda self: self.view("detections"))
    dirty = property(lambda self: self.view("dirty"))
    predictions = property(lambda self: self.view("predictions"))
    kdd_raw = property(lambda self: self.view("kdd_raw"))

    @property
    def counters(self) -> DataFrame:
        raw = self.events.select(
            (F.col("user_id") % 8).alias("host"), F.col("event_id").alias("scan_id"), "ts",
            F.floor(F.col("value") * 100).cast("bigint").alias("sent"), _k().alias("packets"))
        return skew.scan_in_order(
            raw, "host", ["scan_id"],
            sums={"bytes_sent": F.col("sent"), "packets_sent": F.col("packets")},
        ).select("host", "scan_id", "ts", "bytes_sent", "packets_sent")


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def view_over(events: DataFrame, name: str) -> DataFrame:
    """One view over any event table, batch or streaming."""
    text = _fill(VIEWS[name], _SPARK).replace("from events", "from {events}")
    return events.sparkSession.sql(text, events=events.withColumn("k", _k()))
