"""Attack signatures as rules over flows. Thresholds are parameters.

Grouped rules count distinct values with the value in the shuffle key, so one target
or source that holds most flows is combined map-side and spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.functions.ip import ip_type
from flowvigil.functions.stats import ratio


def _windowed(df: DataFrame, keys: Sequence[str], window: str):
    return df.groupBy(*keys, F.window("ts", window).alias("w"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("w.start")).drop("w")


def port_scan(flows: DataFrame, window: str = "5 minutes", min_ports: int = 20, max_packets: int = 3,
              max_bytes: int = 200) -> DataFrame:
    """One source probes many ports of one target with tiny flows."""
    tiny = flows.where((F.col("packets") <= max_packets) & (F.col("bytes") <= max_bytes))
    found = _windowed(tiny, ["src_ip", "dst_ip"], window).agg(
        F.count_distinct("dst_port").alias("ports"))
    return _flat(found.where(F.col("ports") >= min_ports))


def brute_force(flows: DataFrame, window: str = "5 minutes", min_flows: int = 20,
                ports: Sequence[int] = tuple(dims.BRUTE_FORCE_PORTS)) -> DataFrame:
    """Many flows of one source to login ports."""
    found = _windowed(flows.where(F.col("dst_port").isin(*ports)), ["src_ip"], window).agg(
        F.count("*").alias("attempts"), F.count_distinct("dst_port").alias("ports"))
    return _flat(found.where(F.col("attempts") >= min_flows))


def ddos(flows: DataFrame, window: str = "5 minutes", min_sources: int = 50,
         min_bytes_per_second: float = 1e7) -> DataFrame:
    """Many sources flood one target."""
    found = _windowed(flows, ["dst_ip"], window).agg(
        F.count_distinct("src_ip").alias("sources"),
        ratio(F.sum("bytes"), F.sum("flow_duration")).alias("bytes_per_second"))
    return _flat(found.where((F.col("sources") >= min_sources)
                             & (F.col("bytes_per_second") >= min_bytes_per_second)))


def exfiltration(flows: DataFrame, min_bytes: int = 500_000_000, min_seconds: float = 30.0) -> DataFrame:
    """A private source sends much data to public addresses, for long."""
    outward = flows.where((ip_type("src_ip") == "private") & (ip_type("dst_ip") == "public"))
    sent = outward.groupBy("src_ip").agg(
        F.sum("bytes").alias("bytes_out"), F.sum("flow_duration").alias("seconds"), F.count("*").alias("flows"))
    return sent.where((F.col("bytes_out") >= min_bytes) & (F.col("seconds") >= min_seconds))


def c2_ports(flows: DataFrame, ports: Sequence[int] = tuple(dims.C2_PORTS)) -> DataFrame:
    """An internal host talks to a command-and-control port."""
    return flows.where(F.col("dst_port").isin(*ports) & (ip_type("src_ip") == "private"))


def exploit_burst(flows: DataFrame, max_seconds: float = 0.1, min_bytes: int = 50_000_000,
                  ports: Sequence[int] = tuple(dims.EXPLOIT_PORTS)) -> DataFrame:
    """A huge payload in a very short flow to an exploit-prone port."""
    return flows.where(F.col("dst_port").isin(*ports) & (F.col("flow_duration") <= max_seconds)
                       & (F.col("bytes") >= min_bytes))
