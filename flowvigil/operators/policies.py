"""Alert correlation, baselines, zones, retention, anonymising, drift, versions, maintenance, indicators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.functions.timeparts import seconds_between
from flowvigil.operators.skew import AUTO, attach_by_key, find_hot, scan_in_order
from flowvigil.sources.files import at_literal, newest_time

ANOMALY_THRESHOLD = 0.8  # fixed value


def correlate_alerts(alerts: DataFrame, key: str = "src_ip", seconds: int = 300, min_events: int = 2,
                     hot=AUTO) -> DataFrame:
    """Incidents: runs of alerts of one source with gaps of at most ``seconds``."""
    rows = alerts.select(key, "ts", "seq", "risk_score")
    if isinstance(hot, str):
        hot = find_hot(rows, [key], "ts")
    gaps = scan_in_order(rows, key, ["ts", "seq"], lags={"_before": "ts"}, hot=hot)
    starts = F.when(F.col("_before").isNull() | (seconds_between(F.col("_before"), F.col("ts")) > seconds), 1).otherwise(0)
    runs = scan_in_order(gaps.withColumn("_start", starts), key, ["ts", "seq"],
                         sums={"incident_no": F.col("_start")}, hot=hot)
    return runs.groupBy(key, "incident_no").agg(
        F.count("*").alias("alerts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max("risk_score").alias("max_risk_score")).where(F.col("alerts") >= min_events)


def rolling_baseline(df: DataFrame, entity: str, value: str, days: int = 28, min_samples: int = 10_000,
                     as_of: datetime | None = None) -> DataFrame:
    """Mean and deviation per entity over the last ``days``; entities with few samples are left out."""
    as_of = newest_time(df, "ts") if as_of is None else as_of
    recent = df.where(F.col("ts") > at_literal(as_of, df.schema["ts"].dataType) - F.expr(f"interval {days} days"))
    return recent.groupBy(entity).agg(
        F.count(value).alias("samples"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    ).where(F.col("samples") >= min_samples)


def zone_flags(df: DataFrame, score: str, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Anomaly flag against the threshold of the row's zone; a zone not listed counts as 1.0."""
    table = F.broadcast(dims.zones(df.sparkSession))  # three fixed rows
    joined = df.join(table, "zone", "left")
    limit = F.lit(threshold) * F.coalesce("multiplier", F.lit(1.0))
    return joined.withColumn("threshold", limit).withColumn(
        "is_anomaly", F.col(score) > F.col("threshold")).drop("multiplier")


def retain(df: DataFrame, at: str = "ts", days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Rows of the last ``days`` days; on a date-partitioned table this prunes partitions."""
    as_of = newest_time(df, at) if as_of is None else as_of
    oldest = F.date_sub(at_literal(as_of, df.schema[at].dataType).cast("date"), days)
    return df.where(F.col(at) >= oldest.cast(df.schema[at].dataType))


def hashed(column: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), column.cast("string")), 256)


def masked_ip(ip: Column) -> Column:
    """The last octet set to 0."""
    return F.regexp_replace(ip, r"\.[0-9]+$", ".0")


def anonymise(df: DataFrame, hash_columns: Sequence[str] = (), mask_columns: Sequence[str] = (),
              salt: str = "") -> DataFrame:
    return df.withColumns({**{c: hashed(F.col(c), salt) for c in hash_columns},
                           **{c: masked_ip(F.col(c)) for c in mask_columns}})


def population_shift(df: DataFrame, column: str, edges: Sequence[float], is_current: Column,
                     threshold: float = 0.15) -> DataFrame:
    """Stability index of ``column`` between reference and current rows over fixed bins."""
    bins = F.lit(0)
    for edge in edges:
        bins = bins + F.when(F.col(column) >= edge, 1).otherwise(0)
    counts = df.select(bins.alias("bin"), is_current.alias("cur")).groupBy("bin").agg(
        F.count_if(F.col("cur")).alias("c"), F.count_if(~F.col("cur")).alias("r"))
    whole = Window.partitionBy()  # len(edges) + 1 rows at most
    p = F.greatest(F.col("c") / F.sum("c").over(whole), F.lit(1e-6))
    q = F.greatest(F.col("r") / F.sum("r").over(whole), F.lit(1e-6))
    shares = counts.select(((p - q) * F.ln(p / q)).alias("part"))
    return shares.agg(F.sum("part").alias("shift")).withColumn("drifted", F.col("shift") > threshold)


def score_drop(metrics: DataFrame, by: str, period: str, before, after, threshold: float = 0.1) -> DataFrame:
    """F1 of two periods per ``by`` and whether it fell by more than ``threshold``."""
    pivoted = metrics.groupBy(by).agg(
        F.max(F.when(F.col(period) == before, F.col("f1_score"))).alias("f1_before"),
        F.max(F.when(F.col(period) == after, F.col("f1_score"))).alias("f1_after"))
    return pivoted.withColumn("degraded", F.col("f1_before") - F.col("f1_after") > threshold)


def compare_versions(metrics: DataFrame, keep: int = 10) -> DataFrame:
    """The newest ``keep`` versions per suite, each with its change from the version before."""
    by_suite = Window.partitionBy("suite")
    ordered = by_suite.orderBy("version")
    newest = by_suite.orderBy(F.col("version").desc())
    return metrics.withColumns({
        "accuracy_change": F.col("accuracy") - F.lag("accuracy").over(ordered),
        "f1_change": F.col("f1_score") - F.lag("f1_score").over(ordered),
        "age": F.row_number().over(newest)}).where(F.col("age") <= keep)


# Each level of maintenance buckets is so many times wider than the one before it.
WIDER, LEVELS = 1024, 3


def suppress_in_maintenance(alerts: DataFrame, windows: DataFrame, host: str = "dst_ip",
                            min_confidence: float = 0.75, bucket_seconds: int = 3600) -> DataFrame:
    """Alerts that are confident enough and outside every maintenance window of their host.

    ``windows`` has (host, start, end), both ends included; a null end is still open, and a
    window without a start, or with its end before its start, suppresses nothing. Both sides are
    keyed by host and time bucket. A window takes buckets of ``bucket_seconds`` at its edges
    only; whole buckets inside it are ``WIDER`` times as long on each further level, so a window
    has at most a few thousand rows however long it lasts. An alert looks once per level.
    """
    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000)).cast("bigint")

    last = F.lit("9999-12-31 23:59:59.999999").cast(alerts.schema["ts"].dataType)
    spans = windows.select(F.col(host).alias("_host"), F.col("start").alias("_start"), F.coalesce("end", last).alias("_end")).where(
        F.col("_start") <= F.col("_end"))
    spans = spans.withColumns({"_from": bucket(F.col("_start")), "_to": bucket(F.col("_end"))})
    kept = alerts.where(F.col("confidence") >= min_confidence)
    for level in range(LEVELS):
        low, high = F.col("_from"), F.col("_to")
        first, final = F.floor(low / WIDER).cast("bigint") + 1, F.floor(high / WIDER).cast("bigint") - 1
        long = (first <= final) & F.lit(level < LEVELS - 1)
        own = F.when(long, F.concat(F.sequence(low, first * WIDER - 1), F.sequence((final + 1) * WIDER, high))).otherwise(F.sequence(low, high))
        marks = spans.select("_host", "_start", "_end", F.explode(own).alias("_bucket"))
        at = F.floor(bucket(F.col("ts")) / (WIDER ** level)).cast("bigint")
        kept = kept.join(marks, (F.col(host) == F.col("_host")) & (at == F.col("_bucket"))
                         & F.col("ts").between(F.col("_start"), F.col("_end")), "left_anti")
        spans = spans.where(long).withColumns({"_from": first, "_to": final})
    return kept


INDICATOR_LEVELS = ("low", "medium", "high", "critical")


def match_indicators(flows: DataFrame, feed: DataFrame, row_id: str = "flow_id") -> DataFrame:
    """Flows whose source or destination is a listed indicator, with the listed level.

    ``feed`` has (ip, level) rows; of several for one address the worst level counts. It has
    no known size, so the planner chooses the join on measured sizes; hot addresses are spread.
    """
    rank = F.array_position(F.array(*map(F.lit, INDICATOR_LEVELS)), F.col("level"))
    feed = feed.groupBy("ip").agg(F.max_by("level", F.struct(rank, "level")).alias("level"))
    out = flows
    for side in ("src", "dst"):
        listed = feed.select(F.col("ip").alias(f"{side}_ip"), F.col("level").alias(f"{side}_level"))
        out = attach_by_key(out, listed, f"{side}_ip", row_id)
    return out.where(F.col("src_level").isNotNull() | F.col("dst_level").isNotNull())
