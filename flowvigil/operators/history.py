"""Reports over the action history (the audit log with nested ``result.threat_details``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.functions.ip import ip_location, ip_type
from flowvigil.functions.timeparts import hour_of, is_off_hours, is_weekend, weekday_of
from flowvigil.operators.enrich import port_service
from flowvigil.operators.skew import AUTO, attach_by_key

DETAILS = "result.threat_details"


def detail(name: str) -> Column:
    return F.col(f"{DETAILS}.{name}")


def newest(history: DataFrame, limit: int | None) -> DataFrame:
    """The last ``limit`` entries; everything when None."""
    return history if limit is None else history.orderBy(F.col("seq").desc()).limit(limit)


def of_source(history: DataFrame, source: str | None) -> DataFrame:
    return history if source is None else history.where(detail("source") == source)


def recent_history(history: DataFrame, limit: int | None = None, severity: str | None = None) -> DataFrame:
    """The last ``limit`` entries, and only then those of one severity."""
    out = newest(history, limit)
    return out if severity is None else out.where(F.col("severity") == severity)


def recent_of_source(history: DataFrame, limit: int | None, source: str | None) -> DataFrame:
    """The last ``limit`` entries of one source (the filter comes first)."""
    return newest(of_source(history, source), limit)


def stats(history: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    return of_source(newest(history, limit), source).agg(
        F.count("*").alias("total_actions"), F.count_if(F.col("risk_score") > 80).alias("high_risk_threats"),
        F.count_if(F.col("action") == "block").alias("blocked_ips"),
        F.count_if(F.col("action") == "monitor").alias("monitored_flows"))


def top_counts(history: DataFrame, field: str, name: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of a detail field; ties by value. Null, 0 and '' are skipped."""
    values = history.select(detail(field).alias(name))
    kind = values.schema[name].dataType.typeName()
    wanted = F.col(name).isNotNull() & (F.col(name) != (F.lit("") if kind == "string" else F.lit(0)))
    return values.where(wanted).groupBy(name).agg(F.count("*").alias("count")).orderBy(
        F.col("count").desc(), name).limit(k)


def attack_types(history: DataFrame) -> DataFrame:
    return history.select(detail("threat_class").alias("threat_class")).where(
        F.col("threat_class").isNotNull() & (F.col("threat_class") != "")).groupBy("threat_class").agg(
        F.count("*").alias("count"))


def severity_distribution(history: DataFrame) -> DataFrame:
    return history.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])


def _text_detail(history: DataFrame, name: str, default: str) -> Column:
    known = name in history.schema["result"].dataType["threat_details"].dataType.names
    value = detail(name).cast("string") if known else F.lit(None).cast("string")
    return F.coalesce(value, F.lit(default)).alias(name)


def detailed_history(history: DataFrame, limit: int | None = None, source: str | None = None) -> DataFrame:
    """Flat history rows with the service of the destination port."""
    rows = recent_of_source(history, limit, source)
    flat = rows.select(
        "seq", "timestamp", "threat_id", "severity", "action", "risk_score",
        *[_text_detail(rows, n, "N/A") for n in ("src_ip", "dst_ip", "src_port", "protocol")],
        *[_text_detail(rows, n, "unknown") for n in ("threat_class", "source", "process")],
        detail("dst_port").alias("_port"))
    named = port_service(flat, "_port")
    have = F.col("_port").isNotNull()
    return named.withColumns({
        "dst_port": F.coalesce(F.col("_port").cast("string"), F.lit("N/A")),
        "service": F.when(have, F.col("service")).otherwise(""),
        "service_desc": F.when(have, F.col("service_desc")).otherwise("")}).drop("_port", "port_risk")


def enhanced_threats(history: DataFrame, limit: int | None = None, source: str | None = None) -> DataFrame:
    """History rows with zero-day, off-hours, weekend, port risk and source address type."""
    rows = recent_of_source(history, limit, source)
    flat = rows.select(
        "seq", "timestamp", hour_of("timestamp").alias("hour"), "threat_id", "severity", "action", "risk_score",
        detail("src_ip").alias("src_ip"), detail("dst_ip").alias("dst_ip"), detail("dst_port").alias("dst_port"),
        detail("threat_class").alias("threat_class"), _text_detail(rows, "source", "unknown"),
        (detail("threat_class") == "zero_day").alias("is_zero_day"),
        is_off_hours("timestamp").alias("is_off_hours"), is_weekend("timestamp").alias("is_weekend"))
    named = port_service(flat).withColumnsRenamed({"service": "port_service", "service_desc": "port_desc"})
    kind = F.when(F.col("src_ip").isNull(), "unknown").otherwise(ip_type("src_ip"))
    return named.withColumn("src_ip_type", kind).withColumn(
        "src_location", F.when(F.col("src_ip").isNull(), "").otherwise(ip_location(F.col("src_ip_type"))))


# --- time-of-day reports: counts on a fixed grid, so empty cells show as 0 ---

def _grid(history: DataFrame) -> DataFrame:
    """(dow, hour, n): at most 168 rows; all calendar reports start from it."""
    return history.groupBy(weekday_of("timestamp").alias("dow"), hour_of("timestamp").alias("hour")).agg(
        F.count("*").alias("n"))


def _hours(history: DataFrame) -> DataFrame:
    return history.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))


def _days(history: DataFrame) -> DataFrame:
    return history.sparkSession.createDataFrame(list(enumerate(dims.DAY_NAMES)), "dow int, day string")


def hourly(history: DataFrame) -> DataFrame:
    counts = _grid(history).groupBy("hour").agg(F.sum("n").alias("n"))
    return _hours(history).join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("count"))


def daily(history: DataFrame) -> DataFrame:
    counts = _grid(history).groupBy("dow").agg(F.sum("n").alias("n"))
    return _days(history).join(counts, "dow", "left").select("day", F.coalesce("n", F.lit(0)).alias("count"))


def heatmap(history: DataFrame) -> DataFrame:
    """7 x 24 counts with a level 0-5 relative to the fullest cell."""
    cells = history.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    filled = cells.join(_grid(history), ["dow", "hour"], "left").join(_days(history), "dow").select(
        "day", "hour", F.coalesce("n", F.lit(0)).alias("count"))
    share = F.col("count") / F.max("count").over(Window.partitionBy())  # 168 rows
    level = (F.when(F.col("count") == 0, 0).when(share < 0.2, 1).when(share < 0.4, 2)
             .when(share < 0.6, 3).when(share < 0.8, 4).otherwise(5))
    return filled.withColumn("level", level)


def severity_by_hour(history: DataFrame) -> DataFrame:
    counts = history.groupBy(hour_of("timestamp").alias("hour")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])
    return _hours(history).join(counts, "hour", "left").fillna(0, dims.SEVERITIES)


def time_classes(history: DataFrame) -> DataFrame:
    off = is_off_hours("timestamp")
    return history.agg(
        F.count_if(off).alias("off_hours_count"), F.count_if(~off).alias("business_hours_count"),
        F.count_if(is_weekend("timestamp")).alias("weekend_count"), F.count("*").alias("total_analyzed"))


def peaks(history: DataFrame) -> DataFrame:
    """The busiest hour and day, the first on ties."""
    hour = hourly(history).agg(F.max_by("hour", F.struct("count", -F.col("hour"))).alias("peak_hour"))
    names = F.array(*[F.lit(d) for d in dims.DAY_NAMES])
    counts = daily(history).withColumn("dow", F.array_position(names, F.col("day")))
    day = counts.agg(F.max_by("day", F.struct("count", -F.col("dow"))).alias("peak_day"))
    return hour.select("peak_hour", day.scalar().alias("peak_day"))


def action_counts(history: DataFrame) -> DataFrame:
    """Counts of the four charted actions; a missing action counts as monitor."""
    action = F.lower(F.coalesce("action", F.lit("monitor")))
    return history.agg(*[F.count_if(action == a).alias(f"{a}_count")
                         for a in ("monitor", "alert", "isolate", "block")])


def blocklist(history: DataFrame, unblocks: DataFrame | None = None, hot=AUTO) -> DataFrame:
    """First block per address, counted after the last unblock of that address.

    ``unblocks`` has (ip, seq). A block older than the last unblock is lifted.
    """
    blocks = history.where((F.col("action") == "block") & F.col("result.blocked_ip").isNotNull()).select(
        F.col("result.blocked_ip").alias("ip"), "seq", "timestamp", "threat_id", "risk_score")
    if unblocks is not None:
        lifted = unblocks.groupBy("ip").agg(F.max("seq").alias("_lifted"))
        blocks = attach_by_key(blocks, lifted, "ip", "seq", hot=hot).where(
            F.col("_lifted").isNull() | (F.col("seq") > F.col("_lifted")))
    first = blocks.groupBy("ip").agg(F.min_by(F.struct("timestamp", "threat_id", "risk_score"), "seq").alias("b"))
    return first.select("ip", F.col("b.timestamp").alias("blocked_at"), "b.threat_id", "b.risk_score")


def risk_trend(history: DataFrame, points: int = 20) -> DataFrame:
    """The latest risk values in time order."""
    last = history.orderBy(F.col("timestamp").desc(), F.col("seq").desc()).limit(points)
    return last.orderBy("timestamp", "seq").select("seq", "timestamp", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))


def system_counters(history: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Total actions, blocks, distinct connections seen, alerts generated, events processed."""
    seen = events.agg(F.count("*").alias("events_processed"),
                      F.count_distinct("connection_id").alias("connections_seen"))
    counts = history.agg(F.count("*").alias("total_actions"),
                         F.count_if(F.col("action") == "block").alias("blocked_count"))
    return counts.select(
        "*", seen.select("events_processed").scalar().alias("events_processed"),
        seen.select("connections_seen").scalar().alias("connections_seen"),
        alerts.agg(F.count("*").alias("n")).scalar().alias("alerts_generated"))


def worth_alert() -> Column:
    """Medium or worse, or risk above 30."""
    return F.col("severity").isin("medium", "high", "critical") | (F.col("risk_score") > 30)


def alert_filter(detections: DataFrame) -> DataFrame:
    """Rows worth an alert."""
    return detections.where(worth_alert())
