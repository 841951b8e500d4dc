"""Time features per event, counter deltas, recent rows and sliding sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowvigil.functions import timeparts as tp
from flowvigil.operators.skew import AUTO, find_hot, key_sizes, scan_in_order, trailing_counts

TIME_COLUMNS = ["hour_of_day", "day_of_week", "day_of_month", "is_weekend", "is_business_hours",
                "hour_sin", "hour_cos", "day_sin", "day_cos"]


def time_parts(df: DataFrame, at: str = "ts") -> DataFrame:
    return df.withColumns({"hour_of_day": tp.hour_of(at), "day_of_week": tp.weekday_of(at),
                           "day_of_month": F.dayofmonth(at).cast("int")})


def time_flags(df: DataFrame, at: str = "ts") -> DataFrame:
    return df.withColumns({"is_weekend": tp.is_weekend(at).cast("int"),
                           "is_business_hours": tp.is_business_hours(at).cast("int")})


def cyclic_encoding(df: DataFrame, at: str = "ts") -> DataFrame:
    hour_sin, hour_cos = tp.on_circle(tp.hour_of(at), 24)
    day_sin, day_cos = tp.on_circle(tp.weekday_of(at), 7)
    return df.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos,
                           "day_sin": day_sin, "day_cos": day_cos})


def clock_features(df: DataFrame, at: str = "ts") -> DataFrame:
    """The nine columns that depend on the event's own time only; no shuffle."""
    return cyclic_encoding(time_flags(time_parts(df, at), at), at)


def since_last_event(df: DataFrame, key: str = "user_id", at: str = "ts",
                     row_id: str = "event_id", hot=AUTO) -> DataFrame:
    scanned = scan_in_order(df, key, [at, row_id], lags={"_at": at}, hot=hot)
    gap = F.when(F.col(key).isNotNull(), tp.seconds_between(F.col("_at"), F.col(at)))
    return scanned.withColumn("time_since_last_event", F.coalesce(gap, F.lit(0.0))).drop("_at")


def recent_event_counts(df: DataFrame, key: str = "user_id", at: str = "ts",
                        row_id: str = "event_id", hot=AUTO, largest: int | None = None) -> DataFrame:
    windows = {"events_last_hour": 3600, "events_last_day": 86400}
    counted = trailing_counts(df, key, at, row_id, windows, hot=hot, largest=largest)
    return counted.withColumns({
        name: F.when(F.col(key).isNotNull(), F.col(name)).otherwise(0) for name in windows})


def temporal_features(df: DataFrame, key: str = "user_id", at: str = "ts",
                      row_id: str = "event_id", hot=AUTO, largest: int | None = None) -> DataFrame:
    """All time features per event; the per-user ones only when the key column exists."""
    out = df
    if key in df.columns:
        if isinstance(hot, str):
            sizes = key_sizes(df, [key])
            largest, hot = sizes[0], find_hot(df, [key], at, sizes=sizes)
        out = since_last_event(out, key, at, row_id, hot=hot)
        out = recent_event_counts(out, key, at, row_id, hot=hot, largest=largest)
    return clock_features(out, at)


def counter_deltas(counters: DataFrame, host: str = "host", scan: str = "scan_id",
                   active: str | None = None, hot=AUTO) -> DataFrame:
    """Growth of cumulative counters since the host's previous scan.

    The first scan of a host falls back to 1000 bytes and 10 packets. ``active`` is
    the column with the number of active connections; 1 when absent.
    """
    scanned = scan_in_order(counters, host, [scan],
                            lags={"_bytes": "bytes_sent", "_packets": "packets_sent"}, hot=hot)
    share = F.greatest(F.lit(1), F.col(active)) if active else F.lit(1)
    deltas = scanned.withColumns({
        "bytes_delta": F.coalesce(F.col("bytes_sent") - F.col("_bytes"), F.lit(1000)),
        "packets_delta": F.coalesce(F.col("packets_sent") - F.col("_packets"), F.lit(10))})
    return deltas.withColumns({
        "est_bytes": F.greatest(F.lit(64), F.floor(F.col("bytes_delta") / share)).cast("bigint"),
        "est_packets": F.greatest(F.lit(1), F.floor(F.col("packets_delta") / share)).cast("bigint"),
    }).drop("_bytes", "_packets")


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], keep: int, parts: int = 256) -> DataFrame:
    """The newest ``keep`` rows per key.

    Every key is cut into ``parts`` by the task that read the row; each part keeps its newest
    rows and the last step sees at most ``parts * keep`` rows of a key. Up to 1000 rows the
    planner also pushes the limit below the first shuffle, as the rows of a task are in one part.
    """
    newest = [F.col(c).desc() for c in order]
    parted = df.withColumn("_part", F.spark_partition_id() % parts)
    some = parted.withColumn("_no", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*newest))).where(
        F.col("_no") <= keep).drop("_part", "_no")
    return some.withColumn("recent_no", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where(F.col("recent_no") <= keep)


def sequences(df: DataFrame, key: str, order: Sequence[str], features: Sequence[str],
              length: int = 50, block: int = 50_000, hot=AUTO) -> DataFrame:
    """Per row, the ``length`` rows before it (oldest first) and the row itself as target.

    Rows are numbered per key and cut into blocks; the last ``length`` rows of a
    block are also sent to the next one, so every window is complete inside its
    block and no task holds a long history.
    """
    block = max(block, length)
    numbered = scan_in_order(df.select(key, *dict.fromkeys([*order, *features])), key, order,
                             sums={"_rn": F.lit(1)}, hot=hot)
    place = F.col("_rn") - 1
    own = F.floor(place / block)
    blocks = F.when(place % block >= block - length, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    frame = Window.partitionBy(key, "_block").orderBy("_rn").rowsBetween(-length, -1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    windows = spread.withColumn("sequence", F.collect_list(row).over(frame))
    return windows.where((F.col("_block") == F.col("_own")) & (F.size("sequence") == length)).select(
        key, *order, "sequence", row.alias("target"))
