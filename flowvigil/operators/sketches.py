"""Traffic features of windows as mergeable rows: sums, moments and sketches of distinct values.

The exact features (``streaming.jobs.window_features``) keep a state row for every distinct value of a window and can't be
added up to longer windows. Here a window and source is one row of bounded size, from one aggregate, in batches and
streams alike; hours or days are merges of these rows and never read the flows again. Distinct counts are HyperLogLog
estimates with a relative standard error of about 1.04 / sqrt(2**lg_k) (1.6 % by default; sets of up to some hundred values
are counted without error). Entropies have no such sketch and stay with the exact form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.functions.stats import ratio

LG_K = 12
# Columns counted by sketches, and the names of the sketches and of their estimates.
DISTINCT = {"dst_ip": ("dst_ips", "unique_dst_ips"), "dst_port": ("dst_ports", "unique_dst_ports")}
_SUMS = ("flow_count", "packet_count", "byte_count", "duration")


def _moments(c: str) -> Column:
    value = F.col(c).cast("double")
    n = F.count(value)
    return F.struct(n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), (F.coalesce(F.var_pop(value), F.lit(0.0)) * n).alias("m2"))


def window_sketches(flows: DataFrame, window: str = "300 seconds", delay: str = "10 minutes", lg_k: int = LG_K) -> DataFrame:
    """One row per source and event-time window; in a stream it is emitted when the window closes.

    Nulls count in no sum, moment or sketch; a null source is a source, rows without a time are left out.
    """
    timed = flows.where(F.col("ts").isNotNull())
    if flows.isStreaming:
        timed = timed.withWatermark("ts", delay)
    found = timed.groupBy(F.window("ts", window).alias("w"), "src_ip").agg(
        F.count("*").alias("flow_count"), F.sum("packets").alias("packet_count"), F.sum("bytes").alias("byte_count"),
        F.sum("flow_duration").alias("duration"), _moments("bytes").alias("sizes"),
        *[F.hll_sketch_agg(c, F.lit(lg_k)).alias(sketch) for c, (sketch, _) in DISTINCT.items()])
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_ip", *_SUMS, "sizes",
                        *[sketch for sketch, _ in DISTINCT.values()])


def _merged(rows: Column) -> Column:
    """Moments of all rows together, pairwise, so that no large numbers are subtracted from each other."""
    def add(total: Column, more: Column) -> Column:
        n = total["n"] + more["n"]
        gap = more["mean"] - total["mean"]
        share = F.when(n > 0, more["n"] / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), (total["mean"] + gap * share).alias("mean"),
                        (total["m2"] + more["m2"] + gap * gap * total["n"] * share).alias("m2"))
    return F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), add)


def roll_up(windows: DataFrame, window: str = "1 hour") -> DataFrame:
    """The rows of ``window_sketches`` merged to longer windows, in the same form, so it can be done again.

    ``window`` must be a multiple of the shorter one. A source has as many rows in it as shorter windows fit, which
    bounds the list of moments; sums and sketches combine map-side.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("window_start", "sizes"))), lambda x: x["sizes"])
    found = windows.groupBy(F.window("window_start", window).alias("w"), "src_ip").agg(
        *[F.sum(c).alias(c) for c in _SUMS], sizes.alias("sizes"),
        *[F.hll_union_agg(sketch).alias(sketch) for sketch, _ in DISTINCT.values()])
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_ip", *_SUMS,
                        _merged(F.col("sizes")).alias("sizes"), *[sketch for sketch, _ in DISTINCT.values()])


def sketch_features(windows: DataFrame) -> DataFrame:
    """Rates, spread and estimated distinct counts of the rows of ``window_sketches`` or ``roll_up``."""
    n, m2 = F.col("sizes.n"), F.col("sizes.m2")
    variance = F.when(n > 1, m2 / (n - 1)).otherwise(F.lit(0.0))
    return windows.select(
        "window_start", "window_end", "src_ip", *_SUMS, ratio(F.col("packet_count"), F.col("duration")).alias("packets_per_second"),
        ratio(F.col("byte_count"), F.col("duration")).alias("bytes_per_second"),
        ratio(F.col("byte_count"), F.col("packet_count")).alias("avg_packet_size"),
        *[F.hll_sketch_estimate(sketch).alias(name) for sketch, name in DISTINCT.values()],
        variance.alias("packet_size_variance"), F.sqrt(variance).alias("packet_size_std"))
