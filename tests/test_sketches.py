"""Windows as mergeable rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowvigil.operators import sketches
from flowvigil.session import scratch_path
from flowvigil.streaming import jobs


def flows(spark, n, targets, ports=60_000, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"sec": np.sort(rng.integers(0, 4 * 3600, n)), "src_ip": rng.choice(["a", "b"], n, p=[0.9, 0.1]),
                        "dst_ip": rng.integers(0, targets, n).astype(str), "dst_port": rng.integers(0, ports, n).astype("int32"),
                        "packets": rng.integers(1, 50, n), "bytes": 10**9 + rng.integers(0, 4, n), "flow_duration": rng.random(n)})
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def test_merges_equal_one_pass(spark):
    """Hours from five minutes, and days from hours, are what one aggregate over all flows gives; large values keep their spread."""
    df = flows(spark, 20_000, 300, 200).unionByName(spark.createDataFrame(
        [(None, None, None, None, None, None, 7), ("c", None, None, None, None, None, 7), ("c", "x", 1, 1, 5, 0.0, None)],
        "src_ip string, dst_ip string, dst_port int, packets long, bytes long, flow_duration double, sec int"
    ).withColumn("ts", F.timestamp_seconds("sec")).drop("sec"))
    small = sketches.window_sketches(df)
    for length in ("1 hour", "1 day"):
        merged = sketches.roll_up(small, length) if length == "1 hour" else sketches.roll_up(sketches.roll_up(small), length)
        have = sketches.sketch_features(merged).toPandas().sort_values(["window_start", "src_ip"]).reset_index(drop=True)
        want = sketches.sketch_features(sketches.window_sketches(df, length)).toPandas().sort_values(["window_start", "src_ip"]).reset_index(drop=True)
        exact = ["window_start", "window_end", "src_ip", "flow_count", "packet_count", "byte_count", "unique_dst_ips", "unique_dst_ports"]
        pd.testing.assert_frame_equal(have[exact], want[exact])
        pd.testing.assert_frame_equal(have.drop(columns=exact), want.drop(columns=exact), rtol=1e-6)
    assert 1.0 < have[have.src_ip == "a"].packet_size_variance.iloc[0] < 1.5


def test_error_of_the_estimates(spark):
    """100,000 targets over many windows: the merged estimate is within four standard errors, a row has bounded size."""
    df = flows(spark, 400_000, 100_000)
    small = sketches.window_sketches(df)
    row = sketches.sketch_features(sketches.roll_up(small, "1 day")).where("src_ip = 'a'").first()
    truth = df.where("src_ip = 'a'").select(F.count_distinct("dst_ip").alias("i"), F.count_distinct("dst_port").alias("p")).first()
    bound = 4 * 1.04 / math.sqrt(2**sketches.LG_K)
    assert abs(row.unique_dst_ips / truth.i - 1) < bound and abs(row.unique_dst_ports / truth.p - 1) < bound
    assert small.agg(F.max(F.length("dst_ips") + F.length("dst_ports"))).first()[0] < 3 * 2**sketches.LG_K


def test_stream_keeps_one_row_a_window_and_source(spark):
    df = flows(spark, 3_000, 200, 200)
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "sketches")
    half = F.timestamp_seconds(F.lit(7200))
    for part in (df.where(F.col("ts") < half), df.where(F.col("ts") >= half)):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = sketches.window_sketches(jobs.file_stream(spark, path, df.schema, files_per_batch=1))
    query = jobs.start(stream, scratch_path(spark, "checkpoint"), path=out)
    query.awaitTermination()
    last = df.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    closed = sketches.window_sketches(df).where(F.col("window_end") <= F.lit(last))
    read = lambda w: sorted(tuple(r) for r in sketches.sketch_features(w).select("window_start", "src_ip", "flow_count", "unique_dst_ips", "unique_dst_ports").collect())
    assert read(spark.read.schema(stream.schema).parquet(out)) == read(closed)
    assert len(query.lastProgress["stateOperators"]) == 1


def test_empty_flows(spark):
    none = flows(spark, 10, 5).where("packets < 0")
    assert sketches.sketch_features(sketches.roll_up(sketches.window_sketches(none))).count() == 0
