"""Streams over several files equal the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import throttle
from flowvigil.plans import streams
from flowvigil.plans.views import Tables
from flowvigil.session import scratch_path
from flowvigil.streaming import jobs


def arriving(spark, batches):
    """A folder with one parquet file per batch, read one file at a time in that order."""
    path = scratch_path(spark, "arriving")
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
    schema = batches[0].schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(path)


def test_throttle_keeps_its_state_between_batches(spark):
    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame({"seq": np.arange(n), "src_ip": rng.choice(list("abc"), n), "sec": np.sort(rng.integers(0, 5000, n))})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    stream = arriving(spark, [df.where(F.col("seq").between(i * 100, i * 100 + 99)) for i in range(3)])()
    path = scratch_path(spark, "sent")
    jobs.run(jobs.throttled(stream, seconds=60), scratch_path(spark, "checkpoint"), path=path)
    got = {r["seq"] for r in spark.read.parquet(path).collect()}
    want = {r["seq"] for r in throttle.sent_rows(df, "src_ip", "ts", "seq", 60).collect()}
    assert got == want


def test_late_row_does_not_open_a_closed_key(spark):
    def rows(items):
        return spark.createDataFrame(items, "seq long, src_ip string, sec long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    stream = arriving(spark, [rows([(1, "a", 1000)]), rows([(2, "a", 900)]), rows([(3, "a", 1060)])])()
    path = scratch_path(spark, "late")
    jobs.run(jobs.throttled(stream, seconds=60), scratch_path(spark, "checkpoint"), path=path)
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_running_counts_read_the_newest_row(spark):
    rows = [(i, 1000 + i, "ab"[i % 2], "9.9.9.9", 80, 0.5, 0.5, "dos") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, sec long, src_ip string, dst_ip string, dst_port int, anomaly_score double, confidence double, threat_class string")
    df = df.withColumn("ts", F.timestamp_seconds("sec"))
    path = scratch_path(spark, "running")
    jobs.run(jobs.running_stats(arriving(spark, [df.where("seq < 10"), df.where("seq >= 10")])()), scratch_path(spark, "checkpoint"), mode="update",
             each_batch=lambda out, batch: jobs.write_batch(out, path, batch))
    assert {r["src_ip"]: r["events"] for r in jobs.latest_state(spark, path).collect()} == {"a": 10, "b": 10}


def test_rewriting_a_batch_does_not_double_it(spark):
    store = scratch_path(spark, "store")
    each = jobs.ingest(store)
    df = spark.range(5).withColumn("ts", F.timestamp_seconds("id"))
    each(df, 0)
    each(df, 0)
    assert spark.read.parquet(store).count() == 5


def test_observed_counts_reach_the_progress(spark):
    df = spark.range(7).withColumn("ts", F.timestamp_seconds("id"))
    query = jobs.start(jobs.observed(arriving(spark, [df.where("id < 3"), df.where("id >= 3")])()), scratch_path(spark, "checkpoint"), path=scratch_path(spark, "observed"))
    query.awaitTermination()
    seen = [p["observedMetrics"]["counters"]["events_processed"] for p in query.recentProgress if p["observedMetrics"]]
    assert sum(seen) == 7


def test_safe_mode_detection_fills_history_and_callback(spark):
    from flowvigil.plans.detect import Models
    rows = [(i, 1000 + i, "10.0.0.1", "8.8.8.8", 443) for i in range(6)]
    flows = spark.createDataFrame(rows, "flow_id long, sec long, src_ip string, dst_ip string, dst_port int").withColumn(
        "ts", F.timestamp_seconds("sec"))
    store, queue, counts = scratch_path(spark, "history"), scratch_path(spark, "queue"), []
    each = jobs.live_detection(Models(), store, queue, lambda found, batch: counts.append(found.count()))
    each(flows, 0)
    each(flows, 0)
    out = spark.read.parquet(store).collect()
    assert len(out) == 6 and {(r["threat_class"], r["recommended_action"]) for r in out} == {("unknown", "monitor")}
    assert counts == [6, 6] and spark.read.parquet(queue).count() == 0


def test_jobs_go_on_where_they_stopped(spark):
    from flowvigil.plans.detect import Models
    rows = spark.range(60).select(F.col("id").alias("flow_id"), F.timestamp_seconds(F.col("id") + 1000).alias("ts"), F.lit("10.0.0.1").alias("src_ip"),
                                  F.lit("8.8.8.8").alias("dst_ip"), F.lit(443).alias("dst_port"))
    files = scratch_path(spark, "arriving")
    source = lambda: jobs.file_stream(spark, files, rows.schema, files_per_batch=1)
    places = {n: (scratch_path(spark, f"{n}-checkpoint"), scratch_path(spark, n)) for n in ("store", "live", "dedupe", "totals")}

    def run_all():
        jobs.run(source(), places["store"][0], each_batch=jobs.ingest(places["store"][1]))
        jobs.run(source(), places["live"][0], each_batch=jobs.live_detection(Models(), places["live"][1]))
        jobs.run(jobs.dedupe(source(), "flow_id"), places["dedupe"][0], path=places["dedupe"][1])
        counts = source().groupBy("src_ip").agg(F.count("*").alias("events"))
        jobs.run(counts, places["totals"][0], mode="update", each_batch=lambda df, n: jobs.write_batch(df, places["totals"][1], n))
    rows.where("flow_id < 40").repartition(2).write.parquet(files)
    run_all()
    rows.where("flow_id >= 30").coalesce(1).write.mode("append").parquet(files)
    run_all()
    read = lambda n: spark.read.parquet(places[n][1])
    assert read("store").count() == 70 and read("store").select("flow_id").distinct().count() == 60
    assert read("live").select("threat_id").distinct().count() == 60
    assert sorted(r.flow_id for r in read("dedupe").collect()) == list(range(60))
    assert jobs.latest_state(spark, places["totals"][1]).first().events == 70


def test_throttle_state_goes_behind_the_watermark(spark):
    def rows(items):
        return spark.createDataFrame(items, "seq long, src_ip string, sec long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    batches = [[(1, "a", 1000), (2, "b", 1010)], [(3, "b", 1030), (4, "c", 5000)], [(5, "c", 5010), (6, "a", 5020)], [(7, "b", 9000)], [(8, "b", 9030)]]
    stream = arriving(spark, [rows(b) for b in batches])()
    path = scratch_path(spark, "expired")
    query = jobs.start(jobs.throttled(stream, seconds=60, delay="1 minute"), scratch_path(spark, "checkpoint"), path=path)
    query.awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == [1, 2, 4, 6, 7]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only b is still closed


def test_bad_topic_records_keep_their_text(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from flowvigil.sources import files
    schema = StructType([StructField("flow_id", LongType()), StructField("src_ip", StringType())])
    raw = spark.createDataFrame([('{"flow_id": 1, "src_ip": "10.0.0.1"}',), ("no json",), ('{"flow_id": "x"}',), (None,), ('{"src_ip": "a"}',)], "value string")
    rows = jobs.topic_rows(raw, schema)
    assert {(r.flow_id, r.src_ip) for r in files.accepted(rows).collect()} == {(1, "10.0.0.1"), (None, "a")}
    assert sorted(r._bad for r in files.rejected(rows).select("_bad").collect()) == ["", "no json", '{"flow_id": "x"}']


def test_live_history_can_be_read_by_the_reports(spark):
    from flowvigil.operators import history
    from flowvigil.plans.detect import Models
    flows = spark.createDataFrame([(1, 1000, "10.0.0.1", "8.8.8.8", 443, 5555, 6, "curl")],
                                  "flow_id long, sec long, src_ip string, dst_ip string, dst_port int, src_port int, protocol int, process string"
                                  ).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    log = scratch_path(spark, "log")
    jobs.live_detection(Models(), scratch_path(spark, "seen"), history_path=log)(flows, 0)
    kept = spark.read.parquet(log)
    row = history.detailed_history(kept).first()
    assert (row.source, row.process, row.src_port, row.protocol, row.service) == ("realtime", "curl", "5555", "6", "HTTPS")
    assert history.stats(kept, "realtime").first().total_actions == 1
    assert history.stats(kept, "simulation").first().total_actions == 0


def test_live_transform_equals_the_batch(spark):
    """With a flow a connection, the stream's projection gives what detection of the whole batch gives."""
    from flowvigil.operators import context, isolation
    from flowvigil.plans.detect import Models, detect, live_detections
    from flowvigil.plans.views import Tables
    flows = Tables(spark, "/root/testdata/sf0.001").flows.withColumn("connection_id", F.col("flow_id"))
    flows = flows.withColumn("protocol", F.when(F.col("flow_id") % 9 > 0, F.col("protocol"))).withColumn(
        "bytes", F.when(F.col("flow_id") % 11 > 0, F.col("bytes")))
    forest = isolation.fit_isolation_forest(context.model_features(flows), context.MODEL_COLUMNS, "flow_id", trees=5, sample=64)
    columns = ["seq", "ts", "src_ip", "is_anomaly", "anomaly_score", "threat_class", "risk_score", "severity", "recommended_action", "status"]
    for models in (Models(forest), Models()):
        found = live_detections(flows, models)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        want = detect(flows, models).select(*columns).toPandas().sort_values("seq").reset_index(drop=True)
        have = found.select(*columns).toPandas().sort_values("seq").reset_index(drop=True)
        pd.testing.assert_frame_equal(have, want)


def test_sums_of_covariances(spark):
    from flowvigil.operators.reconstruction import covariances
    x = np.random.default_rng(1).normal(size=(500, 6))
    mean, joint = covariances(spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(7), "x")
    assert np.allclose(mean, x.mean(0)) and np.allclose(joint, np.cov(x.T, bias=True))
    assert covariances(spark.createDataFrame([], "x array<double>"), "x")[1].shape == (0, 0)


def test_alerts_exactly_one_gap_apart_are_one_incident(spark):
    from flowvigil.operators import policies
    seconds = [0, 300, 600, 901, 5000, 5300, 90_000]
    df = spark.createDataFrame([(i, "a", s, 1.0) for i, s in enumerate(seconds)], "seq long, src_ip string, sec long, risk_score double")
    df = df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    path = scratch_path(spark, "incidents")
    jobs.run(jobs.correlated_alerts(arriving(spark, [df])()), scratch_path(spark, "checkpoint"), path=path)
    have = sorted((r["first_seen"], r["alerts"]) for r in spark.read.parquet(path).collect())
    assert have == sorted((r["first_seen"], r["alerts"]) for r in policies.correlate_alerts(df).collect()) and [n for _, n in have] == [3, 2]


@pytest.mark.parametrize("gaps", [False, True])
def test_parts_of_many_rows_have_several_files(spark, tmp_path, gaps):
    """Each micro-batch is a part of the time with files of bounded size; rows without a time, and equal times, stay whole."""
    n = 400
    at = "case when id % 10 = 0 then null when id < 250 then timestamp_seconds(5) else timestamp_seconds(id) end" if gaps else "timestamp_seconds((id * 37) % 400)"
    spark.range(n).selectExpr("id as event_id", f"{at} as ts", "id % 9 as user_id", "'view' as event_type", "1.5 as value",
                              "'{\"k\": 3}' as props").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    rows = streams._split_stream(t, 2, file_rows=50).withColumn("file", F.input_file_name())
    seen = []
    jobs.run(rows, str(tmp_path / "checkpoint"), each_batch=lambda df, _: seen.append(
        df.agg(F.count("*"), F.min("ts"), F.max("ts"), F.collect_set("event_id"), F.count_distinct("file")).first()))
    assert sorted(i for r in seen for i in r[3]) == list(range(n)) and sum(r[0] for r in seen) == n
    if not gaps:
        assert len(seen) == 2 and seen[0][2] < seen[1][1] and [r[4] for r in seen] == [4, 4]
