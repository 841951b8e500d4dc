"""Feature operators on hand-made rows and against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import context, network, skew, temporal, user

FLOW = "flow_id long, connection_id long, packets long, bytes long, flow_duration double, protocol int, dst_port int, dst_ip string, direction string"


def flows(spark, rows):
    return spark.createDataFrame(rows, FLOW)


def events(spark, rows, schema="event_id long, user_id long, ts string, geolocation string"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def by(df, key, column):
    return {r[key]: r[column] for r in df.collect()}


def nats(values):
    p = pd.Series(values).value_counts(normalize=True)
    return float(-(p * np.log(p)).sum())


def test_single_one_way_flow(spark):
    row = network.network_features(flows(spark, [(1, 7, 3, 90, 2.0, 6, 80, "a", "forward")])).first()
    assert (row["packet_size_variance"], row["packet_size_std"], row["flow_asymmetry"]) == (0.0, 0.0, 0.0)
    assert (row["protocol_entropy"], row["port_entropy"]) == (0.0, 0.0)
    assert (row["unique_dst_ips"], row["unique_dst_ports"]) == (1, 1)
    assert row["avg_packet_size"] == pytest.approx(90 / (3 + 1e-6))


def test_asymmetry_of_two_ways(spark):
    out = network.flow_asymmetry(flows(spark, [
        (1, 7, 1, 300, 1.0, 6, 80, "a", "forward"), (2, 7, 1, 100, 1.0, 6, 80, "a", "backward")]))
    assert out.first()["flow_asymmetry"] == pytest.approx(200 / 400, rel=1e-6)


@pytest.mark.parametrize("directed", [True, False])
def test_network_features_match_pandas(spark, directed):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({
        "flow_id": np.arange(n), "connection_id": rng.integers(0, 25, n), "packets": rng.integers(1, 9, n),
        "bytes": rng.integers(0, 5000, n), "flow_duration": rng.random(n), "protocol": rng.choice([6, 17], n),
        "dst_port": rng.choice([80, 443, 22, -1], n), "dst_ip": rng.choice(list("abcd"), n),
        "direction": rng.choice(["forward", "backward"], n)})
    df = spark.createDataFrame(pdf).withColumn("dst_port", F.when(F.col("dst_port") > 0, F.col("dst_port")))
    if not directed:
        df = df.drop("direction")
    got = network.network_features(df).toPandas().set_index("connection_id").sort_index()
    known = pdf[pdf.dst_port > 0]
    group = pdf.groupby("connection_id")
    assert ("flow_asymmetry" in got.columns) == directed
    np.testing.assert_allclose(got.byte_count, group.bytes.sum())
    np.testing.assert_allclose(got.packet_size_variance, group.bytes.var(), rtol=1e-9)
    np.testing.assert_allclose(got.protocol_entropy, group.protocol.apply(nats), atol=1e-12)
    np.testing.assert_allclose(got.port_entropy, known.groupby("connection_id").dst_port.apply(nats), atol=1e-12)
    np.testing.assert_allclose(got.unique_dst_ports, known.groupby("connection_id").dst_port.nunique())
    np.testing.assert_allclose(got.packets_per_second, group.packets.sum() / (group.flow_duration.sum() + 1e-6))


def test_features_of_an_empty_table(spark):
    assert network.network_features(flows(spark, [])).count() == 0
    assert user.user_features(events(spark, []).withColumn("resource", F.lit("r"))).count() == 0


def test_unusual_hours_keep_all_ties(spark):
    rows = events(spark, [(1, 1, "2024-01-01 08:00:00", "x"), (2, 1, "2024-01-02 08:10:00", "x"),
                          (3, 1, "2024-01-01 20:00:00", "x"), (4, 1, "2024-01-02 20:00:00", "x"),
                          (5, 1, "2024-01-03 03:00:00", "x"), (6, None, "2024-01-03 03:00:00", "x")])
    assert by(user.unusual_time(rows), "event_id", "unusual_time_access") == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0}


def test_impossible_travel(spark):
    rows = events(spark, [(1, 1, "2024-01-01 10:00:00", "DE"), (2, 1, "2024-01-01 10:30:00", "US"),
                          (3, 1, "2024-01-01 11:30:00", "DE"), (4, 1, "2024-01-01 11:31:00", "DE"),
                          (5, 2, "2024-01-01 10:01:00", "FR"), (6, None, "2024-01-01 10:00:00", "DE"),
                          (7, None, "2024-01-01 10:01:00", "US")])
    assert by(user.impossible_travel(rows), "event_id", "impossible_travel") == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_user_features_agree_with_the_single_operators(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame({"event_id": np.arange(n), "user_id": rng.integers(0, 9, n), "sec": rng.integers(0, 300_000, n),
                        "resource": rng.choice(list("abc"), n), "geolocation": rng.choice(["DE", "US"], n), "data_volume": rng.random(n)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec"))
    whole = user.user_features(df).toPandas().set_index("user_id").sort_index()
    for part in (user.login_frequency(df), user.resource_access(df), user.data_movement(df), user.location_changes(df),
                 user.unusual_time(df).groupBy("user_id").agg(F.sum("unusual_time_access").alias("unusual_time_access")),
                 user.impossible_travel(df).groupBy("user_id").agg(F.sum("impossible_travel").alias("impossible_travel"))):
        one = part.toPandas().set_index("user_id").sort_index()
        for c in one.columns:
            np.testing.assert_allclose(whole[c].astype(float), one[c].astype(float), atol=1e-12)


def test_time_since_last_event_follows_time_not_row_order(spark):
    rows = events(spark, [(3, 1, "2024-01-01 10:02:00", "x"), (1, 1, "2024-01-01 10:00:00", "x"),
                          (2, 1, "2024-01-01 10:00:30", "x"), (4, 2, "2024-01-01 09:00:00", "x")])
    assert by(temporal.since_last_event(rows), "event_id", "time_since_last_event") == {1: 0.0, 2: 30.0, 3: 90.0, 4: 0.0}


def test_trailing_window_is_open_on_the_left(spark):
    rows = events(spark, [(1, 1, "2024-01-01 10:00:00", "x"), (2, 1, "2024-01-01 11:00:00", "x"),
                          (3, 1, "2024-01-01 11:59:59", "x"), (4, 1, "2024-01-02 10:00:00", "x")])
    out = temporal.recent_event_counts(rows)
    assert by(out, "event_id", "events_last_hour") == {1: 1, 2: 1, 3: 2, 4: 1}
    assert by(out, "event_id", "events_last_day") == {1: 1, 2: 2, 3: 3, 4: 3}


def test_temporal_features_without_user(spark):
    out = temporal.temporal_features(events(spark, [(1, 1, "2024-01-07 17:00:00", "x")]).drop("user_id")).first()
    assert (out["day_of_week"], out["is_weekend"], out["is_business_hours"]) == (6, 1, 1)
    assert "time_since_last_event" not in out


def test_counter_deltas(spark):
    rows = spark.createDataFrame([("h", 1, 5000, 50, 4), ("h", 2, 5100, 52, 4), ("h", 3, 9100, 152, 0)],
                                 "host string, scan_id long, bytes_sent long, packets_sent long, active int")
    out = temporal.counter_deltas(rows, active="active").orderBy("scan_id").collect()
    assert [(r["bytes_delta"], r["est_bytes"], r["est_packets"]) for r in out] == [(1000, 250, 2), (100, 64, 1), (4000, 4000, 100)]


@pytest.mark.parametrize("hot", [False, True])
def test_sequences_across_blocks(spark, hot):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"user": rng.choice([0, 0, 0, 1, 2], 200), "at": rng.permutation(200), "v": rng.random(200)})
    df = spark.createDataFrame(pdf)
    found = skew.find_hot(df, ["user"], "at", min_rows=20, share=0.05) if hot else None
    out = temporal.sequences(df, "user", ["at"], ["v"], length=5, block=7, hot=found).collect()
    want = {}
    for _, g in pdf.sort_values("at").groupby("user"):
        v = g.v.tolist()
        for i in range(5, len(v)):
            want[g["at"].iloc[i]] = (v[i - 5:i], v[i])
    got = {r["at"]: ([x[0] for x in r["sequence"]], r["target"][0]) for r in out}
    assert got == want


def test_latest_per_key_uses_a_group_limit_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    out = temporal.latest_per_key(df, "k", ["id"], 4)
    assert sorted(r["id"] for r in out.collect()) == list(range(88, 100))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # on both sides of the shuffle, by part of a key and then by key


def test_latest_per_key_beyond_the_planner_limit(spark):
    df = spark.range(0, 9000, 1, 16).select(F.lit(1).alias("k"), "id")
    for parts in (1, 3, 256):
        out = temporal.latest_per_key(df, "k", ["id"], 1500, parts)
        assert [(r["id"], r["recent_no"]) for r in out.orderBy("recent_no").collect()] == [(8999 - i, i + 1) for i in range(1500)]


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "x string")
    codes = context.fit_codes(df, "x")
    assert by(codes, "x", "code") == {"a": 0, "b": 1, "c": 2}
    new = spark.createDataFrame([("c",), ("z",), (None,)], "x string")
    assert by(context.apply_codes(new, "x", codes, "n", "first"), "x", "n") == {"c": 2, "z": 0, None: None}
    assert by(context.apply_codes(new, "x", codes, "n", "keep"), "x", "n") == {"c": 2, "z": None, None: None}
    with pytest.raises(Exception, match="unseen value in x: z"):
        context.apply_codes(new, "x", codes, "n").collect()


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, y double")
    scaler = context.fit_scaler(df, ["x", "y"])
    out = context.apply_scaler(df, scaler).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    np.testing.assert_allclose(out.x, (x - x.mean()) / x.std())
    assert out.y.tolist() == [0.0, 0.0, 0.0]


def test_assembled_groups_keep_every_event(spark):
    rows = flows(spark, [(1, 7, 3, 90, 2.0, 6, 80, "a", "forward"), (2, None, 3, 90, 2.0, 6, 80, "a", "forward")])
    rows = rows.withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    out = context.model_features(rows).orderBy("flow_id").collect()
    assert len(context.MODEL_COLUMNS) == 21 and [r["packet_count"] for r in out] == [3.0, 0.0]
