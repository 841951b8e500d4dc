"""Ordered scans, ranks and quantiles against plain pandas/numpy, with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import skew

@pytest.fixture(autouse=True)
def fewer_chunks(monkeypatch):
    monkeypatch.setattr(skew, "CUTS", 64)


def hot_of(df, keys=("user",), at="ts"):
    return skew.find_hot(df, list(keys), at, min_rows=20, share=0.01)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 1500
    users = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 60, n)).astype(float)
    users[rng.random(n) < 0.05] = np.nan
    secs = np.sort(rng.integers(0, 400_000, n))
    pdf = pd.DataFrame({"id": np.arange(n), "user": users, "sec": secs, "v": rng.integers(0, 9, n)})
    df = spark.createDataFrame(pdf).select(
        "id", F.when(~F.isnan("user"), F.col("user").cast("bigint")).alias("user"),
        F.timestamp_seconds("sec").alias("ts"), "v")
    return pdf, df.repartition(6)


def test_hot_key_is_cut_into_chunks(skewed):
    _, df = skewed
    bounds = hot_of(df)
    sizes = {r["user"]: len(r["_bounds"]) for r in bounds.collect()}
    assert sizes[0] > 10 and None in sizes
    per_chunk = skew.with_chunks(df, ["user"], "ts", bounds).groupBy("user", "_chunk").count()
    assert per_chunk.agg(F.max("count")).first()[0] < 80


def test_chunks_stay_at_the_limit_when_one_cut_is_not_enough(skewed, monkeypatch):
    """Four pieces a cut: a key with 40 times the limit is cut three times; a crowded time stays whole."""
    monkeypatch.setattr(skew, "CUTS", 4)
    _, df = skewed
    crowd = df.where("id < 200").withColumn("ts", F.timestamp_seconds(F.lit(1000))).withColumn("user", F.lit(0).cast("bigint"))
    df = df.unionByName(crowd)
    bounds = hot_of(df)
    per_chunk = skew.with_chunks(df, ["user"], "ts", bounds).where("user = 0").groupBy("_chunk").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts") != F.timestamp_seconds(F.lit(1000))).alias("others"))
    assert per_chunk.count() > 16
    assert per_chunk.agg(F.max("others")).first()[0] <= 60


def test_scan_in_order_matches_pandas(skewed):
    pdf, df = skewed
    out = skew.scan_in_order(df, "user", ["ts", "id"], lags={"prev_v": "v", "prev_id": "id"},
                             sums={"run": F.col("v"), "rn": F.lit(1)}, hot=hot_of(df)).toPandas()
    want = pdf.assign(user=pdf.user.fillna(-1)).sort_values(["user", "sec", "id"])
    group = want.groupby("user")
    want = want.assign(prev_v=group.v.shift(1), prev_id=group.id.shift(1),
                       run=group.v.cumsum(), rn=group.cumcount() + 1).set_index("id").sort_index()
    out = out.set_index("id").sort_index()
    assert len(out) == len(want)
    for c in ["prev_v", "prev_id", "run", "rn"]:
        np.testing.assert_array_equal(out[c].astype(float), want[c].astype(float))


def test_trailing_counts_match_brute_force(skewed):
    pdf, df = skewed
    clean = df.where("user is not null")
    windows = {"c1": 3600, "c24": 86400}
    for hot, frame_rows in ((hot_of(clean), None), (None, None), (None, 10), (skew.AUTO, None)):
        out = skew.trailing_counts(clean, "user", "ts", "id", windows, hot=hot, frame_rows=frame_rows).toPandas().set_index("id")
        kept = pdf.dropna()
        assert len(out) == len(kept)
        for _, row in kept.iterrows():
            mine = kept[kept.user == row.user]
            for name, w in windows.items():
                want = ((mine.sec > row.sec - w) & (mine.sec <= row.sec)).sum()
                assert out.loc[row.id, name] == want


def test_number_rows_is_dense_and_ordered(skewed):
    pdf, df = skewed
    out = skew.number_rows(df, ["ts", "id"]).toPandas().sort_values("row_no")
    assert out.row_no.tolist() == list(range(len(pdf)))
    assert out.id.tolist() == pdf.sort_values(["sec", "id"]).id.tolist()


def test_attach_by_key_keeps_every_row(skewed):
    pdf, df = skewed
    per_key = df.groupBy("user").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    for hot in (hot_of(df, at="id"), None):
        out = skew.attach_by_key(df, per_key, "user", "id", hot=hot).toPandas()
        want = pdf.copy()
        want["total"] = want.groupby("user").v.transform("sum")
        assert len(out) == len(pdf)
        np.testing.assert_array_equal(out.set_index("id").sort_index().total.astype(float), want.sort_values("id").total)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1501])
@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, n, p):
    values = np.random.default_rng(n).integers(0, 50, n) / 4
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": values * 2}))
    got = skew.exact_quantiles(df, {"x": p, "y": p})
    assert got["x"] == pytest.approx(np.quantile(values, p))
    assert got["y"] == pytest.approx(np.quantile(values * 2, p))


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).random(20_000), np.random.default_rng(2).integers(0, 40, 20_000).astype(float),
    np.r_[np.zeros(9_000), np.random.default_rng(3).normal(size=11_000)]])
def test_exact_quantiles_with_narrowing(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": values}))
    got = skew.exact_quantiles(df, {"x": 0.37, "y": 0.9}, accuracy=100, sorted_values=50)
    assert got["x"] == pytest.approx(np.quantile(values, 0.37), abs=1e-12)
    assert got["y"] == pytest.approx(np.quantile(values, 0.9), abs=1e-12)


def test_exact_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert skew.exact_quantiles(df, {"x": 0.5}) == {"x": None}


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "x string, y string")
    assert skew.modes(df, ["x", "y"]) == {"x": "a", "y": None}


def test_split_is_exact_per_class(spark, skewed):
    _, df = skewed
    out = skew.top_share_by_hash(df, "user", "id", 0.2, prefix=1).toPandas()
    import hashlib
    for _, group in out.groupby(out.user.fillna(-1)):
        order = sorted(group.id, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert set(group[group.held_out].id) == set(order[: int(len(group) * 0.2)])


def test_both_ways_of_trailing_counts_agree_on_awkward_rows(spark):
    from datetime import datetime, timedelta

    from flowvigil.operators.skew import trailing_counts
    base = datetime(2024, 1, 1)
    rows = [("a", base + timedelta(seconds=s), i) for s, i in ((0, 1), (5, None), (5, 2), (9, 2), (60, 3))]
    rows += [("a", None, 4), ("a", None, None), (None, base, 5), (None, None, None), ("b", base, 1)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, row_id long")
    ways = [trailing_counts(df, "user", "ts", "row_id", {"ten": 10, "hour": 3600}, frame_rows=n) for n in (10**9, 0)]
    have = [sorted(map(str, w.collect())) for w in ways]
    assert have[0] == have[1] and len(have[0]) == len(rows) and ways[0].columns == ways[1].columns


def test_trailing_counts_keep_repeated_rows_and_maps(spark):
    from datetime import datetime, timedelta
    base = datetime(2024, 1, 1)
    rows = [("a", base, 1, {"x": "1"})] * 3 + [("a", base + timedelta(seconds=4), None, None), ("a", base + timedelta(seconds=4), None, {})]
    df = spark.createDataFrame(rows, "user string, ts timestamp, row_id long, props map<string, string>")
    out = skew.trailing_counts(df, "user", "ts", "row_id", {"ten": 10}, frame_rows=0).collect()
    assert sorted(r["ten"] for r in out) == [3, 3, 3, 5, 5] and sorted(r["props"] is None for r in out) == [False] * 4 + [True]


def test_quantiles_leave_nan_out(spark):
    from flowvigil.operators.skew import exact_quantiles
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, nan), (3.0, nan), (nan, None), (nan, nan)], "a double, b double")
    assert exact_quantiles(df, {"a": 0.5, "b": 0.5}) == {"a": 2.0, "b": 1.0}


def test_arff_data_may_begin_with_at(spark, tmp_path):
    from flowvigil.sources.files import read_arff
    (tmp_path / "x.arff").write_text("% c\n@relation r\n@attribute name string\n@attribute n numeric\n@data\n@amy,2\nbob,3\n")
    assert sorted(tuple(r) for r in read_arff(spark, str(tmp_path)).collect()) == [("@amy", 2.0), ("bob", 3.0)]
