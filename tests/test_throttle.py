"""The chunked walk equals the plain one, also for a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import skew, throttle


@pytest.fixture(autouse=True)
def fewer_chunks(monkeypatch):
    monkeypatch.setattr(skew, "CUTS", 64)


def plain_walk(times, gap):
    sent, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            sent.append(i)
            last = t
    return sent


@pytest.mark.parametrize("gap", [1, 7, 60, 500])
def test_walk(gap):
    times = np.sort(np.random.default_rng(gap).integers(0, 3000, 400))
    assert throttle.walk(times, throttle.NEVER, gap).tolist() == plain_walk(times, gap)


@pytest.mark.parametrize("gap", [3, 60, 1000])
def test_chunk_ends_cover_every_entry(gap):
    rng = np.random.default_rng(gap)
    times = np.sort(rng.integers(100, 900, 200))
    until, end = throttle.chunk_ends(times, gap)
    for open_at in range(0, int(times[0]) + gap):
        picked = throttle.walk(times, open_at, gap)
        place = np.searchsorted(until, open_at, "left")
        if len(picked) == 0:
            assert place == len(until)
        else:
            assert end[place] == times[picked[-1]]


@pytest.mark.parametrize("gap", [1, 40, 5000, 90_000])
def test_hot_key_in_chunks(spark, gap):
    rng = np.random.default_rng(gap)
    n = 1200
    pdf = pd.DataFrame({"seq": np.arange(n), "src": np.where(rng.random(n) < .5, "hot", rng.integers(0, 30, n).astype(str)),
                        "sec": np.sort(rng.integers(0, 200_000, n))})
    df = spark.createDataFrame(pdf).select("seq", "src", F.timestamp_seconds("sec").alias("ts")).repartition(5)
    want = set()
    for _, group in pdf.groupby("src"):
        group = group.sort_values(["sec", "seq"])
        want |= set(group.seq.iloc[plain_walk(group.sec.tolist(), gap)])
    hot = skew.find_hot(df, ["src"], "ts", min_rows=50, share=0.02)
    assert hot.count() == 1
    for choice in (hot, None):
        got = {r["seq"] for r in throttle.sent_rows(df, "src", "ts", "seq", gap, choice).collect()}
        assert got == want


@pytest.mark.parametrize("gap", [40, 86_400])
def test_hot_key_with_small_groups_and_an_uneven_course(spark, monkeypatch, gap):
    """A burst, a quiet day, a burst: all pointers of the first burst lead into one quiet chunk."""
    monkeypatch.setattr(throttle, "GROUP_ROWS", 25)
    monkeypatch.setattr(skew, "CUTS", 8)
    rng = np.random.default_rng(gap)
    sec = np.concatenate([rng.integers(0, 500, 400), rng.integers(80_000, 90_000, 12), rng.integers(86_000, 400_000, 300), [7] * 60])
    sec = np.concatenate([sec, sec + 13])
    pdf = pd.DataFrame({"seq": rng.permutation(len(sec)), "src": np.repeat(["hot", None], len(sec) // 2), "sec": sec})
    df = spark.createDataFrame(pdf).select("seq", "src", F.timestamp_seconds("sec").alias("ts")).repartition(5)
    df = df.unionByName(spark.createDataFrame([(-1, "hot", None)], "seq long, src string, ts timestamp"))
    want = set()
    for _, group in pdf.groupby("src", dropna=False):
        group = group.sort_values(["sec", "seq"])
        want |= set(group.seq.iloc[plain_walk(group.sec.tolist(), gap)])
    hot = skew.find_hot(df, ["src"], "ts", min_rows=20, share=0.01)
    assert hot.agg(F.min(F.size("_bounds"))).first()[0] > 16
    for choice in (hot, None):
        got = [r["seq"] for r in throttle.sent_rows(df, "src", "ts", "seq", gap, choice).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_cool_down_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None)], "seq long, src string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    assert throttle.sent_rows(df, "src", "ts", "seq", 60).count() == 0
    some = df.withColumn("ts", F.timestamp_seconds(F.lit(5)))
    assert throttle.sent_rows(some, "src", "ts", "seq", 0).count() == 2
    assert [r["seq"] for r in throttle.sent_rows(some, "src", "ts", "seq", 1).collect()] == [1]
