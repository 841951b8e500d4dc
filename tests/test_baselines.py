"""Daily moments merged over a window equal the statistics of the rows themselves."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from flowvigil.operators import baselines

FIRST = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame({"id": range(n), "user": rng.choice(["a", "b", None], n), "ts": [FIRST + timedelta(hours=int(h)) for h in rng.integers(0, 24 * 10, n)],
                        "x": rng.normal(1e9, 1.0, n), "y": rng.exponential(5.0, n)})
    pdf.loc[::7, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype({"user": object})).replace(float("nan"), None)


def store_at(spark, tmp_path):
    return baselines.BaselineStore(spark, f"file://{tmp_path}/moments", "user", ["x", "y"])


def test_merge_equals_the_rows(spark, events, tmp_path):
    pdf, df = events
    store = store_at(spark, tmp_path)
    assert store.refresh(df, date(2024, 1, 5)) == (None, date(2024, 1, 5))
    assert store.refresh(df, date(2024, 1, 9)) == (date(2024, 1, 5), date(2024, 1, 9))
    assert store.days() == [date(2024, 1, d) for d in range(1, 9)]
    for as_of, days, least in ((date(2024, 1, 9), 28, 1), (date(2024, 1, 8), 3, 1), (date(2024, 1, 8), 3, 50), (date(2024, 1, 1), 9, 1)):
        day = pdf.ts.dt.date
        inside = pdf[(day < as_of) & (day >= as_of - timedelta(days=days))]
        want = {k: g for k, g in inside.groupby("user", dropna=False) if g.y.notna().sum() >= least}
        got = {r["user"]: r for r in store.baseline(as_of, days, least).collect()}
        assert {k if isinstance(k, str) else None for k in want} == set(got)
        for k, g in want.items():
            r = got[k if isinstance(k, str) else None]
            assert r["samples"] == g.y.notna().sum()
            assert r["baseline"]["y"]["mean"] == pytest.approx(g.y.mean()) and r["baseline"]["y"]["std"] == pytest.approx(g.y.std(ddof=0))
            # large values with a small spread lose nothing
            assert r["baseline"]["x"]["std"] == pytest.approx(g.x.std(ddof=0), rel=1e-6)


def test_repeats_late_events_and_forgetting(spark, events, tmp_path):
    _, df = events
    store = store_at(spark, tmp_path)
    store.refresh(df.where("id % 2 = 0"), date(2024, 1, 4))
    few = store.baseline(date(2024, 1, 4)).collect()
    store.refresh(df, date(2024, 1, 4))
    assert sorted(map(str, store.baseline(date(2024, 1, 4)).collect())) == sorted(map(str, few))
    assert store.refresh(df, date(2024, 1, 4), again=3) == (date(2024, 1, 1), date(2024, 1, 4))
    whole = baselines.merge(baselines.daily_moments(df, "user", ["x", "y"]), "user", ["x", "y"], date(2024, 1, 4))
    assert sorted(map(str, store.baseline(date(2024, 1, 4)).collect())) == sorted(map(str, whole.collect())) != sorted(map(str, few))
    assert store.forget(date(2024, 1, 3)) == [date(2024, 1, 1), date(2024, 1, 2)] and store.days() == [date(2024, 1, 3)]


def test_z_scores_of_rows_without_a_baseline(spark):
    rows = spark.createDataFrame([(1, "a", 12.0), (2, "b", 12.0), (3, None, 12.0), (4, "a", None)], "id int, user string, x double")
    own = spark.createDataFrame([("a", 9, ((10.0, 2.0),))], "user string, samples long, baseline struct<x:struct<mean:double,std:double>>")
    for usual, other in (({"x": (6.0, 3.0)}, 2.0), (None, 0.0)):
        joined, z = baselines.with_entity_z(rows, own, "user", ["x"], "id", usual)
        got = {r["id"]: r["z"] for r in joined.select("id", z[0].alias("z")).collect()}
        assert got[1] == pytest.approx(1.0) and got[2] == got[3] == pytest.approx(other) and got[4] is None
    assert baselines.merge(baselines.daily_moments(rows.limit(0).withColumn("ts", rows.x.cast("timestamp")), "user", ["x"]), "user", ["x"], date(2024, 1, 1)).count() == 0
