"""Old date folders go, without a look into the data."""

from datetime import date, datetime, timedelta

import pytest

from flowvigil.sources import sinks

NEWEST = datetime(2024, 3, 10, 23, 0)


@pytest.mark.parametrize("batched", [False, True])
def test_drop_expired(spark, tmp_path, batched):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(i, NEWEST - timedelta(days=i)) for i in range(20)] + [(99, None)], "id int, ts timestamp")
    for n in range(2 if batched else 1):
        sinks.store_by_date(rows, f"{path}/batch={n}" if batched else path)
    copies = 2 if batched else 1
    planned = sinks.drop_expired(spark, path, days=14, dry_run=True).collect()
    assert len(planned) == 21 * copies and not any(r["dropped"] for r in planned)
    assert {r["date"] for r in planned if r["expired"]} == {(NEWEST - timedelta(days=i)).date() for i in range(15, 20)}
    assert all(r["files"] >= 1 and r["bytes"] > 0 for r in planned) and spark.read.parquet(path).count() == 21 * copies
    done = sinks.drop_expired(spark, path, days=14).collect()
    assert sum(r["dropped"] for r in done) == 5 * copies
    left = spark.read.parquet(path)
    assert {r["id"] for r in left.collect()} == {*range(15), 99} and left.count() == 16 * copies
    assert not any(r["dropped"] for r in sinks.drop_expired(spark, path, days=14).collect())
    # audit rows stay for a year by default, and a moment may be given
    assert not any(r["expired"] for r in sinks.drop_expired(spark, path, "audit", as_of=date(2025, 1, 1)).collect())
    assert sum(r["dropped"] for r in sinks.drop_expired(spark, path, "audit", as_of=date(2026, 1, 1)).collect()) == 15 * copies
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [99] * copies
    assert sinks.drop_expired(spark, f"{path}-none").count() == 0


def test_no_data_file_is_read(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    sinks.store_by_date(spark.createDataFrame([(1, NEWEST)], "id int, ts timestamp"), path)
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("reads data")))
    assert "FileScan" not in sinks.drop_expired(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_an_empty_table(spark):
    from flowvigil.operators import policies
    from flowvigil.sources import files
    empty = spark.createDataFrame([], "id int, ts timestamp")
    assert files.recent_range(empty).count() == files.recent_cache(empty).count() == policies.retain(empty).count() == 0
