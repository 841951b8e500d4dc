"""Rings and caches kept as state equal the batch functions after every micro-batch."""

import time
from datetime import datetime, timedelta

import pytest

from flowvigil.operators.temporal import latest_per_key
from flowvigil.sources.files import recent_cache
from flowvigil.streaming import jobs, recent

SCHEMA = "kind string, seq long, ts timestamp, note string, extra int"
START = datetime(2024, 1, 1)


class Arriving:
    """A folder that gets one file a batch, and the rows so far."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.checkpoint, self.rows = spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", []
        self.frame([]).write.parquet(self.path)
        self.stream = jobs.file_stream(spark, self.path, self.frame([]).schema)

    def frame(self, rows):
        return self.spark.createDataFrame(rows, SCHEMA)

    def batch(self, changes, rows, mode):
        self.frame(rows).coalesce(1).write.mode("append").parquet(self.path)
        self.rows += rows
        with recent.rocksdb_state(self.spark):
            query = jobs.start(changes, self.checkpoint, mode=mode, each_batch=lambda df, batch: df.write.format("noop").mode("overwrite").save())
            query.awaitTermination()
        return sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"])

    def all(self):
        return self.frame(self.rows)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_ring_after_every_batch(spark, tmp_path):
    arriving, keep = Arriving(spark, tmp_path), 7
    changes = recent.keep_ring(arriving.stream, "kind", ["ts", "seq"], keep, parts=3)
    batches = [
        [("a", i, START + timedelta(seconds=i % 5), None, i) for i in range(40)] + [(None, 1, START, "x", None)],
        [("a", 100, START - timedelta(days=9), "too old", 1), ("b", 1, START, "ü", 1)],
        [("a", 200 + i, START + timedelta(days=1, microseconds=i), "new", None) for i in range(5)],
        [("b", i, None if i % 2 else START, "", i) for i in range(30)]]
    for rows in batches:
        arriving.batch(changes, rows, "update")
        ring = recent.recent_ring(spark, arriving.checkpoint, arriving.stream.schema, "kind", ["ts", "seq"], keep)
        same(ring, latest_per_key(arriving.all(), "kind", ["ts", "seq"], keep))
    state = recent._state_rows(spark, arriving.checkpoint, "ring")
    assert state.count() <= 3 * keep * 3 < len(arriving.rows) + 30


def test_cache_after_every_batch(spark, tmp_path):
    arriving = Arriving(spark, tmp_path)
    changes = recent.keep_recent(arriving.stream, "ts", ttl_seconds=3600, parts=2)
    at = lambda minutes, n: [("a", i, START + timedelta(minutes=minutes, seconds=i), None, i) for i in range(n)]
    sizes = []
    for rows in (at(0, 50), at(30, 5), at(80, 5), at(30, 4) + [("late", 1, START, "", 1), ("never", 2, None, "", 1)], at(300, 3), at(301, 1)):
        arriving.batch(changes, rows, "append")
        cache = recent.recent_events(spark, arriving.checkpoint, arriving.stream.schema, "ts", 3600)
        same(cache, recent_cache(arriving.all(), "ts", 3600))
        sizes.append(recent._state_rows(spark, arriving.checkpoint, "events").count())
    assert sizes[0] == 50 and sizes[-1] == 4 and max(sizes[2:]) < 65


def test_cache_of_a_day_is_kept_by_the_hour(spark, tmp_path):
    """A call into state for each hour and part, not for each minute; hours leave it, and what is left is right."""
    arriving, changed = Arriving(spark, tmp_path), []
    changes = recent.keep_recent(arriving.stream, "ts", ttl_seconds=86400, parts=2)
    for first in (0, 1500, 4000):
        rows = [("a", first + i, START + timedelta(minutes=first + i), None, i) for i in range(180)]
        arriving.frame(rows).coalesce(1).write.mode("append").parquet(arriving.path)
        arriving.rows += rows
        with recent.rocksdb_state(spark):
            jobs.run(changes, arriving.checkpoint, each_batch=lambda df, batch: changed.append([tuple(r) for r in df.collect()]))
        same(recent.recent_events(spark, arriving.checkpoint, arriving.stream.schema, "ts", 86400), recent_cache(arriving.all(), "ts", 86400))
    calls = [row for batch in changed for row in batch]
    assert len(calls) <= 2 * 2 * 12 and sum(row[2] for row in calls) == 540
    assert all(row[0] % 60 == 0 for row in calls) and any(row[3] for row in calls)
    assert recent._state_rows(spark, arriving.checkpoint, "events").count() == 180


def test_cache_by_arrival_expires(spark, tmp_path):
    arriving = Arriving(spark, tmp_path)
    changes = recent.keep_recent(arriving.stream, "ts", ttl_seconds=20, by_arrival=True, parts=2)
    with recent.rocksdb_state(spark):
        query = jobs.start(changes, arriving.checkpoint, every="1 second", each_batch=lambda df, batch: df.write.format("noop").mode("overwrite").save())
    try:
        for seq in (1, 2):
            arriving.frame([("a", seq, START, "", 1)]).coalesce(1).write.mode("append").parquet(arriving.path)
            for _ in range(60):
                time.sleep(0.5)
                if sum(p["numInputRows"] for p in query.recentProgress) == seq:
                    break
            time.sleep(21 if seq == 1 else 0)
    finally:
        query.stop()
    left = recent.recent_events(spark, arriving.checkpoint, arriving.stream.schema).collect()
    assert [r["seq"] for r in left] == [2]
    time.sleep(20)
    assert recent.recent_events(spark, arriving.checkpoint, arriving.stream.schema).count() == 0


def test_setting_is_put_back(spark):
    before = spark.conf.get(recent.PROVIDER)
    with pytest.raises(ZeroDivisionError):
        with recent.rocksdb_state(spark):
            assert spark.conf.get(recent.PROVIDER) == recent.ROCKSDB
            1 / 0
    assert spark.conf.get(recent.PROVIDER) == before
