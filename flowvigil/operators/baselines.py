"""Baselines per entity from daily moments that are kept and merged.

For each entity and day a row holds count, mean and sum of squared deviations of every column. A baseline
over a window of days is a merge of these rows, so the events of a day are read once, on the day it is added, whatever
the length of the window. The rows are date folders: adding a day writes its folder, and adding it again replaces it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.operators.skew import AUTO, attach_by_key
from flowvigil.sources.folders import Folders

DAYS = 28


def daily_moments(df: DataFrame, entity: str, columns: Sequence[str], at: str = "ts") -> DataFrame:
    """(entity, day, moments): for each column a struct of n, mean and m2; nulls count nowhere. Combines map-side."""
    def moments(c: str) -> Column:
        value = F.col(c).cast("double")
        n = F.count(value)
        return F.struct(n.alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
                        (F.coalesce(F.var_pop(value), F.lit(0.0)) * n).alias("m2")).alias(c)
    found = df.groupBy(entity, F.to_date(at).alias("day")).agg(*map(moments, columns))
    return found.select(entity, "day", F.struct(*columns).alias("moments"))


def merge(moments: DataFrame, entity: str, columns: Sequence[str], as_of: date, days: int = DAYS, min_samples: int = 1) -> DataFrame:
    """(entity, samples, baseline) over the ``days`` before ``as_of``: for each column mean and population deviation.

    ``samples`` is the smallest count of a column; entities with fewer than ``min_samples`` are left out. An entity has
    at most ``days`` rows, which are merged pairwise, so no large numbers are subtracted from each other.
    """
    window = moments.where((F.col("day") >= F.lit(as_of - timedelta(days=days))) & (F.col("day") < F.lit(as_of)))
    lists = window.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("day", "moments"))).alias("list"))

    def merged(c: str) -> Column:
        def add(total: Column, row: Column) -> Column:
            more = row["moments"][c]
            n = total["n"] + more["n"]
            gap = more["mean"] - total["mean"]
            share = F.when(n > 0, more["n"] / n).otherwise(F.lit(0.0))
            return F.struct(n.alias("n"), (total["mean"] + gap * share).alias("mean"),
                            (total["m2"] + more["m2"] + gap * gap * total["n"] * share).alias("m2"))
        return F.aggregate("list", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), add).alias(c)

    out = lists.select(entity, *map(merged, columns))
    smallest = F.col(columns[0])["n"] if len(columns) == 1 else F.least(*[F.col(c)["n"] for c in columns])
    pairs = [F.struct(F.col(c)["mean"].alias("mean"), F.sqrt(F.col(c)["m2"] / F.col(c)["n"]).alias("std")).alias(c) for c in columns]
    return out.withColumn("samples", smallest).where(F.col("samples") >= max(min_samples, 1)).select(
        entity, "samples", F.struct(*pairs).alias("baseline"))


class BaselineStore:
    """Daily moments under ``path``, in ``day=`` folders."""

    def __init__(self, spark: SparkSession, path: str, entity: str, columns: Sequence[str]):
        self.spark, self.path, self.entity, self.columns = spark, path.rstrip("/"), entity, list(columns)

    def days(self) -> list[date]:
        found = Folders(self.spark).matching(f"{self.path}/day=*")
        return sorted(date.fromisoformat(e.name.removeprefix("day=")) for e in found if e.name != "day=__HIVE_DEFAULT_PARTITION__")

    def refresh(self, events: DataFrame, as_of: date, at: str = "ts", again: int = 0) -> tuple[date | None, date]:
        """Add the whole days before ``as_of`` that are not there yet, and the newest ``again`` stored ones for late events.

        The bounds are literals, so only these days are read from a table in order or in folders of time.
        Returns the bounds; the first is None when all days are read. Repeating a call changes nothing.
        """
        stored = self.days()
        since = stored[-1] + timedelta(days=1 - again) if stored else None
        kind = events.schema[at].dataType
        rows = events.where(F.col(at) < F.lit(as_of).cast(kind))
        if since is not None:
            rows = rows.where(F.col(at) >= F.lit(since).cast(kind))
        (daily_moments(rows, self.entity, self.columns, at).hint("rebalance", "day").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path))
        return since, as_of

    def moments(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def baseline(self, as_of: date, days: int = DAYS, min_samples: int = 1) -> DataFrame:
        return merge(self.moments(), self.entity, self.columns, as_of, days, min_samples)

    def forget(self, before: date) -> list[date]:
        """Remove the days before ``before``; those removed."""
        gone = [d for d in self.days() if d < before]
        for day in gone:
            Folders(self.spark).delete(f"{self.path}/day={day.isoformat()}")
        return gone


def with_entity_z(df: DataFrame, baseline: DataFrame, entity: str, columns: Sequence[str], row_id: str,
                  usual: Mapping[str, tuple[float, float]] | None = None, hot=AUTO) -> tuple[DataFrame, list[Column]]:
    """``df`` with its entity's ``baseline``, and the z-score of each column against it.

    An entity without a baseline, and a null one, is held against ``usual`` (the baseline of all), and without that has z 0. Rows of an entity
    with very many are spread.
    """
    joined = attach_by_key(df, baseline.select(entity, F.col("baseline").alias("_baseline")), entity, row_id, hot=hot)

    def z(c: str) -> Column:
        own = F.col("_baseline")[c]
        mean, std = (usual or {}).get(c, (None, None))
        other = F.lit(0.0) if mean is None else (F.col(c) - F.lit(mean)) / F.lit(std + 1e-8)
        return F.when(own.isNull(), other).otherwise((F.col(c) - own["mean"]) / (own["std"] + F.lit(1e-8)))
    return joined, [z(c) for c in columns]
