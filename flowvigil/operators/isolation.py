"""Isolation forest: one task per tree to fit, Arrow batches to score."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowvigil.dims import ISOLATION_FOREST
from flowvigil.operators.skew import exact_quantiles
from flowvigil.session import materialise

TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, path array<double>"

STEP_ROWS = 4096  # rows that walk through a tree together


def usual_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random cuts until a row is alone or the depth limit; nodes as flat lists."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    tree: dict[str, list] = {"feature": [], "cut": [], "low": [], "high": [], "path": []}

    def node() -> int:
        for name, blank in (("feature", -1), ("cut", 0.0), ("low", 0), ("high", 0), ("path", 0.0)):
            tree[name].append(blank)
        return len(tree["feature"]) - 1

    waiting = [(node(), np.arange(len(x)), 0)]
    while waiting:
        at, rows, depth = waiting.pop()
        varied = []
        if depth < limit and len(rows) > 1:
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            varied = np.flatnonzero(hi > lo)
        if not len(varied):
            tree["path"][at] = depth + usual_path(len(rows))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(lo[feature], hi[feature]))
        below = x[rows, feature] <= cut
        low, high = node(), node()
        tree["feature"][at], tree["cut"][at], tree["low"][at], tree["high"][at] = feature, cut, low, high
        waiting += [(low, rows[below], depth + 1), (high, rows[~below], depth + 1)]
    return tree


def leaf_sums(trees: Sequence[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Sum over the trees of ``path`` of each row's leaf, some thousand rows at a time so that they stay in a core's cache."""
    flat = []
    for tree in trees:
        feature, nodes = np.asarray(tree["feature"], np.int64), np.arange(len(tree["feature"]))
        leaf = feature < 0
        # a leaf is its own child, so all rows take as many steps as the deepest one; NaN is no smaller than a cut and goes high
        children = np.stack([np.where(leaf, nodes, tree["high"]), np.where(leaf, nodes, tree["low"])], axis=1).astype(np.int64).ravel()
        depth, level = 0, nodes[:1]
        while len(level := level[~leaf[level]]):
            depth, level = depth + 1, children.reshape(-1, 2)[level].ravel()
        flat.append((np.maximum(feature, 0), np.asarray(tree["cut"], np.float64), children, np.asarray(tree["path"], np.float64), depth))
    total = np.zeros(len(x))
    for i in range(0, len(x), STEP_ROWS):
        rows = np.ascontiguousarray(x[i:i + STEP_ROWS], np.float64)
        values, begin = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
        for feature, cut, children, path, depth in flat:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                below = values.take(begin + feature.take(at)) <= cut.take(at)
                at = children.take(2 * at + below)
            total[i:i + STEP_ROWS] += path.take(at)
    return total


def path_lengths(trees: Sequence[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean path length of every row over the trees."""
    return leaf_sums(trees, x) / len(trees)


@dataclass
class IsolationForest:
    """Fitted trees (bounded by trees x sample) with the cut and range found at fit time."""

    columns: list[str]
    trees: list[dict[str, np.ndarray]]
    sample: int
    threshold: float = 0.0
    lowest: float = 0.0
    highest: float = 1.0

    def raw_score(self) -> Column:
        """2^(-mean path / usual path), near 1 for rows that are easy to isolate."""
        if not self.trees:  # fitted on no rows
            return F.lit(None).cast("double")
        trees, usual = self.trees, usual_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.vstack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                yield pd.Series(2.0 ** (-path_lengths(trees, x) / usual))

        return score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]))

    def score(self, df: DataFrame) -> DataFrame:
        """Add raw_score, is_anomaly, and anomaly_score scaled with the range at fit time."""
        out = df.withColumn("raw_score", self.raw_score())
        span = self.highest - self.lowest + 1e-8
        scaled = F.least(F.greatest((F.col("raw_score") - self.lowest) / F.lit(span), F.lit(0.0)), F.lit(1.0))
        return out.withColumns({"is_anomaly": F.col("raw_score") > F.lit(self.threshold), "anomaly_score": scaled})

    def at_contamination(self, scored: DataFrame, contamination: float) -> "IsolationForest":
        """The same trees with the cut of another expected share of anomalies."""
        cut = exact_quantiles(scored, {"raw_score": 1.0 - contamination})["raw_score"]
        return IsolationForest(self.columns, self.trees, self.sample, cut, self.lowest, self.highest)


def tree_samples(df: DataFrame, columns: Sequence[str], row_id: str, trees: int, sample: int, seed: int,
                 total: int) -> DataFrame:
    """(tree, columns): ``sample`` rows for each tree, without repeats inside a tree.

    Rows get a repeatable hash per tree and the lowest ``sample`` win. A first
    hash filter keeps about four times what all trees need, so only a bounded number
    of rows is ever multiplied by the trees.
    """
    def uniform(*parts) -> Column:
        return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2 ** 31)) / F.lit(2.0 ** 31)

    rows = df.select(row_id, *columns)
    keep = 4.0 * trees * sample / max(total, 1)
    if keep < 1:
        rows = rows.where(uniform(F.col(row_id), F.lit("pool")) < keep)
        total = int(total * keep)
    chance = min(1.0, 2.0 * sample / max(total, 1) + 32.0 / max(total, 1))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_u", uniform(F.col(row_id), F.col("tree"))).where(F.col("_u") < chance)
    place = Window.partitionBy("tree").orderBy("_u", row_id)
    return drawn.withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= sample).select("tree", *columns)


def fit_isolation_forest(df: DataFrame, columns: Sequence[str], row_id: str, trees: int = ISOLATION_FOREST["trees"],
                         sample: int = ISOLATION_FOREST["sample"],
                         contamination: float = ISOLATION_FOREST["contamination"],
                         seed: int = ISOLATION_FOREST["seed"]) -> IsolationForest:
    """Grow the trees in parallel and set the cut at the contamination quantile.

    Cuts are drawn between a column's own bounds, so scaling the input first would
    not change the trees. A forest fitted on no rows has no trees and scores null.
    """
    if trees < 1:
        raise ValueError("a forest needs a tree")
    columns = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        x = pdf[columns].astype(float).fillna(0.0).sort_values(columns).to_numpy()
        return pd.DataFrame([{"tree": number, **grow_tree(x, np.random.default_rng([seed, number]))}])

    total = df.count()
    sampled = tree_samples(df, columns, row_id, trees, sample, seed, total)
    # a fixed number of tasks: the sample is small in bytes but each tree is work
    spread = sampled.repartition(max(8, trees // 4), "tree")
    grown = spread.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
    arrays = [{name: np.array(row[name]) for name in ("feature", "cut", "low", "high", "path")} for row in grown]
    model = IsolationForest(columns, arrays, min(sample, max(total, 1)))
    if not arrays:
        return model
    # scored once; the quantile search reads the scores several times
    scored = materialise(df.select(model.raw_score().alias("raw_score")))
    bounds = exact_quantiles(scored.withColumns({"_lo": F.col("raw_score"), "_hi": F.col("raw_score")}),
                             {"raw_score": 1.0 - contamination, "_lo": 0.0, "_hi": 1.0})
    model.threshold, model.lowest, model.highest = bounds["raw_score"], bounds["_lo"], bounds["_hi"]
    return model


def normalise_within(df: DataFrame, score: str, name: str = "anomaly_score") -> DataFrame:
    """1 - (s - min) / (max - min) over the whole DataFrame; lower ``score`` is more anomalous."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = (0.0, 0.0) if ends["lo"] is None else (float(ends["lo"]), float(ends["hi"]))
    return df.withColumn(name, 1 - (F.col(score) - F.lit(lo)) / F.lit(hi - lo + 1e-8))
