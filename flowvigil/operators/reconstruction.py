"""Reconstruction and next-row prediction errors with linear models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.functions.stats import clip01
from flowvigil.operators.context import apply_scaler, fit_scaler
from flowvigil.operators.skew import AUTO, exact_quantiles
from flowvigil.operators.temporal import sequences
from flowvigil.session import materialise


def score_errors(df: DataFrame, threshold: float, error: str = "error") -> DataFrame:
    """Score ``clip(e / (t + 1e-8), 0, 1)`` and flag ``e > t``; a null error gives nulls."""
    return df.withColumns({
        "anomaly_score": F.when(F.col(error).isNotNull(), clip01(F.col(error) / F.lit(threshold + 1e-8))),
        "is_anomaly": F.col(error) > F.lit(threshold)})


def error_threshold(df: DataFrame, error: str = "error", share: float = 0.95) -> float:
    """Exact quantile of the errors, which are worked out once and then read several times."""
    return exact_quantiles(materialise(df.select(error)), {error: share})[error]


@dataclass
class LinearAutoencoder:
    """Projection on the leading components of the scaled columns, and back."""

    columns: list[str]
    scaler: dict[str, tuple[float, float]]
    pca: PCAModel
    threshold: float = 0.0

    def errors(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, encoding, error). The components are orthonormal, so the mean squared
        error of the reconstruction is (|x|^2 - |encoding|^2) / d."""
        scaled = apply_scaler(df.select(row_id, *self.columns), self.scaler)
        length = reduce(add, [F.col(c) * F.col(c) for c in self.columns])
        vectors = VectorAssembler(inputCols=self.columns, outputCol="_x").transform(scaled.withColumn("_len", length))
        encoded = self.pca.transform(vectors).withColumn("encoding", vector_to_array("_z"))
        kept = F.aggregate("encoding", F.lit(0.0), lambda total, z: total + z * z)
        error = F.greatest(F.col("_len") - kept, F.lit(0.0)) / F.lit(float(len(self.columns)))
        return encoded.select(row_id, "encoding", error.alias("error"))

    def score(self, df: DataFrame, row_id: str) -> DataFrame:
        return score_errors(self.errors(df, row_id), self.threshold)


def fit_autoencoder(df: DataFrame, columns: Sequence[str], row_id: str, encoding_dim: int = 32,
                    share: float = 0.95) -> LinearAutoencoder:
    columns = list(columns)
    k = encoding_dim if encoding_dim < len(columns) else max(1, len(columns) // 3)
    scaler = fit_scaler(df, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_x").transform(apply_scaler(df.select(*columns), scaler))
    model = LinearAutoencoder(columns, scaler, PCA(k=k, inputCol="_x", outputCol="_z").fit(vectors))
    model.threshold = error_threshold(model.errors(df, row_id), share=share)
    return model


@dataclass
class SequenceModel:
    """One linear regression per column on the rows of the window before."""

    key: str
    order: list[str]
    columns: list[str]
    length: int
    scaler: dict[str, tuple[float, float]]
    weights: list[list[float]]
    intercepts: list[float]
    threshold: float = 0.0

    def errors(self, df: DataFrame, hot=AUTO) -> DataFrame:
        """(key, order, error): mean squared error of the predicted next row; rows without a
        full window before them are absent."""
        out = _windows(df, self.key, self.order, self.columns, self.length, self.scaler, hot)
        parts = []
        for i, (weights, intercept) in enumerate(zip(self.weights, self.intercepts)):
            products = F.zip_with("_window", F.array(*map(F.lit, weights)), lambda x, w: x * w)
            guess = F.aggregate(products, F.lit(float(intercept)), lambda total, x: total + x)
            parts.append((guess - F.get("target", F.lit(i))) ** 2)
        error = reduce(add, parts) / F.lit(float(len(parts)))
        return out.select(self.key, *self.order, error.alias("error"))

    def score(self, df: DataFrame, hot=AUTO) -> DataFrame:
        """All rows of ``df``; error, score and flag are null before the first full window."""
        found = self.errors(df, hot)
        ids = [self.key, *self.order]
        return score_errors(df.select(*ids).join(found, ids, "left"), self.threshold)


def _windows(df, key, order, columns, length, scaler, hot) -> DataFrame:
    scaled = apply_scaler(df.select(key, *order, *columns), scaler)
    rows = sequences(scaled, key, order, columns, length, hot=hot)
    return rows.withColumn("_window", F.flatten("sequence"))


def covariances(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the numbers in the array ``column``, all arrays of one length; no rows: empty.

    One pass: every task adds up its rows to one square of the array's length, and Spark's sum adds the squares cell by
    cell, combined before the shuffle; only the finished square is fetched.
    """
    def task_sums(batches):
        total = 0
        for batch in batches:
            values = batch.column(0)
            if len(values):
                x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
                x = np.column_stack([np.ones(len(x)), x])
                total = total + x.T @ x
        if not np.isscalar(total):
            for i, line in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([line.tolist()])], ["i", "line"])

    lines = df.select(column).mapInArrow(task_sums, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "x"))
    cells = lines.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if not len(cells):
        return np.zeros(0), np.zeros((0, 0))
    n = int(cells["i"].max()) + 1
    sums = np.zeros((n, n))
    sums[cells["i"], cells["j"]] = cells["x"]
    mean = sums[0, 1:] / sums[0, 0]
    return mean, sums[1:, 1:] / sums[0, 0] - np.outer(mean, mean)


def fit_sequence_model(df: DataFrame, columns: Sequence[str], key: str, order: Sequence[str], length: int = 50,
                       share: float = 0.95, hot=AUTO, ridge: float = 1e-3) -> SequenceModel:
    """All columns are fitted from one pass over the windows, then the error threshold is set.

    Least squares with a penalty of ``ridge`` on the standardised weights; without any full window
    all weights are 0.
    """
    columns, order = list(columns), list(order)
    scaler = fit_scaler(df, columns)
    rows = _windows(df, key, order, columns, length, scaler, hot)
    mean, joint = covariances(rows.select(F.concat("_window", "target").alias("x")), "x")
    n = length * len(columns)
    weights = np.zeros((n, len(columns)))
    intercepts = np.zeros(len(columns))
    if len(mean):
        spread = np.diag(joint)[:n]
        penalty = np.where(spread > 0, ridge * spread, 1.0)
        weights = np.linalg.solve(joint[:n, :n] + np.diag(penalty), joint[:n, n:])
        intercepts = mean[n:] - mean[:n] @ weights
    model = SequenceModel(key, order, columns, length, scaler, weights.T.tolist(), intercepts.tolist())
    model.threshold = error_threshold(model.errors(df, hot), share=share)
    return model
