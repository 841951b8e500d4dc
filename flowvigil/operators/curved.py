"""Reconstruction errors of an autoencoder whose decoder has a tanh hidden layer.

The encoder and the straight part of the decoder start at the principal components and the
bent part at 0, so training starts from the error of ``LinearAutoencoder`` and lowers it; of
all steps the parameters with the lowest error are kept. A step is one pass: every task adds
the gradient of its rows in numpy, Spark's sum adds the tasks' gradients cell by cell, and only
the parameters (a few thousand numbers, none of which grow with the data) are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.operators.context import fit_scaler
from flowvigil.operators.reconstruction import covariances, error_threshold, score_errors
from flowvigil.session import materialise

PARTS = ("encode", "straight", "bend_in", "bend_shift", "bend_out", "shift")


def forward(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(encoding, hidden layer, reconstruction) of rows ``x``."""
    z = x @ p["encode"].T
    hidden = np.tanh(z @ p["bend_in"].T + p["bend_shift"])
    return z, hidden, z @ p["straight"].T + hidden @ p["bend_out"].T + p["shift"]


def loss_and_gradient(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Squared error summed over rows, averaged over columns, and its gradient."""
    z, hidden, guess = forward(x, p)
    residual = guess - x
    g = 2 * residual / x.shape[1]
    bent = (g @ p["bend_out"]) * (1 - hidden ** 2)
    g_z = g @ p["straight"] + bent @ p["bend_in"]
    return float((residual ** 2).sum() / x.shape[1]), {
        "encode": g_z.T @ x, "straight": g.T @ z, "bend_in": bent.T @ z, "bend_shift": bent.sum(0), "bend_out": g.T @ hidden, "shift": g.sum(0)}


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in PARTS])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in PARTS:
        out[name] = flat[at:at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    return out


def gradient_over(vectors: DataFrame, p: dict[str, np.ndarray]) -> tuple[int, float, dict[str, np.ndarray]]:
    """(rows, mean loss, gradient of the mean loss) over the array column ``x`` of all rows."""
    width = p["shift"].size

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(x):
                loss, gradient = loss_and_gradient(x, p)
                part = np.concatenate([[len(x), loss], _flat(gradient)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    cells = vectors.select("x").mapInArrow(of_task, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    found = cells.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(2 + _flat(p).size)
    sums[found["i"]] = found["v"]
    rows = int(sums[0])
    return rows, sums[1] / max(rows, 1), _shaped(sums[2:] / max(rows, 1), p)


def _numbers(columns: Sequence[str]) -> Column:
    """The columns as one array; null where one of them is null or not finite."""
    numbers = F.array(*[F.col(c).cast("double") for c in columns])
    return F.when(F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), numbers)


def _scaled(numbers: Column, scaler: dict[str, tuple[float, float]]) -> Column:
    means = F.array(*[F.lit(float(m)) for m, _ in scaler.values()])
    factors = F.array(*[F.lit(1.0 / d if d else 0.0) for _, d in scaler.values()])
    return F.zip_with(F.zip_with(numbers, means, lambda v, m: v - m), factors, lambda v, f: v * f)


@dataclass
class CurvedAutoencoder:
    """``encode`` to few numbers, and back by a straight part and a tanh hidden layer."""

    columns: list[str]
    scaler: dict[str, tuple[float, float]]
    encode: np.ndarray
    straight: np.ndarray
    bend_in: np.ndarray
    bend_shift: np.ndarray
    bend_out: np.ndarray
    shift: np.ndarray
    threshold: float | None = None

    def errors(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, encoding, error): mean squared error of the reconstruction; nulls where a column has no number."""
        p = {name: getattr(self, name) for name in PARTS}

        @F.pandas_udf("encoding array<double>, error double")
        def rebuild(vectors: pd.Series) -> pd.DataFrame:
            encodings, errors = np.full(len(vectors), None, object), np.full(len(vectors), np.nan)
            there = np.flatnonzero(vectors.notna())
            if len(there):
                x = np.stack(vectors.iloc[there].to_numpy())
                z, _, guess = forward(x, p)
                errors[there] = ((guess - x) ** 2).mean(1)
                for i, row in zip(there, z):
                    encodings[i] = row
            return pd.DataFrame({"encoding": encodings, "error": errors})

        rows = df.select(row_id, rebuild(_scaled(_numbers(self.columns), self.scaler)).alias("_r"))
        return rows.select(row_id, "_r.encoding", F.nanvl("_r.error", F.lit(None)).alias("error"))

    def score(self, df: DataFrame, row_id: str) -> DataFrame:
        return score_errors(self.errors(df, row_id), float("nan") if self.threshold is None else self.threshold)


def first_parameters(mean: np.ndarray, joint: np.ndarray, size: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Principal components of the covariances ``joint``, and a hidden layer without effect yet."""
    values, directions = np.linalg.eigh(joint)
    leading = directions[:, ::-1][:, :size]
    spread = np.sqrt(np.maximum(values[::-1][:size], 1e-12))
    rng = np.random.default_rng(seed)
    return {"encode": leading.T.copy(), "straight": leading.copy(), "bend_in": rng.normal(size=(hidden, size)) / spread / np.sqrt(size),
            "bend_shift": rng.normal(size=hidden), "bend_out": np.zeros((len(mean), hidden)), "shift": mean - leading @ (leading.T @ mean)}


def fit_curved_autoencoder(df: DataFrame, columns: Sequence[str], row_id: str, encoding_dim: int = 32, hidden: int = 32,
                           steps: int = 60, rate: float = 0.01, share: float = 0.95, seed: int = 42) -> CurvedAutoencoder:
    """``steps`` steps of adaptive gradient descent over all rows, then the error threshold.

    Rows with a null, NaN or infinite column are left out of the fit and get null errors. Without any
    other row the parameters are 0 and the threshold None.
    """
    columns = list(columns)
    size = encoding_dim if encoding_dim < len(columns) else max(1, len(columns) // 3)
    # one array from here on: a filter over many renamed columns makes the planner slow
    numbers = materialise(df.select(_numbers(columns).alias("n"))).where(F.col("n").isNotNull())
    scaler = fit_scaler(numbers.select(*[F.get("n", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns)
    vectors = numbers.select(_scaled(F.col("n"), scaler).alias("x"))
    mean, joint = covariances(vectors, "x")
    if not len(mean):
        d = len(columns)
        nothing = {"encode": np.zeros((size, d)), "straight": np.zeros((d, size)), "bend_in": np.zeros((hidden, size)),
                   "bend_shift": np.zeros(hidden), "bend_out": np.zeros((d, hidden)), "shift": np.zeros(d)}
        return CurvedAutoencoder(columns, scaler, **nothing)
    now = first_parameters(mean, joint, size, hidden, seed)
    best, lowest = now, np.inf
    first, second = np.zeros(_flat(now).size), np.zeros(_flat(now).size)
    for step in range(1, steps + 2):
        _, loss, gradient = gradient_over(vectors, now)
        if loss < lowest:
            best, lowest = now, loss
        if step <= steps:
            g = _flat(gradient)
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
            now = _shaped(_flat(now) - move, now)
    model = CurvedAutoencoder(columns, scaler, **best)
    model.threshold = error_threshold(model.errors(df, row_id), share=share)
    return model
