"""Combining detector scores, divergence from a baseline, zero-day evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowvigil.dims import DIVERGENCE_THRESHOLD, ENSEMBLE_THRESHOLD, ZERO_DAY_ANOMALY
from flowvigil.operators.context import fit_scaler


def ensemble_score(scores: Sequence[str]) -> Column:
    """Mean of the scores that are present; null when none is."""
    present = F.array_compact(F.array(*[F.col(s) for s in scores]))
    total = F.aggregate(present, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(present) > 0, total / F.size(present))


def soft_label(score: Column, threshold: float = ENSEMBLE_THRESHOLD) -> Column:
    return score > F.lit(threshold)


def hard_label(flags: Sequence[str]) -> Column:
    """Strict majority of the detectors."""
    votes = F.lit(0)
    for f in flags:
        votes = votes + F.coalesce(F.col(f), F.lit(False)).cast("int")
    return votes > F.lit(len(flags) / 2)


def combine(df: DataFrame, scores: Sequence[str], flags: Sequence[str]) -> DataFrame:
    out = df.withColumn("ensemble_score", ensemble_score(scores))
    return out.withColumns({"soft_anomaly": soft_label(F.col("ensemble_score")), "hard_anomaly": hard_label(flags)})


Baseline = Mapping[str, tuple[float, float]]


def fit_baseline(df: DataFrame, columns: Sequence[str]) -> Baseline:
    return fit_scaler(df, list(columns))


def z_scores(baseline: Baseline) -> list[Column]:
    return [(F.col(c) - F.lit(mean)) / F.lit(std + 1e-8) for c, (mean, std) in baseline.items()]


def divergence_of(z: Sequence[Column]) -> Column:
    """min(max |z| / 5, 1); 0 without any z-score."""
    sizes = [F.abs(one) for one in z]
    if not sizes:
        return F.lit(0.0)
    top = sizes[0] if len(sizes) == 1 else F.greatest(*sizes)
    return F.least(top / 5.0, F.lit(1.0))


def divergence(baseline: Baseline) -> Column:
    """min(max |z| / 5, 1) against the baseline; 0 without one."""
    return divergence_of(z_scores(baseline))


def zero_day(df: DataFrame, baseline: Baseline | Sequence[Column], anomaly: str = "anomaly_score",
             threshold: float = DIVERGENCE_THRESHOLD) -> DataFrame:
    """Divergence, zero-day flag, confidence and named indicators per row.

    ``baseline`` is one for all rows, or the z-scores of the row's own (``baselines.with_entity_z``).
    """
    z = z_scores(baseline) if isinstance(baseline, Mapping) else list(baseline)
    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out
    indicators = F.array_compact(F.array(
        F.when(any_of([c > 3 for c in z]), "extreme_statistical_outlier"),
        F.when(any_of([c < -3 for c in z]), "unusual_low_values")))
    out = df.withColumn("divergence", divergence_of(z))
    return out.withColumns({
        "is_zero_day": (F.col("divergence") > threshold) & (F.col(anomaly) > ZERO_DAY_ANOMALY),
        "zero_day_confidence": (F.col("divergence") + F.col(anomaly)) / 2, "indicators": indicators})
