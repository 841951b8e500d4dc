"""Small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def ratio(top: Column, bottom: Column) -> Column:
    """``top / (bottom + 1e-6)``."""
    return top / (bottom + F.lit(EPS))


def entropy_from_counts(n: Column) -> Column:
    """Shannon entropy in nats of group counts ``n``, as one mergeable aggregate.

    With N = sum(n), -sum(p ln p) equals ln N - sum(n ln n) / N, so the total is not
    needed first.
    """
    total = F.sum(n)
    nats = F.ln(total) - F.sum(n * F.ln(n)) / total
    return F.greatest(F.coalesce(nats, F.lit(0.0)), F.lit(0.0))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def divide_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
