"""Tail probabilities, for the few rows of a report: vectorised Python functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, on the side where that converges fast."""
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularized_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    out = d
    for k in range(1, 400):
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            out *= change
        if abs(change - 1.0) < 1e-14:
            break
    return front * out


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided probability of a correlation from n pairs if there is none; null below three pairs."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    freedom = n - 2
    t2 = r * r * freedom / (1.0 - r * r)
    return regularized_beta(freedom / 2.0, 0.5, freedom / (freedom + t2))


def correlation_p_value(r: Column, n: Column) -> Column:
    """``correlation_p`` of columns."""
    def values(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(rs, ns, strict=True)], dtype="float64")

    return F.pandas_udf(values, "double")(r, n)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    def values(zs: pd.Series) -> pd.Series:
        return zs.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")

    return F.pandas_udf(values, "double")(z)
