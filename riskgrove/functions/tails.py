"""Tail probabilities for small result tables, and the digamma function of counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

from riskgrove.functions.binning import as_column


def chi2_tail(x: float, k: float) -> float:
    """P(chi-square with k degrees of freedom > x), by the finite sums for whole k."""
    if x <= 0:
        return 1.0
    k = int(k)
    half = x / 2
    if k % 2 == 0:
        term, total = math.exp(-half), 0.0
        for i in range(k // 2):
            total += term
            term *= half / (i + 1)
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((k - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return total


def _chi2_batch(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, k)], dtype="float64")


def _normal_batch(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def chi2_upper(x: Column | str, k: Column | str) -> Column:
    tail = F.pandas_udf(_chi2_batch, "double")
    return tail(as_column(x), as_column(k).cast("double"))


def normal_two_sided(z: Column | str) -> Column:
    return F.pandas_udf(_normal_batch, "double")(as_column(z))


def digamma(x: Column | str) -> Column:
    """Digamma of a number above 0: ten steps of its recurrence, then the series for large numbers."""
    x = as_column(x).cast("double")
    z = x + 10
    steps = sum((1 / (x + i) for i in range(1, 10)), 1 / x)
    w = 1 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return F.log(z) - 0.5 / z - series - steps
