"""Survival functions that Spark SQL lacks, as Arrow-batched functions of two or three columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_survival(x: float, df: int) -> float:
    """P(X > x) for chi-square with a whole number of degrees of freedom, by its finite sum."""
    if not x > 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * 2 * math.sqrt(half / math.pi)
        for k in range(3, df + 1, 2):
            total += term
            term *= x / k
        return min(1.0, total)
    total = term = math.exp(-half)
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return min(1.0, total)


def beta_regularized(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_survival(x: float, df1: int, df2: int) -> float:
    """P(X > x) for Fisher's F."""
    if not x > 0:
        return 1.0
    return beta_regularized(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if math.isfinite(x) else 0.0


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) or pd.isna(b) else chi2_survival(float(a), int(b)) for a, b in zip(x, df)], dtype=float)


@F.pandas_udf(DoubleType())
def f_sf(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) else f_survival(float(a), int(b), int(c)) for a, b, c in zip(x, df1, df2)], dtype=float)
