"""Special functions on numpy arrays, and p-value Columns over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series from 10 on, the recurrence below."""
    x = np.asarray(x, float)
    low, down = x < 10, 0.0
    if low.any():
        steps = x[..., None] + np.arange(10) if x.ndim else x + np.arange(10)
        down = np.where(low, np.log(np.where(low[..., None], steps, 1.0)).sum(axis=-1), 0.0)
    y = np.where(low, x + 10, x)
    series, square = 0.0, 1 / (y * y)
    for c in reversed(STIRLING):
        series = series * square + c
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series / y - down


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers from 0 on: its series below 2, its continued fraction from there."""
    x = np.asarray(x, float)
    near = np.minimum(x, 2.0)
    term = 2 / math.sqrt(math.pi) * near * np.exp(-near * near)
    total = np.zeros_like(x)
    for n in range(60):
        total = total + term
        term = term * 2 * near * near / (2 * n + 3)
    far = np.maximum(x, 2.0)
    tail = far
    for k in range(150, 0, -1):
        tail = far + k / 2 / tail
    with np.errstate(under="ignore"):
        return np.where(x < 2, 1 - total, np.exp(-far * far) / math.sqrt(math.pi) / tail)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return erfc(np.abs(z) / math.sqrt(2))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.clip(np.where(y <= 0, 0.0, front * h), 0, 1)
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection."""
    low, high = 0.0, 1.0
    cdf = lambda v: float(beta_inc(d1 / 2, d2 / 2, d1 * v / (d1 * v + d2)))
    while cdf(high) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def trigamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total += 1 / x**2
        x += 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9)


def _normal_series(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.fillna(0).to_numpy())).astype("Float64").where(~z.isna().to_numpy())


def _t_series(t: pd.Series, df: pd.Series) -> pd.Series:
    bad = (t.isna() | df.isna()).to_numpy()
    return pd.Series(t_two_sided(t.fillna(0).to_numpy(), df.fillna(1).to_numpy())).astype("Float64").where(~bad)


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value; null for null."""
    return F.pandas_udf(_normal_series, "double")(z.cast("double"))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided Student p-value; null for null."""
    return F.pandas_udf(_t_series, "double")(t.cast("double"), df.cast("double"))
