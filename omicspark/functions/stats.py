"""Distribution functions as Column expressions, and vectorised ones for what has no closed form."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function, by a continued fraction beyond 2 and a series below; relative error about 1e-14."""
    x = np.asarray(x, float)
    a = np.abs(x)
    term = a.copy()
    total = a.copy()
    small = np.minimum(a, 2.5)
    term, total = small.copy(), small.copy()
    for n in range(1, 80):
        term = -term * small * small / n
        total = total + term / (2 * n + 1)
    near = 1 - 2 / np.sqrt(np.pi) * total
    big = np.maximum(a, 1.5)
    f = np.zeros_like(big)
    for n in range(80, 0, -1):
        f = n / 2 / (big + f)
    far = np.exp(-big * big) / np.sqrt(np.pi) / (big + f)
    out = np.where(a < 2, near, far)
    return np.where(x < 0, 2 - out, out)


@F.pandas_udf(T.DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:
    x = z.to_numpy(float, na_value=np.nan)
    return pd.Series(np.where(np.isnan(x), np.nan, 0.5 * _erfc(x / np.sqrt(2)))).where(z.notna().to_numpy(), None)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution; null stays null."""
    return F.when(z.isNotNull(), _normal_sf(z))


def normal_cdf(z: Column) -> Column:
    return normal_sf(-z)


def two_sided_p(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_sf(F.abs(z)))


def _gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lg = log_gamma(a)
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - lg)
        term = 1 / a
        total = term.copy()
        for n in range(1, 500):
            term = term * x / (a + n)
            total = total + term
        lower = front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 300):
            an = -n * (n - a)
            b = b + 2
            d = 1 / np.where(an * d + b == 0, 1e-300, an * d + b)
            c = np.where(b + an / c == 0, 1e-300, b + an / c)
            h = h * d * c
        upper = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - lower, upper))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series after moving the argument above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = shift + np.where(low, np.log(np.where(low, y, 1)), 0)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    return pd.Series(_gamma_q(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


def _beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(y, 1e-300)) + q * np.log(np.maximum(1 - y, 1e-300))) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
        out = np.where(y <= 0, 0.0, front * h)
    return np.where(turn, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t; nan stays nan."""
    x, n = t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    ok = np.isfinite(x) & np.isfinite(n) & (n > 0)
    n, x = np.where(ok, n, 1.0), np.where(ok, x, 0.0)
    return pd.Series(np.where(ok, _beta_i(n / 2, np.full_like(n, 0.5), n / (n + x * x)), np.nan))


def t_quantile(p: float, df: float) -> float:
    """The upper half's quantile of Student's t (p at least 0.5), by bisection of its tail."""
    tail = lambda x: 0.5 * float(_beta_i(df / 2, 0.5, df / (df + x * x)))
    low, high = 0.0, 1.0
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
    return (low + high) / 2


@functools.lru_cache(maxsize=256)
def _u_counts(n0: int, n1: int) -> tuple[np.ndarray, int]:
    """How many of the arrangements of n0 and n1 different values have U = 0, 1, ... up to half of n0 n1, and how many
    there are. One more value of the smaller group multiplies the generating function by (1 - q^(n + i)) / (1 - q^i)."""
    few, many = min(n0, n1), max(n0, n1)
    half = n0 * n1 // 2
    counts = np.zeros(half + 1, object)
    counts[0] = 1
    for i in range(1, few + 1):
        if many + i <= half:
            counts[many + i :] = counts[many + i :] - counts[: -(many + i)].copy()
        for r in range(min(i, half + 1)):
            counts[r::i] = np.cumsum(counts[r::i])
    return np.cumsum(counts), math.comb(n0 + n1, n0)


@F.pandas_udf(T.DoubleType())
def mann_whitney_exact_p(u: pd.Series, n0: pd.Series, n1: pd.Series) -> pd.Series:
    """Two-sided exact p of U for groups of different values; null where a number is missing or a group is empty."""
    out = np.full(len(u), np.nan)
    x, a, b = (v.to_numpy(float, na_value=np.nan) for v in (u, n0, n1))
    ok = np.isfinite(x) & (a > 0) & (b > 0)
    for m, n in {(int(i), int(j)) for i, j in zip(a[ok], b[ok], strict=True)}:
        own = np.flatnonzero(ok & (a == m) & (b == n))
        upto, total = _u_counts(m, n)
        least = np.minimum(x[own], m * n - x[own]).astype(np.int64)
        out[own] = [min(1.0, float(2 * int(upto[i]) / total)) if i >= 0 else np.nan for i in least]
    return pd.Series(out).where(~np.isnan(out), None)
