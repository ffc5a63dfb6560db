"""Distribution functions for summary rows: NumPy kernels and the Arrow UDFs over them.

They only ever see aggregated rows (one per group or test), never raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

DOUBLE = DoubleType()
INTERVAL = StructType([StructField("low", DOUBLE), StructField("high", DOUBLE)])


def _elementwise(fn, x):
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _lgamma(x):
    return _elementwise(math.lgamma, x)


def _erfc(x):
    return _elementwise(math.erfc, x)


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def norm_quantile(p):
    return _bisect(lambda z: 1.0 - norm_sf(z), p, -40.0, 40.0)


def _bisect(cdf, p, lo, hi, steps=200):
    """Invert an increasing function elementwise."""
    p = np.asarray(p, float)
    lo, hi = np.broadcast_to(lo, p.shape).copy(), np.broadcast_to(hi, p.shape).copy()
    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return 0.5 * (lo + hi)


def betainc(a, b, x):
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300
    inside = (z > 0) & (z < 1)
    zs = np.where(inside, z, 0.5)
    c = np.ones_like(zs)
    d = 1.0 - (p + q) * zs / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        even = m * (q - m) * zs / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * zs / ((p + 2 * m) * (p + 2 * m + 1))
        for num in (even, odd):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    front = np.exp(p * np.log(zs) + q * np.log1p(-zs) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    value = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1.0 - value, value)


def gammainc_upper(a, x):
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones_like(x)
    for i in np.ndindex(x.shape):
        s, v = float(a[i]), float(x[i])
        if not v > 0:
            out[i] = 1.0 if v <= 0 else math.nan
            continue
        scale = math.exp(-v + s * math.log(v) - math.lgamma(s))
        if v < s + 1:
            term = total = 1.0 / s
            k = s
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= v / k
                total += term
            out[i] = 1.0 - total * scale
        else:
            b = v + 1.0 - s
            c, d = 1e300, 1.0 / b
            h = d
            for k in range(1, 100_000):
                an = -k * (k - s)
                b += 2.0
                d = 1.0 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1.0) < 1e-15:
                    break
            out[i] = scale * h
    return out


def t_sf2(t, df):
    """Two-sided p-value of a t statistic."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_cdf(t, df):
    t = np.asarray(t, float)
    half = 0.5 * t_sf2(t, df)
    return np.where(t > 0, 1.0 - half, half)


def t_quantile(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    # p = 1 - tail/2 solved on the tail keeps precision far out
    tail = _bisect(lambda u: -t_sf2(np.sinh(u), df), -2.0 * np.minimum(p, 1.0 - p), 0.0, 200.0)
    return np.where(p >= 0.5, 1.0, -1.0) * np.sinh(tail)


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f > 0, betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(f, 0.0))), 1.0)


def chi2_sf(x, df):
    return gammainc_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


NODES, NODE_WEIGHTS = np.polynomial.legendre.leggauss(100)


def nct_cdf(t: float, df: float, ncp: float) -> float:
    """Non-central t CDF.

    The chance that a shifted normal stays below ``t`` times an independent chi over its root of df, integrated over
    the chi: a fixed number of nodes on both sides of the step and across it, whatever ``df`` and ``ncp`` are.
    """
    if t < 0:
        return 1.0 - nct_cdf(-t, df, -ncp)
    if t == 0:
        return float(norm_sf(ncp))
    if df < 10:
        return _nct_series(t, df, ncp)
    mode, reach = math.sqrt((df - 1.0) / df), 9.0 / math.sqrt(df)  # the density falls faster than a normal of this root
    first, last = max(0.0, mode - reach), mode + reach
    cuts = [first, *(min(max((ncp + side) / t, first), last) for side in (-9.0, 9.0)), last]
    half = np.diff(cuts) / 2.0
    s = ((np.array(cuts[:-1]) + half)[:, None] + half[:, None] * NODES).ravel()
    w = (half[:, None] * NODE_WEIGHTS).ravel()
    s, w = s[w > 0], w[w > 0]
    u = s - 1.0
    w = w * np.exp((df - 1.0) * np.log1p(u) - df * (u + u * u / 2.0))
    return float(np.sum(w * norm_sf(ncp - t * s)) / np.sum(w))


def _nct_series(t: float, df: float, ncp: float) -> float:
    """The CDF at ``t > 0`` as a Poisson-weighted sum of incomplete betas, started at the largest weight."""
    base = float(norm_sf(ncp))
    x = t * t / (t * t + df)
    lam = ncp * ncp / 2.0
    if lam == 0:
        return float(t_cdf(t, df))
    span = int(12 * math.sqrt(lam + 1) + 40)
    j = np.arange(max(0, int(lam) - span), int(lam) + span + 1, dtype=float)
    log_l = math.log(lam)
    p = np.exp(-lam + j * log_l - _lgamma(j + 1))
    q = ncp / math.sqrt(2.0) * np.exp(-lam + j * log_l - _lgamma(j + 1.5))
    total = np.sum(p * betainc(j + 0.5, df / 2.0, x) + q * betainc(j + 1.0, df / 2.0, x))
    return base + 0.5 * float(total)


def nct_limits(t: float, df: float, level: float = 0.95) -> tuple[float, float]:
    """Non-centrality values for which ``t`` is the upper and the lower tail bound."""
    out = []
    for prob in (0.5 + level / 2.0, 0.5 - level / 2.0):
        lo, hi = t - 6.0 - 0.5 * abs(t), t + 6.0 + 0.5 * abs(t)
        f_lo, f_hi = nct_cdf(t, df, lo) - prob, nct_cdf(t, df, hi) - prob  # decreasing in the non-centrality
        for _ in range(100):  # false position, halving the weight of a side that stays put
            mid = hi - f_hi * (hi - lo) / (f_hi - f_lo)
            f_mid = nct_cdf(t, df, mid) - prob
            if f_mid * f_hi < 0:
                lo, f_lo = hi, f_hi
            else:
                f_lo *= 0.5
            step, hi, f_hi = abs(mid - hi), mid, f_mid
            if step < 1e-11 * (1.0 + abs(mid)) or f_hi == 0:
                break
        out.append(hi)
    return out[0], out[1]


def rank_sum_exact_p(w: float, m: int, n: int) -> float:
    """Two-sided exact p-value of the Mann-Whitney count by counting subsets."""
    counts = np.zeros((m + 1, m * n + 1))
    counts[0, 0] = 1.0
    for top in range(1, m + n + 1):  # add rank `top` to subsets of growing size
        for size in range(min(top, m), 0, -1):
            shift = top - size
            if shift <= m * n:
                counts[size, shift:] += counts[size - 1, : m * n + 1 - shift]
    pmf = counts[m] / counts[m].sum()
    w = int(round(w))
    tail = pmf[w:].sum() if w > m * n / 2.0 else pmf[: w + 1].sum()
    return min(1.0, 2.0 * float(tail))


def _masked(fn, *series):
    """Apply ``fn`` where every argument is present; NULL elsewhere."""
    frame = pd.concat([s.astype("float64") for s in series], axis=1)
    ok = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if ok.any():
        out[ok] = fn(*(frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])))
    return pd.Series(out).where(~np.isnan(out), None).astype("Float64")


@pandas_udf(DOUBLE)
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: np.where(b > 0, t_sf2(a, np.where(b > 0, b, 1.0)), np.nan), t, df)


@pandas_udf(DOUBLE)
def t_quantile_of(p: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: np.where(b > 0, t_quantile(a, np.where(b > 0, b, 1.0)), np.nan), p, df)


@pandas_udf(DOUBLE)
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(f_sf, f, d1, d2)


@pandas_udf(DOUBLE)
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(chi2_sf, x, df)


@pandas_udf(DOUBLE)
def normal_p_value(z: pd.Series) -> pd.Series:
    return _masked(lambda a: 2.0 * norm_sf(np.abs(a)), z)


@pandas_udf(INTERVAL)
def noncentral_t_interval(t: pd.Series, df: pd.Series, level: pd.Series) -> pd.DataFrame:
    rows = [
        nct_limits(float(a), float(b), float(c)) if pd.notna(a) and pd.notna(b) and b > 0 else (None, None)
        for a, b, c in zip(t, df, level)
    ]
    return pd.DataFrame(rows, columns=["low", "high"], dtype="Float64")


@pandas_udf(DOUBLE)
def rank_sum_p_exact(w: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return _masked(
        lambda a, b, c: np.array([rank_sum_exact_p(x, int(y), int(z)) for x, y, z in zip(a, b, c)]), w, m, n
    )


def hedges_correction(df):
    """Small-sample factor J(df) of the standardised mean."""
    df = np.asarray(df, float)
    return np.exp(_lgamma(df / 2.0) - _lgamma((df - 1.0) / 2.0)) / np.sqrt(df / 2.0)


@pandas_udf(DOUBLE)
def hedges_j(df: pd.Series) -> pd.Series:
    return _masked(lambda a: np.where(a > 1, hedges_correction(np.where(a > 1, a, 2.0)), np.nan), df)


def normal_critical(level: float = 0.95) -> float:
    return float(norm_quantile(0.5 + level / 2.0))


def t_half_width(sem, n):
    """Half-width of the 95 % t interval from a standard error and a count column."""
    return t_quantile_of(F.lit(0.975), (n - 1).cast("double")) * sem
