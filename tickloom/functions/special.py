"""Normal and Student-t functions that Spark lacks, as Arrow-batched column functions.

They are applied to one row per strategy or tail fit, never to the raw observations.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(-v / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or math.isnan(v) else _NORMAL.inv_cdf(min(max(v, 1e-15), 1.0 - 1e-15)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def t_cdf(nu: float, t: float) -> float:
    x = nu / (nu + t * t)
    a, b = nu / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0.0 < x < 1.0 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        tail = front * _beta_fraction(a, b, x) / a
    else:
        tail = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return 1.0 - 0.5 * tail if t >= 0 else 0.5 * tail


def t_quantile(nu: float, p: float) -> float:
    """Quantile by bisection on the distribution function."""
    lo, hi = -1.0, 1.0
    while t_cdf(nu, hi) < p:
        hi *= 2.0
    while t_cdf(nu, lo) > p:
        lo *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_cdf(nu, mid) < p else (lo, mid)
        if hi - lo <= 1e-14 * max(1.0, abs(hi)):
            break
    return 0.5 * (lo + hi)


def t_density(nu: float, t: float) -> float:
    log_c = math.lgamma((nu + 1.0) / 2.0) - math.lgamma(nu / 2.0) - 0.5 * math.log(nu * math.pi)
    return math.exp(log_c - 0.5 * (nu + 1.0) * math.log1p(t * t / nu))


@F.pandas_udf(T.StructType([T.StructField("q", T.DoubleType()), T.StructField("pdf", T.DoubleType())]))
def student_t(nu: pd.Series, p: pd.Series) -> pd.DataFrame:
    """Quantile at p and the density there, for nu degrees of freedom."""
    rows = []
    for v, a in zip(nu, p):
        if v is None or np.isnan(v):
            rows.append((None, None))
            continue
        q = t_quantile(v, a)
        rows.append((q, t_density(v, q)))
    return pd.DataFrame(rows, columns=["q", "pdf"])
