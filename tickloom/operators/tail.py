"""Tail risk: empirical, peaks-over-threshold and Student-t value at risk."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import special
from tickloom.functions.special import t_density, t_quantile
from tickloom.operators import blocks, series, stats


def empirical(losses: DataFrame, keys: Sequence[str], alpha: float = 0.99, value: str = "loss") -> DataFrame:
    """Linear-percentile VaR and mean of the losses at or above it."""
    q = stats.quantiles(losses, keys, value, {"var": alpha})
    return losses.join(q, list(keys)).groupBy(*keys, "var").agg(
        F.avg(F.when(F.col(value) >= F.col("var"), F.col(value))).alias("_m")
    ).select(*keys, "var", F.greatest(F.coalesce("_m", "var"), "var").alias("cvar"))


def thresholds(losses: DataFrame, keys: Sequence[str], k: float = 1.645, value: str = "loss") -> DataFrame:
    """Threshold μ + k·σ per key (sample deviation) with the count and moments."""
    x = F.col(value)
    return losses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mu"), F.stddev_samp(x).alias("sigma"),
    ).withColumn("threshold", F.col("mu") + k * F.col("sigma"))


def exceedances(losses: DataFrame, limits: DataFrame, keys: Sequence[str], value: str = "loss") -> DataFrame:
    """Losses above their key's threshold, measured from it."""
    return losses.join(limits, list(keys)).filter(F.col(value) > F.col("threshold")).withColumn(
        "excess", F.col(value) - F.col("threshold"))


def gpd_fit(excess: DataFrame, keys: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Generalised-Pareto shape and scale by probability-weighted moments, with a Hill guard.

    The order weights need only the rank of each excess, which a block scan along the
    value axis gives; tied values may swap ranks without changing the sums.
    A fit with infinite variance has status HALT and no parameters.
    """
    ranked = blocks.index_rows(excess, keys, ["excess"], blocks.Rows(), out="_i")
    size = excess.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_u"))
    j = ranked.join(size, list(keys))
    nu, i, y = F.col("n_u"), F.col("_i"), F.col("excess")
    top = F.least(F.greatest(F.lit(2), F.floor(0.10 * nu)), nu - 1)
    m = j.withColumn("_k", top).groupBy(*keys, "n_u", "_k").agg(
        F.avg(y).alias("m0"), F.sum((nu - i + 0.35) / (nu * nu) * y).alias("m1"),
        F.max(F.when(i == nu - F.col("_k"), y)).alias("_ref"),
        F.sum(F.when(i > nu - F.col("_k"), F.log(y))).alias("_logs"))
    hill = F.when((nu >= 3) & (F.col("_ref") > 0), F.col("_logs") / F.col("_k") - F.log("_ref"))
    d = F.col("m0") - 2.0 * F.col("m1")
    light = (d <= 1e-12) | (2.0 - F.try_divide(F.col("m0"), d) <= 0.0)
    xi = F.when(light, low).otherwise(2.0 - F.try_divide(F.col("m0"), d))
    beta = F.when(light, F.greatest("m0", F.lit(1e-8))).otherwise(F.greatest(F.try_divide(2.0 * F.col("m0") * F.col("m1"), d), F.lit(1e-8)))
    halt = F.coalesce(hill >= 1.0, F.lit(False)) | (xi >= high)
    return m.withColumn("_xi", xi).select(
        *keys, "n_u", F.when(halt, "HALT").otherwise("EVT_PWM").alias("fit"),
        F.when(~halt, F.least(F.greatest("_xi", F.lit(low)), F.lit(high))).alias("shape"), F.when(~halt, beta).alias("scale"))


def gpd_risk(shape: Column, scale: Column, threshold: Column, n: Column, n_u: Column, alpha: float) -> tuple[Column, Column]:
    z = n / n_u * (1.0 - alpha)
    tiny = shape <= 1e-6
    var = F.when(tiny, threshold - scale * F.log(z)).otherwise(threshold + scale / shape * (F.pow(z, -shape) - 1.0))
    cvar = F.when(tiny, var + scale).otherwise((var + scale - shape * threshold) / (1.0 - shape))
    return var, F.greatest(cvar, var)


def student_t_risk(losses: DataFrame, keys: Sequence[str], alpha: float = 0.99, value: str = "loss") -> DataFrame:
    """VaR and CVaR of a t distribution whose degrees of freedom match the kurtosis."""
    base = thresholds(losses, keys, value=value)
    m4 = losses.join(base.select(*keys, "mu", "sigma"), list(keys)).groupBy(*keys).agg(
        F.avg(F.pow(F.col(value) - F.col("mu"), 4)).alias("m4"))
    s4 = F.pow(F.col("sigma"), 4)
    g = F.col("m4") / s4 - 3.0
    raw = F.when((s4 > 1e-16) & (g > 0), 4.0 + F.try_divide(F.lit(6.0), g)).otherwise(100.0)
    fit = base.join(m4, list(keys)).withColumn("nu", F.greatest(F.lit(2.10), F.least(F.lit(100.0), raw)))
    fit = fit.withColumn("scale", F.greatest(F.col("sigma") * F.sqrt((F.col("nu") - 2.0) / F.col("nu")), F.lit(1e-8)))
    fit = fit.withColumn("_t", special.student_t(F.col("nu"), F.lit(alpha)))
    q = F.col("_t.q")
    factor = F.col("_t.pdf") / (1.0 - alpha) * ((F.col("nu") + q * q) / (F.col("nu") - 1.0))
    return fit.withColumn("var", F.col("mu") + F.col("scale") * q).withColumn(
        "cvar", F.greatest(F.col("mu") + F.col("scale") * factor, "var")).select(*keys, "n", "nu", "scale", "var", "cvar")


def evt_risk(losses: DataFrame, keys: Sequence[str], alpha: float = 0.99, k: float = 1.645, value: str = "loss") -> DataFrame:
    """Peaks-over-threshold VaR and CVaR per key."""
    limits = thresholds(losses, keys, k, value)
    fit = gpd_fit(exceedances(losses, limits, keys, value), keys)
    j = limits.join(fit, list(keys))
    var, cvar = gpd_risk(F.col("shape"), F.col("scale"), F.col("threshold"), F.col("n"), F.col("n_u"), alpha)
    return j.select(*keys, "n", "n_u", "fit", "threshold", "shape", "scale", var.alias("var"), cvar.alias("cvar"))


def risk_cascade(losses: DataFrame, keys: Sequence[str], alpha: float = 0.99, k: float = 1.645, value: str = "loss",
                 min_t: int = 30, min_evt: int = 250, min_excess: int = 15) -> DataFrame:
    """Method per key from its counts: empirical, peaks over threshold or Student-t."""
    limits = thresholds(losses, keys, k, value)
    over = exceedances(losses, limits, keys, value)
    fit = gpd_fit(over, keys)
    j = limits.join(fit, list(keys), "left").fillna({"n_u": 0})
    flat = F.col("sigma") <= 1e-12
    n, nu = F.col("n"), F.col("n_u")
    method = (
        F.when(flat | (n < min_t) | ((n >= min_evt) & (nu < 10)), "EMPIRICAL")
        .when((n >= min_evt) & (nu >= min_excess) & ((1.0 - alpha) < nu / n), F.coalesce("fit", F.lit("EVT_PWM")))
        .otherwise("STUDENT_T"))
    var_e, cvar_e = gpd_risk(F.col("shape"), F.col("scale"), F.col("threshold"), n, nu, alpha)
    chosen = j.withColumn("method", method).withColumns({"_ve": var_e, "_ce": cvar_e})
    emp = empirical(losses, keys, alpha, value).withColumnsRenamed({"var": "_v0", "cvar": "_c0"})
    stu = student_t_risk(losses, keys, alpha, value).select(*keys, F.col("var").alias("_vt"), F.col("cvar").alias("_ct"))
    out = chosen.join(emp, list(keys)).join(stu, list(keys))
    pick = lambda a, b, c: F.when(F.col("method") == "EMPIRICAL", F.col(a)).when(F.col("method") == "EVT_PWM", F.col(b)).when(
        F.col("method") == "STUDENT_T", F.col(c))
    return out.select(*keys, "n", "n_u", "method", "threshold", pick("_v0", "_ve", "_vt").alias("var"), pick("_c0", "_ce", "_ct").alias("cvar"))


def rolling_empirical(losses: DataFrame, capacity: int = 500, alpha: float = 0.99) -> DataFrame:
    """Empirical VaR and CVaR of the last ``capacity`` losses at every row with two or more."""
    seq = series.sequenced(losses)

    def first(f):
        w = f(1 - capacity, 0)
        return {"var": F.percentile("loss", F.lit(alpha)).over(w), "_win": F.collect_list("loss").over(w)}

    out = blocks.rolling(seq, ["symbol"], first, back=capacity, where=F.col("seq") >= 2)
    high = F.filter("_win", lambda x: x >= F.col("var"))
    mean = F.aggregate(high, F.lit(0.0), lambda a, x: a + x) / F.size(high)
    return out.withColumn("cvar", F.greatest(F.coalesce(mean, F.col("var")), F.col("var"))).drop("_win")


def window_risk(x: np.ndarray, alpha: float = 0.99, k: float = 1.645, min_t: int = 30, min_evt: int = 250, min_excess: int = 15) -> tuple[str, float, float]:
    """Method, VaR and CVaR of one window: the rules of :func:`risk_cascade`, NaN for a tail without variance."""
    n, mu, sigma = len(x), float(x.mean()), float(x.std(ddof=1))
    over = np.sort(x[x > mu + k * sigma]) - (mu + k * sigma)
    nu = len(over)
    if sigma <= 1e-12 or n < min_t or (n >= min_evt and nu < 10):
        var = float(np.percentile(x, 100.0 * alpha))
        return "EMPIRICAL", var, max(float(x[x >= var].mean()), var)
    if n >= min_evt and nu >= min_excess and 1.0 - alpha < nu / n:
        top = min(max(2, nu // 10), nu - 1)
        m0, m1 = over.mean(), ((nu - np.arange(1, nu + 1) + 0.35) * over).sum() / nu**2
        hill = np.log(over[-top:]).mean() - math.log(over[-top - 1]) if over[-top - 1] > 0 else 0.0
        d = m0 - 2.0 * m1
        shape, scale = (2.0 - m0 / d, 2.0 * m0 * m1 / d) if d > 1e-12 and 2.0 - m0 / d > 0.0 else (0.001, m0)
        if hill >= 1.0 or shape >= 0.999:
            return "HALT", math.nan, math.nan
        shape, scale, u = max(shape, 0.001), max(scale, 1e-8), mu + k * sigma
        var = u + scale / shape * ((n / nu * (1.0 - alpha)) ** -shape - 1.0)
        return "EVT_PWM", var, max((var + scale - shape * u) / (1.0 - shape), var)
    kurt = float(((x - mu) ** 4).mean()) / sigma**4 - 3.0 if sigma**4 > 1e-16 else 0.0
    dof = min(100.0, max(2.10, 4.0 + 6.0 / kurt)) if kurt > 0 else 100.0
    q = t_quantile(dof, alpha)
    scale = max(sigma * math.sqrt((dof - 2.0) / dof), 1e-8)
    var = mu + scale * q
    return "STUDENT_T", var, max(mu + scale * t_density(dof, q) / (1.0 - alpha) * (dof + q * q) / (dof - 1.0), var)


def rolling_cascade(losses: DataFrame, capacity: int = 500, alpha: float = 0.99) -> DataFrame:
    """The risk cascade over the last ``capacity`` losses at every row with two or more."""
    seq = series.sequenced(losses)
    wide = blocks.rolling(seq, ["symbol"], lambda f: {"_win": F.collect_list("loss").over(f(1 - capacity, 0))}, back=capacity, where=F.col("seq") >= 2)

    def run(batches):
        for pdf in batches:
            found = [window_risk(np.asarray(w, dtype=float), alpha) for w in pdf["_win"]]
            yield pdf[["symbol", "ts_ns"]].assign(**{c: [r[i] for r in found] for i, c in enumerate(("method", "var", "cvar"))})

    return wide.select("symbol", "ts_ns", "_win").mapInPandas(run, "symbol string, ts_ns long, method string, var double, cvar double")
