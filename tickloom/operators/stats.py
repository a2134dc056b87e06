"""Moments, quantiles, performance and multiple-testing statistics per key."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import special
from tickloom.operators import blocks, series
from tickloom.operators.blocks import Running

# Fixed values.
EULER_GAMMA = 0.5772156649015329


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per key, one row per key.

    Values are first counted per (key, value), which combines map-side, so a value that
    fills a third of the rows is one row afterwards. Ranks come from a block scan over
    the counted values, in blocks bounded by rows. The order statistics next
    to each rank are then picked by conditional aggregates. No task sorts a whole key.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).filter(F.col(value).isNotNull())
    ranked = blocks.running(counted, keys, [value], blocks.Rows(), {"_before": Running("sum", F.col("_c"), inclusive=False)})
    ranked = ranked.withColumn("_before", F.coalesce("_before", F.lit(0)))
    totals = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(totals, list(keys))
    picks, outs = [], {}
    for name, p in probs.items():
        h = F.lit(p) * (F.col("_n") - 1)
        for tag, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}_{name}"))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        frac = F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
        outs[name] = lo + (hi - lo) * frac
    return joined.groupBy(*keys, "_n").agg(*picks).select(*keys, *[c.alias(n) for n, c in outs.items()])


def moments(returns: DataFrame, keys: Sequence[str], value: str = "ret", q: float = 0.005) -> DataFrame:
    """Winsorised mean, sample deviation, bias-corrected skewness and Pearson kurtosis.

    The kurtosis is at least 1 + skew² + 1e-6. Moments are central sums around the
    clipped mean, found in a first pass.
    """
    clip = quantiles(returns, keys, value, {"_ql": q, "_qh": 1.0 - q})
    clipped = returns.join(clip, list(keys)).withColumn("_x", F.least(F.greatest(F.col(value), "_ql"), "_qh")).select(*keys, "_x")
    center = clipped.groupBy(*keys).agg(F.avg("_x").alias("_mu"))
    dev = clipped.join(center, list(keys)).withColumn("_e", F.col("_x") - F.col("_mu"))
    agg = dev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("_mu").alias("mean"),
        *[F.avg(F.pow(F.col("_e"), k)).alias(f"_m{k}") for k in (2, 3, 4)])
    n, m2, m3, m4 = F.col("n"), F.col("_m2"), F.col("_m3"), F.col("_m4")
    std = F.sqrt(m2 * n / (n - 1))
    g1 = m3 / F.pow(m2, 1.5) * F.sqrt(n * (n - 1.0)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2)) - 3.0 * (n - 1)) + 3.0
    flat = std < 1e-12
    return (
        agg.withColumns({"std": F.when(flat, 0.0).otherwise(std), "skew": F.when(flat, 0.0).otherwise(g1)})
        .withColumn("kurtosis", F.when(flat, 3.0).otherwise(F.greatest(g2, 1.0 + F.col("skew") * F.col("skew") + 1e-6)))
        .select(*keys, "n", "mean", "std", "skew", "kurtosis")
    )


def sharpe_variance(sr: Column, skew: Column, kurt: Column) -> Column:
    k = F.greatest(kurt, 1.0 + skew * skew + 1e-6)
    return F.greatest(F.lit(1e-8), 1.0 - skew * sr + (k - 1.0) / 4.0 * sr * sr)


def probabilistic_sharpe(sr: Column, benchmark: Column, skew: Column, kurt: Column, n: Column, periods: float) -> Column:
    """Probability that the Sharpe ratio exceeds the benchmark; both annualised by √periods."""
    s, b = sr / math.sqrt(periods), benchmark / math.sqrt(periods)
    se = F.sqrt(sharpe_variance(s, skew, kurt) / (n - 1))
    return F.when(se < 1e-12, F.when(s >= b, 1.0).otherwise(0.0)).otherwise(special.normal_cdf((s - b) / se))


def expected_max_sharpe(trials: Column, variance: Column, mean: Column) -> Column:
    k = F.greatest(trials.cast("double"), F.lit(1.0))
    z = (1.0 - EULER_GAMMA) * special.normal_quantile(1.0 - 1.0 / k) + EULER_GAMMA * special.normal_quantile(1.0 - 1.0 / (k * math.e))
    return F.when((trials <= 1.0) | (variance <= 0.0), mean).otherwise(mean + F.sqrt(variance) * z)


def min_track_record(sr: Column, benchmark: Column, skew: Column, kurt: Column, periods: float, level: float = 0.95) -> Column:
    from statistics import NormalDist

    s, b = sr / math.sqrt(periods), benchmark / math.sqrt(periods)
    z = NormalDist().inv_cdf(level)
    need = 1.0 + sharpe_variance(s, skew, kurt) * F.pow(z / (s - b), 2)
    return F.when(s <= b, F.lit(float("inf"))).otherwise(F.greatest(F.lit(1.0), need))


def deflated_sharpe(mom: DataFrame, trials: Column, var_trials: Column, mean_trials: Column, hurdle: float = 0.0,
                    level: float = 0.95, periods: float = 252.0) -> DataFrame:
    """Sharpe statistics and status code per row of ``moments``."""
    flat = F.col("std") < 1e-12
    inf = F.lit(float("inf"))
    base = F.when(mean_trials != 0.0, mean_trials).otherwise(F.lit(hurdle))
    out = (
        mom.withColumn("sharpe", F.when(flat, 0.0).otherwise(F.col("mean") / F.col("std") * math.sqrt(periods)))
        .withColumn("expected_max", F.when(flat, F.lit(hurdle)).otherwise(expected_max_sharpe(trials, var_trials, base)))
    )
    args = (F.col("skew"), F.col("kurtosis"), F.col("n"))
    out = out.withColumns({
        "psr": F.when(flat, 0.0).otherwise(probabilistic_sharpe(F.col("sharpe"), F.lit(hurdle), *args, periods)),
        "dsr": F.when(flat, 0.0).otherwise(probabilistic_sharpe(F.col("sharpe"), F.col("expected_max"), *args, periods)),
        "min_length": F.when(flat, inf).otherwise(min_track_record(F.col("sharpe"), F.col("expected_max"), *args[:2], periods, level)),
        "trials": trials.cast("double"),
    })
    sure, long_enough = F.col("dsr") >= level, F.col("n") >= F.col("min_length")
    return out.withColumn("status", F.when(flat, "ZERO_VARIANCE_FLATLINE").when(sure & long_enough, "CERTIFIED_SIGNIFICANT")
                          .when(sure, "INSUFFICIENT_SAMPLE_LENGTH").when(F.col("sharpe") > F.col("expected_max"), "INSUFFICIENT_CONFIDENCE")
                          .otherwise("SELECTION_BIAS_REJECTED"))


def fdr_adjust(tests: DataFrame, p: str, id_col: str, method: str = "bh", q: float = 0.05) -> DataFrame:
    """Benjamini–Hochberg or –Yekutieli adjustment over the whole table.

    Ranks come from a block scan along the p axis, ties in p by id. The reverse running minimum runs on
    the mirrored rank, again block by block. The harmonic constant sums 1/rank.
    """
    keyed = tests.withColumn("_all", F.lit(0))
    ranked = blocks.index_rows(keyed, ["_all"], [p, id_col], blocks.Rows(), out="rank")
    scale = tests.agg(F.count(F.lit(1)).cast("double")).scalar()
    if method == "by":
        scale = scale * ranked.agg(F.sum(1.0 / F.col("rank"))).scalar()
    raw = ranked.withColumn("_raw", F.col(p) * scale / F.col("rank"))
    mirrored = raw.withColumn("_back", -F.col("rank"))
    low = blocks.running(mirrored, ["_all"], ["_back"], F.floor(F.col("_back") / 65_536).cast("long"), {"_low": Running("min", F.col("_raw"))})
    adjusted = F.least(F.greatest("_low", F.lit(0.0)), F.lit(1.0))
    return low.withColumn("adjusted_p", adjusted).withColumn("is_discovery", F.col("adjusted_p") <= q).drop(
        "_all", "_raw", "_back", "_low")


def pair_sums(returns: DataFrame, universe: Sequence[str], key: str = "symbol") -> DataFrame:
    """Cross sums of all pairs of a known universe from aligned long returns.

    Each timestamp becomes one vector (its size is the universe). Every task adds its
    vectors into one matrix product, and only those sums are shuffled: rows per task
    do not grow with the number of timestamps.
    """
    names = list(universe)
    n = len(names)
    at = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    vec = F.transform(F.array_sort(F.collect_list(F.struct(at[F.col(key)].alias("i"), F.col("ret").alias("r")))), lambda e: e["r"])
    rows = returns.filter(F.col(key).isin(names)).groupBy("ts_ns").agg(vec.alias("v")).filter(F.size("v") == n).select("v")

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, count = np.zeros((n, n)), np.zeros(n), 0
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["v"].to_numpy())
                total += x.T @ x
                sums += x.sum(axis=0)
                count += len(x)
        if count:
            i, j = np.triu_indices(n)
            yield pd.DataFrame({"i": i, "j": j, "sxy": total[i, j], "sx": sums[i], "sy": sums[j], "n": count,
                                "sxx": np.diag(total)[i], "syy": np.diag(total)[j]})

    parts = rows.mapInPandas(gram, "i long, j long, sxy double, sx double, sy double, n long, sxx double, syy double")
    summed = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sxy", "sx", "sy", "n", "sxx", "syy")])
    label = F.array(*[F.lit(s) for s in names])
    return summed.select(F.get(label, F.col("i")).alias("s1"), F.get(label, F.col("j")).alias("s2"),
                         "sxy", "sx", "sy", "n", "sxx", "syy")


def both_ways(pairs: DataFrame, swap: dict[str, str]) -> DataFrame:
    """Add the mirrored half; ``swap`` names columns that change places."""
    back = pairs.filter(F.col("s1") != F.col("s2")).select(*[F.col(swap.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(back)


_SWAP = {"s1": "s2", "s2": "s1", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "vol_1": "vol_2", "vol_2": "vol_1"}


def correlation_table(returns: DataFrame, universe: Sequence[str], key: str = "symbol", periods: float = 252.0) -> DataFrame:
    """Sample covariance, correlation and annualised volatility (percent) of every pair."""
    p = pair_sums(returns, universe, key)
    n = F.col("n")
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)
    vx = (F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1)
    vy = (F.col("syy") - F.col("sy") * F.col("sy") / n) / (n - 1)
    full = p.select("s1", "s2", cov.alias("covariance"), F.try_divide(cov, F.sqrt(vx * vy)).alias("correlation"),
                    (F.sqrt(F.greatest(vx, F.lit(0.0)) * periods) * 100.0).alias("vol_1"),
                    (F.sqrt(F.greatest(vy, F.lit(0.0)) * periods) * 100.0).alias("vol_2"))
    return both_ways(full, _SWAP)


def effective_trials(correlations: DataFrame) -> DataFrame:
    """K² / Σ C², clipped to [1, K]; undefined correlations count 0, the diagonal 1."""
    c = F.when(F.col("s1") == F.col("s2"), 1.0).otherwise(F.coalesce(F.nanvl("correlation", F.lit(0.0)), F.lit(0.0)))
    k = F.count(F.when(F.col("s1") == F.col("s2"), 1))
    return correlations.agg(k.alias("k"), F.least(F.greatest(k * k / F.sum(c * c), F.lit(1.0)), k.cast("double")).alias("k_eff"))


def shrunk_correlation(correlations: DataFrame, ridge: float = 0.05, min_std: float = 1e-8, periods: float = 252.0) -> DataFrame:
    """(1-λ)ρ + λ·1[i=j] with flat-line columns uncorrelated to everything."""
    flat = (F.col("vol_1") / 100.0 / math.sqrt(periods) < min_std) | (F.col("vol_2") / 100.0 / math.sqrt(periods) < min_std)
    rho = F.least(F.greatest(F.coalesce("correlation", F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return correlations.select("s1", "s2", F.when(F.col("s1") == F.col("s2"), 1.0).when(flat, 0.0).otherwise((1.0 - ridge) * rho).alias("rho"))


def tear_sheet(returns: DataFrame, key: str, risk_free: float = 0.0, periods: int = 252) -> DataFrame:
    """Performance metrics per key with the cited rounding.

    Deviations divide by n, Sortino uses CAGR. Keys with fewer than two returns or no
    variance are left out.
    """
    r = F.col("ret")
    rf = risk_free / periods
    q = quantiles(returns, [key], "ret", {"p5": 0.05, "p95": 0.95})
    curve = series.equity_curve(returns, key).groupBy(key).agg(
        F.min("drawdown").alias("mdd"), F.max("below_bars").alias("mdd_bars"))
    base = returns.join(q, key).groupBy(key, "p5", "p95").agg(
        F.count(F.lit(1)).alias("n"), F.product(r + 1.0).alias("eq"), F.stddev_pop(r).alias("sd"), F.avg(r - rf).alias("mx"),
        F.avg(F.pow(F.least(r - rf, F.lit(0.0)), 2)).alias("dv"), F.sum(F.greatest(r - rf, F.lit(0.0))).alias("pos"),
        F.sum(F.greatest(rf - r, F.lit(0.0))).alias("neg"), F.count(F.when(r > 0, 1)).alias("wins"),
        F.sum(F.when(r > 0, r)).alias("gain"), F.sum(F.when(r < 0, r)).alias("loss"), F.sum(r).alias("total"),
        F.avg(F.when(r <= F.col("p5"), r)).alias("tail"))
    root = math.sqrt(periods)
    cagr = F.when(F.col("eq") > 0, F.pow(F.col("eq"), periods / F.col("n")) - 1.0).otherwise(0.0)
    down = F.sqrt("dv") * root
    zero = F.lit(0.0)
    pain = F.abs(F.coalesce("loss", zero))
    j = base.join(curve, key).filter((F.col("n") >= 2) & (F.col("sd") >= 1e-8)).withColumn("cagr_raw", cagr)
    return j.select(
        key, F.round(F.col("eq") - 1.0, 4).alias("total_return"), F.round("cagr_raw", 4).alias("cagr"),
        F.round(F.col("sd") * root, 4).alias("annualized_volatility"),
        F.round(F.col("mx") / F.col("sd") * root, 3).alias("sharpe_ratio"),
        F.round(F.when(down > 1e-8, (F.col("cagr_raw") - risk_free) / down).otherwise(zero), 3).alias("sortino_ratio"),
        F.round(F.when(F.abs("mdd") > 1e-6, F.col("cagr_raw") / F.abs("mdd")).otherwise(zero), 3).alias("calmar_ratio"),
        F.round(F.when(F.col("neg") > 1e-8, F.col("pos") / F.col("neg")).otherwise(zero), 3).alias("omega_ratio"),
        F.round("mdd", 4).alias("max_drawdown"), F.col("mdd_bars").alias("max_drawdown_bars"),
        F.round(F.col("wins") / F.col("n"), 4).alias("win_rate"),
        F.round(F.when(pain > 1e-8, F.coalesce("gain", zero) / pain).otherwise(zero), 3).alias("profit_factor"),
        F.round(F.when(pain > 1e-8, F.col("total") / pain).otherwise(zero), 3).alias("gain_to_pain"),
        F.round(F.when(F.abs("p5") > 1e-8, F.abs(F.col("p95") / F.col("p5"))).otherwise(zero), 3).alias("tail_ratio"),
        F.round(F.abs("p5"), 4).alias("var_95"), F.round(F.abs(F.coalesce("tail", "p5")), 4).alias("cvar_95"),
        F.col("n").alias("bars"))


def monthly_matrix(returns: DataFrame, key: str) -> DataFrame:
    """Compounded return per UTC month, missing months 0, and the year's total."""
    ts = F.timestamp_micros(F.expr("ts_ns div 1000"))
    month = returns.groupBy(key, F.year(ts).alias("year"), F.month(ts).alias("m")).agg((F.product(F.col("ret") + 1.0) - 1.0).alias("x"))
    cols = [F.round(F.coalesce(F.max(F.when(F.col("m") == i, F.col("x"))), F.lit(0.0)), 4).alias(f"m{i:02d}") for i in range(1, 13)]
    return month.groupBy(key, "year").agg(*cols, F.round(F.product(F.col("x") + 1.0) - 1.0, 4).alias("ytd"))


def benchmark_relative(joined: DataFrame, key: str, periods: int = 252) -> DataFrame:
    """Alpha, beta, tracking error and information ratio of ret against bench per key.

    Beta divides a sample covariance by a population variance.
    """
    r, b = F.col("ret"), F.col("bench")
    a = joined.groupBy(key).agg(
        F.covar_samp(r, b).alias("cov"), F.var_pop(b).alias("vb"), F.avg(r).alias("mr"), F.avg(b).alias("mb"),
        F.stddev_pop(r - b).alias("sd"), F.avg(r - b).alias("md"))
    beta = F.col("cov") / F.col("vb")
    te = F.col("sd") * math.sqrt(periods)
    return a.filter(F.col("vb") > 1e-8).select(
        key, F.round((F.col("mr") - beta * F.col("mb")) * periods, 4).alias("alpha"), F.round(beta, 4).alias("beta"),
        F.round(te, 4).alias("tracking_error"),
        F.round(F.col("md") * math.sqrt(periods) / F.greatest(te, F.lit(1e-8)), 3).alias("information_ratio"))


def audit(records: DataFrame, key: str, initial: float, risk_free: float = 0.0, periods: float = 252.0) -> DataFrame:
    """Risk metrics of per-bar equity records (equity, drawdown, leverage, friction, tier).

    Sample deviations throughout, Sortino from the mean excess return.
    """
    seq = blocks.index_rows(records, [key], ["ts_ns"], blocks.time_block("ts_ns"))
    stepped = blocks.rolling(seq, [key], lambda f: {"_prev": F.coalesce(F.max("equity").over(f(-1, -1)), F.lit(initial))}, back=1)
    stepped = stepped.withColumn("ret", F.col("equity") / F.col("_prev") - 1.0)
    q = quantiles(stepped, [key], "ret", {"q01": 0.01, "q05": 0.05, "q95": 0.95})
    r, rf = F.col("ret"), risk_free / periods
    tiers = ["NORMAL", "CAUTION", "DERISK", "HALT"]
    a = stepped.join(q, key).groupBy(key, "q01", "q05", "q95").agg(
        F.count(F.lit(1)).alias("bars"), F.max_by("equity", "ts_ns").alias("last"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"),
        F.avg(F.pow(F.least(F.lit(0.0), r - rf), 2)).alias("dv"), F.max("drawdown").alias("mdd"),
        F.avg(F.when(r <= F.col("q05"), r)).alias("t95"), F.avg(F.when(r <= F.col("q01"), r)).alias("t99"),
        F.max("leverage").alias("peak_leverage"), F.sum("friction").alias("total_friction"),
        *[F.count(F.when(F.col("tier") == t, 1)).alias(f"{t.lower()}_bars") for t in tiers])
    root, zero = math.sqrt(periods), F.lit(0.0)
    flat, calm = F.col("sd") < 1e-12, F.sqrt("dv") < 1e-12
    mdd = F.least(F.lit(1.0), F.greatest(zero, "mdd"))
    cagr = F.pow(F.col("last") / initial, periods / F.col("bars")) - 1.0
    return a.select(
        key, "bars", (F.col("last") / initial - 1.0).alias("total_return"), cagr.alias("cagr"),
        F.when(flat, zero).otherwise(F.col("sd") * root).alias("annualized_volatility"),
        F.when(flat, zero).otherwise((F.col("m") - rf) / F.col("sd") * root).alias("sharpe_ratio"),
        F.when(calm, zero).otherwise((F.col("m") - rf) / F.sqrt("dv") * root).alias("sortino_ratio"),
        mdd.alias("max_drawdown"), F.when(mdd < 1e-12, zero).otherwise(cagr / mdd).alias("calmar_ratio"),
        (-F.col("q05")).alias("var_95"), F.greatest(-F.col("q05"), -F.col("t95")).alias("cvar_95"),
        (-F.col("q01")).alias("var_99"), F.greatest(-F.col("q01"), -F.col("t99")).alias("cvar_99"),
        F.when(F.abs("q05") >= 1e-12, F.greatest(zero, F.col("q95") / F.abs("q05"))).otherwise(zero).alias("tail_ratio"),
        "peak_leverage", "total_friction", *[f"{t.lower()}_bars" for t in tiers])


def benchmark_portfolios(returns: DataFrame, risk_free: float = 0.0, periods: float = 252.0, window: int = 20) -> DataFrame:
    """Equal-weight, trailing inverse-volatility, inverse-variance and cash return per bar.

    Normalised weights are ratios of two sums per timestamp, so they need no window over
    the cross-section.
    """
    seq = series.sequenced(returns)
    vol = blocks.rolling(seq, ["symbol"], lambda f: {"_s": F.stddev_samp("ret").over(f(-window, -1))}, back=window)
    full = returns.groupBy("symbol").agg(F.greatest(F.var_samp("ret"), F.lit(1e-12)).alias("_v"))
    w = vol.join(full, "symbol").withColumn("_iv", 1.0 / F.greatest("_s", F.lit(1e-12)))
    r = F.col("ret")
    trailing = F.when(F.max("seq") <= 2, F.avg(r)).otherwise(F.sum(F.col("_iv") * r) / F.sum("_iv"))
    wide = w.groupBy("ts_ns").agg(
        F.avg(r).alias("EqualWeight"), trailing.alias("RiskParity"),
        (F.sum(r / F.col("_v")) / F.sum(1.0 / F.col("_v"))).alias("InverseVolatility"))
    return wide.withColumn("Cash", F.lit(risk_free / periods)).unpivot(
        ["ts_ns"], ["EqualWeight", "RiskParity", "InverseVolatility", "Cash"], "benchmark", "bench")


def compare_benchmarks(strategy: DataFrame, benchmarks: DataFrame, risk_free: float = 0.0, periods: float = 252.0) -> DataFrame:
    """Strategy (ts_ns, ret) against every benchmark (ts_ns, benchmark, bench); sample statistics."""
    rf, root = risk_free / periods, math.sqrt(periods)
    j = strategy.select("ts_ns", "ret").join(benchmarks, "ts_ns")
    a = j.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.product(F.col("bench") + 1.0).alias("eq"), F.stddev_samp("bench").alias("sb"),
        F.avg("bench").alias("mb"), F.avg("ret").alias("mr"), F.covar_samp("ret", "bench").alias("cov"),
        F.var_samp("bench").alias("vb"), F.stddev_samp(F.col("ret") - F.col("bench")).alias("sd"),
        F.avg(F.col("ret") - F.col("bench")).alias("md"))
    curve = series.equity_curve(j.select("benchmark", "ts_ns", F.col("bench").alias("ret")), "benchmark")
    peak = F.greatest("peak", F.lit(1.0))
    dd = curve.groupBy("benchmark").agg(F.max((peak - F.col("equity")) / F.greatest(peak, F.lit(1e-12))).alias("mdd"))
    zero = F.lit(0.0)
    flat_b, flat_d = F.col("sb") < 1e-12, F.col("sd") < 1e-12
    beta = F.when(F.col("vb") < 1e-12, zero).otherwise(F.col("cov") / F.col("vb"))
    return a.join(dd, "benchmark").select(
        "benchmark", (F.col("eq") - 1.0).alias("total_return"),
        F.when(F.col("eq") <= 0, -1.0).otherwise(F.pow(F.col("eq"), periods / F.col("n")) - 1.0).alias("annualized_return"),
        F.when(flat_b, zero).otherwise(F.col("sb") * root).alias("annualized_volatility"),
        F.when(flat_b, zero).otherwise((F.col("mb") - rf) / F.col("sb") * root).alias("sharpe_ratio"),
        F.least(F.lit(1.0), F.greatest(zero, "mdd")).alias("max_drawdown"),
        (((F.col("mr") - rf) - beta * (F.col("mb") - rf)) * periods).alias("alpha"), beta.alias("beta"),
        F.when(flat_d, zero).otherwise(F.col("sd") * root).alias("tracking_error"),
        F.when(flat_d, zero).otherwise(F.col("md") / F.col("sd") * root).alias("information_ratio"))


def downside_variance(returns: DataFrame, key: str, target: float = 0.0, floor: float = 1e-8) -> DataFrame:
    return returns.groupBy(key).agg(F.greatest(F.avg(F.pow(F.least(F.lit(0.0), F.col("ret") - target), 2)), F.lit(floor)).alias("semi_variance"))


def forecast_losses(forecasts: DataFrame, penalty: float = 2.5) -> DataFrame:
    """Squared error plus a penalty for the wrong sign, per forecast and averaged per model."""
    p = F.col("prediction") / F.sqrt("horizon")
    loss = F.pow(F.col("ret") - p, 2) + penalty * F.greatest(F.lit(0.0), -F.col("ret") * p)
    return forecasts.groupBy("model").agg(F.avg(F.greatest(F.lit(0.0), loss)).alias("mean_loss"), F.count(F.lit(1)).alias("n"))


def epistemic_entropy(votes: DataFrame, sign_threshold: float = 1e-4, tiny: float = 1e-30) -> DataFrame:
    """Directional shares, normalised entropy, epistemic ratio and their composite per ts_ns.

    ``votes`` has ts_ns, prediction, weight (summing to 1 per ts_ns), aleatoric, epistemic.
    """
    p, w = F.col("prediction"), F.col("weight")
    a = votes.groupBy("ts_ns").agg(
        F.sum(F.when(p > sign_threshold, w).otherwise(0.0)).alias("p_pos"),
        F.sum(F.when(p < -sign_threshold, w).otherwise(0.0)).alias("p_neg"),
        F.sum(F.when(F.abs(p) <= sign_threshold, w).otherwise(0.0)).alias("p_neu"),
        F.first("aleatoric").alias("_a"), F.first("epistemic").alias("_e"))
    raw = sum((F.col(c) * F.log(F.col(c) + tiny) for c in ("p_pos", "p_neg", "p_neu")), F.lit(0.0))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return a.withColumns({
        "directional_entropy": clip(-raw / math.log(3.0)),
        "epistemic_ratio": clip(F.col("_e") / (F.col("_a") + F.col("_e"))),
    }).withColumn("composite_entropy", clip(F.col("directional_entropy") * F.sqrt("epistemic_ratio"))).drop("_a", "_e")


def shock_and_haircut(entropy: DataFrame, beta: Column, weights=(0.5, 0.3, 0.2), beta_range=(1.0, 5.0),
                      steepness: float = 10.0, midpoint: float = 0.5) -> DataFrame:
    """Composite shock in [0, 1] and the sigmoid haircut scaled to 1 at no shock and 0 at full."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    sig = lambda x: 1.0 / (1.0 + math.exp(steepness * (x - midpoint)))
    k0, k1 = sig(0.0), sig(1.0)
    nb = clip((beta - beta_range[0]) / (beta_range[1] - beta_range[0]))
    shock = clip(weights[0] * F.col("composite_entropy") + weights[1] * F.col("epistemic_ratio") + weights[2] * nb)
    s = F.col("shock")
    return entropy.withColumn("shock", shock).withColumn(
        "haircut", clip((1.0 / (1.0 + F.exp(steepness * (s - midpoint))) - k1) / (k0 - k1)))
