"""Compositions of operators that answer one request of the platform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import crossval, stats
from tickloom.session import cut_lineage


def cohort_deflated_sharpe(returns: DataFrame, key: str, universe: Sequence[str], hurdle: float = 0.0, q: float = 0.05,
                           method: str = "bh", periods: float = 252.0) -> DataFrame:
    """Deflated Sharpe of every strategy of a cohort with false-discovery certification.

    The trial count is the effective rank of the correlations, the trial variance the
    variance of the Sharpe ratios over the cohort.
    """
    # one row per strategy, read by several later steps
    mom = cut_lineage(stats.moments(returns, [key]))
    k = stats.effective_trials(stats.correlation_table(returns, universe, key)).select("k_eff").scalar()
    sharpe = F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std") * periods ** 0.5).otherwise(0.0)
    j = mom.withColumns({"k_eff": k, "var_sharpe": mom.agg(F.var_samp(sharpe)).scalar()})
    res = stats.deflated_sharpe(j, F.col("k_eff"), F.coalesce("var_sharpe", F.lit(0.0)), F.lit(hurdle), hurdle, periods=periods)
    res = cut_lineage(res.withColumn("p_value", F.greatest(F.lit(0.0), 1.0 - F.col("psr"))))
    adj = stats.fdr_adjust(res, "p_value", key, method, q)
    sure = F.col("status") == "CERTIFIED_SIGNIFICANT"
    status = F.when(sure & F.col("is_discovery"), "COHORT_FDR_CERTIFIED").when(sure, "FDR_REJECTED").otherwise(F.col("status"))
    return adj.withColumn("status", status).drop("k_eff", "var_sharpe", "rank")


def cv_deflated_sharpe(path_sharpes: DataFrame, returns: DataFrame, key: str, folds: crossval.Folds, periods: float = 252.0) -> DataFrame:
    """Deflated Sharpe with the path Sharpe variance, inflated for the overlap of splits."""
    rho = min(0.90, max(0.0, (folds.test_groups - 1) / (folds.groups - 1)))
    dist = cut_lineage(crossval.sharpe_distribution(path_sharpes))
    j = stats.moments(returns, [key]).withColumns({
        "paths": dist.select("paths").scalar(), "mean_sharpe": dist.select("mean_sharpe").scalar(),
        "_v": dist.select(F.col("var_sharpe") / max(0.10, 1.0 - rho)).scalar()})
    return stats.deflated_sharpe(j, F.col("paths"), F.col("_v"), F.col("mean_sharpe"), periods=periods).drop("_v")
