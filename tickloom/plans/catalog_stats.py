"""Registered queries: moments, performance, multiple testing and tail risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import series, stats, tail
from tickloom.plans import sqltext as S
from tickloom.plans.catalog_series import CURVE, rounded, small_returns
from tickloom.sources import feeds
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
U = S.UNIVERSE


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


SMALL = f"{S.aligned()}, small AS (SELECT symbol, ts_ns, ret / 100 AS ret FROM aligned)"


def daily_returns(spark, d):
    """Daily strategy returns: demeaned mean event value per user and day, over 1000."""
    t = fx.ticks(spark, d)
    day = (F.expr("ts_ns div 86400000000000") * 86_400_000_000_000).alias("ts_ns")
    return t.groupBy(F.concat(F.lit("u"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("strategy"), day).agg(
        ((F.avg("price") - 48.0) / 1000.0).alias("ret"))


DAILY = """daily AS (SELECT 'u' || lpad((user_id % 20)::VARCHAR, 2, '0') AS strategy, (epoch_us(ts) * 1000 // 86400000000000) * 86400000000000 AS ts_ns,
  (avg(value) - 48.0) / 1000.0 AS ret FROM events GROUP BY 1, 2)"""
MOMENTS = f"""{DAILY}, q AS (SELECT strategy, quantile_cont(ret, 0.005) AS ql, quantile_cont(ret, 0.995) AS qh FROM daily GROUP BY 1),
cl AS (SELECT strategy, least(greatest(ret, ql), qh) AS x FROM daily JOIN q USING (strategy)),
mu AS (SELECT strategy, avg(x) AS mean, count(*) AS n FROM cl GROUP BY 1),
dv AS (SELECT strategy, mean, n, avg(pow(x - mean, 2)) AS m2, avg(pow(x - mean, 3)) AS m3, avg(pow(x - mean, 4)) AS m4 FROM cl JOIN mu USING (strategy) GROUP BY 1, 2, 3),
mo AS (SELECT strategy, n, mean, sqrt(m2 * n / (n - 1)) AS std, m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) AS skew,
  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (m2 * m2) - 3.0 * (n - 1)) + 3.0 AS g2 FROM dv),
mom AS (SELECT strategy, n, mean, std, skew, greatest(g2, 1 + skew * skew + 1e-6) AS kurtosis FROM mo)"""


@query("winsorised_moments", f"WITH {MOMENTS} SELECT strategy, n, round(mean, 8) AS mean, round(std, 8) AS std, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis FROM mom")
def _(spark, d):
    return rounded(rounded(stats.moments(daily_returns(spark, d), ["strategy"]), 8, "mean", "std"), 6, "skew", "kurtosis")


def _moments(spark, d):
    return stats.moments(daily_returns(spark, d), ["strategy"])


def _phi(x: str) -> str:
    """The normal distribution function by its series in odd powers."""
    term = f"pow({x}, 2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2.0::DOUBLE) - lgamma(k + 1))"
    inner = f"0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {term}))"
    return f"(CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE {inner} END)"


def _quantile(p: str) -> str:
    """The normal quantile by sixty halvings of an interval."""
    mid = "((a['lo'] + a['hi']) / 2)"
    step = f"CASE WHEN {_phi(mid)} < {p} THEN {{'lo': {mid}, 'hi': a['hi']}} ELSE {{'lo': a['lo'], 'hi': {mid}}} END"
    return f"list_reduce([{{'lo': -8.0::DOUBLE, 'hi': 8.0::DOUBLE}}] || list_transform(range(0, 60), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}}), lambda a, b: {step})['lo']"


def _hurdle(trials: str, variance: str, mean: str) -> str:
    z = f"(1 - {stats.EULER_GAMMA}) * {_quantile(f'(1 - 1 / {trials})')} + {stats.EULER_GAMMA} * {_quantile(f'(1 - 1 / ({trials} * exp(1.0::DOUBLE)))')}"
    return f"CASE WHEN {trials} <= 1 OR {variance} <= 0 THEN {mean} ELSE {mean} + sqrt({variance}) * ({z}) END"


RATIO = "s AS (SELECT *, mean / std AS sr FROM mom), v AS (SELECT *, greatest(1e-8, 1 - skew * sr + (greatest(kurtosis, 1 + skew * skew + 1e-6) - 1) / 4 * sr * sr) AS vt FROM s)"


@query("probabilistic_sharpe", f"""WITH {MOMENTS}, {RATIO}, z AS (SELECT strategy, sr, sr / sqrt(vt / (n - 1)) AS z FROM v)
SELECT strategy, round(sr * sqrt(252.0), 6) AS sharpe, round({_phi('z')}, 6) AS psr FROM z""")
def _(spark, d):
    m = _moments(spark, d).withColumn("sharpe", F.col("mean") / F.col("std") * 252.0 ** 0.5)
    psr = stats.probabilistic_sharpe(F.col("sharpe"), F.lit(0.0), F.col("skew"), F.col("kurtosis"), F.col("n"), 252.0)
    return m.select("strategy", F.round("sharpe", 6).alias("sharpe"), F.round(psr, 6).alias("psr"))


@query("expected_max_sharpe", f"""WITH {MOMENTS}, {RATIO}, a AS (SELECT count(*) AS k, var_samp(sr) AS v, avg(sr) AS m FROM s), t AS (SELECT CAST(unnest(range(1, k + 1)) AS BIGINT) AS trials, v, m FROM a),
d AS (SELECT trials, trials::DOUBLE AS x, v, m FROM t) SELECT trials, round({_hurdle('x', 'v', 'm')}, 6) AS hurdle FROM d""")
def _(spark, d):
    """Hurdle for 1..n strategies tried, with the variance of their Sharpe ratios."""
    m = _moments(spark, d).select("strategy", (F.col("mean") / F.col("std")).alias("s"))
    a = m.agg(F.count(F.lit(1)).alias("k"), F.var_samp("s").alias("v"), F.avg("s").alias("m"))
    steps = a.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("trials"), "v", "m")
    return steps.select("trials", F.round(stats.expected_max_sharpe(F.col("trials"), F.col("v"), F.col("m")), 6).alias("hurdle"))


@query("min_track_record", f"""WITH {MOMENTS}, s AS (SELECT *, mean / std AS sr FROM mom), v AS (SELECT *,
  greatest(1e-8, 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) AS vt FROM s)
SELECT strategy, CASE WHEN sr <= 0.01 THEN 'inf'::DOUBLE ELSE round(greatest(1, 1 + vt * pow(1.6448536269514722 / (sr - 0.01), 2)), 4) END AS min_length FROM v""")
def _(spark, d):
    sr = F.col("mean") / F.col("std") * 252.0 ** 0.5
    need = stats.min_track_record(sr, F.lit(0.01 * 252.0 ** 0.5), F.col("skew"), F.col("kurtosis"), 252.0)
    return _moments(spark, d).select("strategy", F.round(need, 4).alias("min_length"))


def _square_corr(source: str) -> str:
    return f"""pc AS (SELECT a.symbol AS s1, b.symbol AS s2, corr(a.ret, b.ret) AS correlation, covar_samp(a.ret, b.ret) AS covariance,
  sqrt(greatest(0, var_samp(a.ret)) * 252.0) * 100 AS vol_1, sqrt(greatest(0, var_samp(b.ret)) * 252.0) * 100 AS vol_2
  FROM {source} a JOIN {source} b ON a.ts_ns = b.ts_ns GROUP BY 1, 2)"""


PAIRS = f"{SMALL}, {_square_corr('small')}"


@query("correlation_table", f"WITH {PAIRS} SELECT s1, s2, round(covariance, 6) AS covariance, round(correlation, 6) AS correlation, round(vol_1, 4) AS vol_1, round(vol_2, 4) AS vol_2 FROM pc")
def _(spark, d):
    c = stats.correlation_table(small_returns(spark, d), U)
    return rounded(rounded(c, 6, "covariance", "correlation"), 4, "vol_1", "vol_2")


@query("effective_trials", f"WITH {PAIRS} SELECT 5::BIGINT AS k, round(least(5, greatest(1, 25 / sum(correlation * correlation))), 6) AS k_eff FROM pc")
def _(spark, d):
    return rounded(stats.effective_trials(stats.correlation_table(small_returns(spark, d), U)), 6, "k_eff")


@query("shrunk_correlation", f"WITH {PAIRS} SELECT s1, s2, round(CASE WHEN s1 = s2 THEN 1 ELSE 0.95 * correlation END, 6) AS rho FROM pc")
def _(spark, d):
    return rounded(stats.shrunk_correlation(stats.correlation_table(small_returns(spark, d), U)), 6, "rho")


FDR = """WITH p AS (SELECT event_id, least(1.0::DOUBLE, value / 400.0) * least(1.0::DOUBLE, value / 400.0) AS p FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS rank FROM p), k AS (SELECT count(*) * {h} AS scale FROM r),
a AS (SELECT event_id, rank, p * (SELECT scale FROM k) / rank AS raw FROM r),
b AS (SELECT event_id, rank, least(1.0::DOUBLE, min(raw) OVER (ORDER BY rank DESC)) AS adj FROM a)
SELECT event_id, rank, round(adj, 8) AS adjusted_p, adj <= 0.05 AS is_discovery FROM b"""


def _fdr(spark, d, method):
    x = F.least(F.lit(1.0), F.col("price") / 400.0)
    t = fx.ticks(spark, d).select("event_id", (x * x).alias("p"))
    return rounded(stats.fdr_adjust(t, "p", "event_id", method).select("event_id", "rank", "adjusted_p", "is_discovery"), 8, "adjusted_p")


query("fdr_bh", FDR.format(h="1.0::DOUBLE"))(lambda spark, d: _fdr(spark, d, "bh"))
query("fdr_by", FDR.format(h="sum(1.0::DOUBLE / rank)"))(lambda spark, d: _fdr(spark, d, "by"))


@query("deflated_sharpe", f"""WITH {MOMENTS}, {RATIO}, h AS (SELECT {_hurdle('x', '0.5::DOUBLE', '0.0::DOUBLE')} AS top FROM (SELECT 20.0::DOUBLE AS x)),
z AS (SELECT *, sr * sqrt(252.0) AS sharpe, sr / sqrt(vt / (n - 1)) AS z0, (sr - top / sqrt(252.0)) / sqrt(vt / (n - 1)) AS z1,
  CASE WHEN sr <= top / sqrt(252.0) THEN 'inf'::DOUBLE ELSE greatest(1, 1 + vt * pow(1.6448536269514722 / (sr - top / sqrt(252.0)), 2)) END AS need FROM v, h),
p AS (SELECT *, {_phi('z0')} AS p0, {_phi('z1')} AS p1 FROM z)
SELECT strategy, n, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(sharpe, 6) AS sharpe, round(top, 6) AS expected_max,
  round(p0, 6) AS psr, round(p1, 6) AS dsr, round(need, 6) AS min_length, 20.0::DOUBLE AS trials,
  CASE WHEN p1 >= 0.95 AND n >= need THEN 'CERTIFIED_SIGNIFICANT' WHEN p1 >= 0.95 THEN 'INSUFFICIENT_SAMPLE_LENGTH' WHEN sharpe > top THEN 'INSUFFICIENT_CONFIDENCE' ELSE 'SELECTION_BIAS_REJECTED' END AS status FROM p""")
def _(spark, d):
    out = stats.deflated_sharpe(_moments(spark, d), F.lit(20.0), F.lit(0.5), F.lit(0.0))
    return rounded(out, 6, "mean", "std", "skew", "kurtosis", "sharpe", "expected_max", "psr", "dsr", "min_length")


@query("cohort_deflated_sharpe")
def _(spark, d):
    from tickloom.plans import pipelines

    return pipelines.cohort_deflated_sharpe(small_returns(spark, d), "symbol", U).drop("mean", "std")


@query("cv_deflated_sharpe")
def _(spark, d):
    from tickloom.operators import crossval
    from tickloom.plans import pipelines
    from tickloom.plans.catalog_labels import FOLDS, paths

    p = paths(spark, d)
    sharpes = crossval.path_sharpes(p)
    first = p.filter("path_id = 0").select(F.lit("cv").alias("strategy"), (F.col("pred") * F.col("ret")).alias("ret"))
    return pipelines.cv_deflated_sharpe(sharpes, first, "strategy", FOLDS)


TEAR = f"""{CURVE}, qq AS (SELECT symbol, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.95) AS p95 FROM small GROUP BY 1),
cu AS (SELECT symbol, min(drawdown) AS mdd, max(below_bars) AS mb FROM curve GROUP BY 1),
ba AS (SELECT symbol, p5, p95, count(*) AS n, product(1 + ret) AS eq, stddev_pop(ret) AS sd, avg(ret - {{rf}}) AS mx, avg(pow(least(ret - {{rf}}, 0), 2)) AS dv,
  sum(greatest(ret - {{rf}}, 0)) AS pos, sum(greatest({{rf}} - ret, 0)) AS neg, count(*) FILTER (ret > 0) AS wins, sum(ret) FILTER (ret > 0) AS gain,
  sum(ret) FILTER (ret < 0) AS loss, sum(ret) AS total, avg(ret) FILTER (ret <= p5) AS tl FROM small JOIN qq USING (symbol) GROUP BY 1, 2, 3),
tt AS (SELECT *, pow(eq, 252.0::DOUBLE / n) - 1 AS cg, sqrt(dv) * sqrt(252.0) AS dn FROM ba JOIN cu USING (symbol))"""


@query("tear_sheet", f"""WITH {TEAR.format(rf='0.02::DOUBLE / 252')} SELECT symbol, round(ln(eq), 4) AS log_growth, round(cg / 1000, 4) AS cagr_k, round(sd * sqrt(252.0), 4) AS annualized_volatility,
  round(mx / sd * sqrt(252.0), 3) AS sharpe_ratio, round((cg - 0.02) / dn / 1000, 3) AS sortino_k, round(cg / abs(mdd) / 1000, 3) AS calmar_k,
  round(pos / neg, 3) AS omega_ratio, round(mdd, 4) AS max_drawdown, mb AS max_drawdown_bars, round(wins / n, 4) AS win_rate, round(gain / abs(loss), 3) AS profit_factor,
  round(total / abs(loss), 3) AS gain_to_pain, round(abs(p95 / p5), 3) AS tail_ratio, round(abs(p5), 4) AS var_95, round(abs(tl), 4) AS cvar_95, n AS bars FROM tt""")
def _(spark, d):
    """Growth figures in logs and thousands: hourly stand-in returns compound to large numbers."""
    t = stats.tear_sheet(small_returns(spark, d), "symbol", risk_free=0.02)
    return t.select("symbol", F.round(F.log(F.col("total_return") + 1.0), 4).alias("log_growth"), F.round(F.col("cagr") / 1000, 4).alias("cagr_k"),
                    "annualized_volatility", "sharpe_ratio", F.round(F.col("sortino_ratio") / 1000, 3).alias("sortino_k"),
                    F.round(F.col("calmar_ratio") / 1000, 3).alias("calmar_k"), *t.columns[7:])


TEAR_DAILY = f"""WITH {DAILY}, qq AS (SELECT strategy, quantile_cont(ret, 0.05) AS p5, quantile_cont(ret, 0.95) AS p95 FROM daily GROUP BY 1),
ba AS (SELECT strategy, p5, p95, count(*) AS n, product(1 + ret) AS eq, stddev_pop(ret) AS sd, avg(ret) AS mx, sum(greatest(ret, 0)) AS pos, sum(greatest(-ret, 0)) AS neg,
  count(*) FILTER (ret > 0) AS wins, avg(ret) FILTER (ret <= p5) AS tl FROM daily JOIN qq USING (strategy) GROUP BY 1, 2, 3)
SELECT strategy, round(eq - 1, 4) AS total_return, round(CASE WHEN eq > 0 THEN pow(eq, 252.0::DOUBLE / n) - 1 ELSE 0 END, 4) AS cagr, round(mx / sd * sqrt(252.0), 3) AS sharpe_ratio,
  round(CASE WHEN neg > 1e-8 THEN pos / neg ELSE 0 END, 3) AS omega_ratio, round(wins / n, 4) AS win_rate, round(abs(p5), 4) AS var_95, round(abs(coalesce(tl, p5)), 4) AS cvar_95
FROM ba WHERE n >= 2 AND sd >= 1e-8"""


@query("tear_sheet_daily", TEAR_DAILY)
def _(spark, d):
    return stats.tear_sheet(daily_returns(spark, d), "strategy").select(
        "strategy", "total_return", "cagr", "sharpe_ratio", "omega_ratio", "win_rate", "var_95", "cvar_95")


@query("report_export", TEAR_DAILY)
def _(spark, d):
    """Metrics, equity series and monthly matrix written as a report, the metrics read back."""
    from tickloom.plans.catalog_streams import workspace

    r = daily_returns(spark, d)
    metrics = stats.tear_sheet(r, "strategy").select("strategy", "total_return", "cagr", "sharpe_ratio", "omega_ratio", "win_rate", "var_95", "cvar_95")
    equity = series.equity_curve(r.withColumnRenamed("strategy", "symbol"))
    root = workspace(spark)
    feeds.export_report(metrics, equity, stats.monthly_matrix(r, "strategy"), root)
    return spark.read.schema(metrics.schema).json(f"{root}/metrics")


def _month_cols():
    return ", ".join(f"round(coalesce(max(x) FILTER (m = {i}), 0.0), 4) AS m{i:02d}" for i in range(1, 13))


@query("monthly_matrix", f"""WITH o AS (SELECT o_orderpriority AS strategy, o_orderdate AS ts, (avg(o_totalprice) - 250000) / 50000000 AS ret FROM orders GROUP BY 1, 2),
x AS (SELECT strategy, year(ts)::INT AS year, month(ts) AS m, product(1 + ret) - 1 AS x FROM o GROUP BY 1, 2, 3)
SELECT strategy, year, {_month_cols()}, round(product(1 + x) - 1, 4) AS ytd FROM x GROUP BY 1, 2""")
def _(spark, d):
    o = fx.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("strategy"), fx.to_ns("o_orderdate").alias("ts_ns")).agg(
        ((F.avg("o_totalprice") - 250_000) / 50_000_000).alias("ret"))
    return stats.monthly_matrix(o, "strategy")


BENCH = f"{SMALL}, bm AS (SELECT ts_ns, ret AS bench FROM small WHERE symbol = 'click'), jn AS (SELECT s.*, bench FROM small s JOIN bm USING (ts_ns))"


@query("benchmark_relative", f"""WITH {BENCH}, a AS (SELECT symbol, covar_samp(ret, bench) / var_pop(bench) AS beta, avg(ret) AS mr, avg(bench) AS mb, stddev_pop(ret - bench) * sqrt(252.0) AS te,
  avg(ret - bench) AS md FROM jn GROUP BY 1)
SELECT symbol, round((mr - beta * mb) * 252, 4) AS alpha, round(beta, 4) AS beta, round(te, 4) AS tracking_error, round(md * sqrt(252.0) / greatest(te, 1e-8), 3) AS information_ratio FROM a""")
def _(spark, d):
    r = small_returns(spark, d)
    bench = r.filter("symbol = 'click'").select("ts_ns", F.col("ret").alias("bench"))
    return stats.benchmark_relative(r.join(bench, "ts_ns"), "symbol")


BP = f"""{SMALL}, sq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS seq,
  stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sg FROM small),
fv AS (SELECT symbol, greatest(var_samp(ret), 1e-12) AS v FROM small GROUP BY 1),
wd AS (SELECT ts_ns, avg(ret) AS ew, CASE WHEN max(seq) <= 2 THEN avg(ret) ELSE sum(ret / greatest(sg, 1e-12)) / sum(1 / greatest(sg, 1e-12)) END AS rp,
  sum(ret / v) / sum(1 / v) AS iv FROM sq JOIN fv USING (symbol) GROUP BY 1),
bp AS (SELECT ts_ns, 'EqualWeight' AS benchmark, ew AS bench FROM wd UNION ALL SELECT ts_ns, 'RiskParity', rp FROM wd UNION ALL
  SELECT ts_ns, 'InverseVolatility', iv FROM wd UNION ALL SELECT ts_ns, 'Cash', 0.02::DOUBLE / 252 FROM wd)"""


@query("benchmark_portfolios", f"WITH {BP} SELECT ts_ns, benchmark, round(bench, 6) AS bench FROM bp")
def _(spark, d):
    return rounded(stats.benchmark_portfolios(small_returns(spark, d), 0.02), 6, "bench")


@query("benchmark_comparison", f"""WITH {BP}, st AS (SELECT ts_ns, ret FROM small WHERE symbol = 'view'), j AS (SELECT ts_ns, benchmark, bench, ret FROM bp JOIN st USING (ts_ns)),
a AS (SELECT benchmark, count(*) AS n, sum(ln(1 + bench)) AS lg, stddev_samp(bench) AS sb, avg(bench) AS mb, avg(ret) AS mr, covar_samp(ret, bench) AS cv, var_samp(bench) AS vb,
  stddev_samp(ret - bench) AS sd, avg(ret - bench) AS md FROM j GROUP BY 1),
c AS (SELECT benchmark, exp(sum(ln(1 + bench)) OVER (PARTITION BY benchmark ORDER BY ts_ns)) AS eq, ts_ns FROM j),
p AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY benchmark ORDER BY ts_ns)) AS pk FROM c), dd AS (SELECT benchmark, max((pk - eq) / pk) AS mdd FROM p GROUP BY 1),
z AS (SELECT *, CASE WHEN vb < 1e-12 THEN 0 ELSE cv / vb END AS beta, 0.02::DOUBLE / 252 AS rf FROM a JOIN dd USING (benchmark))
SELECT benchmark, round(lg, 4) AS log_growth, round(CASE WHEN sb < 1e-12 THEN 0 ELSE sb * sqrt(252.0) END, 4) AS annualized_volatility,
  round(CASE WHEN sb < 1e-12 THEN 0 ELSE (mb - rf) / sb * sqrt(252.0) END, 4) AS sharpe_ratio, round(mdd, 4) AS max_drawdown,
  round(((mr - rf) - beta * (mb - rf)) * 252, 4) AS alpha, round(beta, 4) AS beta, round(sd * sqrt(252.0), 4) AS tracking_error, round(md / sd * sqrt(252.0), 4) AS information_ratio FROM z""")
def _(spark, d):
    r = small_returns(spark, d)
    c = stats.compare_benchmarks(r.filter("symbol = 'view'"), stats.benchmark_portfolios(r, 0.02), 0.02)
    cols = ["annualized_volatility", "sharpe_ratio", "max_drawdown", "alpha", "beta", "tracking_error", "information_ratio"]
    return rounded(c.select("benchmark", F.log(F.col("total_return") + 1.0).alias("log_growth"), *cols), 4, "log_growth", *cols)


@query("audit_metrics", f"""WITH {DAILY}, e AS (SELECT *, 1000000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY ts_ns)) AS eq FROM daily),
qq AS (SELECT strategy, quantile_cont(ret, 0.01) AS q01, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.95) AS q95 FROM daily GROUP BY 1),
h AS (SELECT *, (max(eq) OVER (PARTITION BY strategy ORDER BY ts_ns) - eq) / max(eq) OVER (PARTITION BY strategy ORDER BY ts_ns) AS dd FROM e),
a AS (SELECT strategy, q01, q05, q95, count(*) AS bars, arg_max(eq, ts_ns) AS last, avg(ret) AS m, stddev_samp(ret) AS sd, avg(pow(least(0, ret), 2)) AS dv, max(dd) AS mdd,
  count(*) FILTER (dd <= 0.01) AS nb, count(*) FILTER (dd > 0.01 AND dd <= 0.02) AS cb FROM h JOIN qq USING (strategy) GROUP BY 1, 2, 3, 4)
SELECT strategy, bars, round(last / 1000000 - 1, 6) AS total_return, round(CASE WHEN sd < 1e-12 THEN 0 ELSE sd * sqrt(252.0) END, 6) AS annualized_volatility,
  round(CASE WHEN sd < 1e-12 THEN 0 ELSE m / sd * sqrt(252.0) END, 6) AS sharpe_ratio, round(CASE WHEN sqrt(dv) < 1e-12 THEN 0 ELSE m / sqrt(dv) * sqrt(252.0) END, 6) AS sortino_ratio,
  round(least(1, greatest(0, mdd)), 6) AS max_drawdown, round(-q05, 6) AS var_95, round(-q01, 6) AS var_99, round(CASE WHEN abs(q05) >= 1e-12 THEN greatest(0, q95 / abs(q05)) ELSE 0 END, 6) AS tail_ratio,
  nb AS normal_bars, cb AS caution_bars FROM a""")
def _(spark, d):
    c = series.equity_curve(daily_returns(spark, d), "strategy")
    rec = c.select("strategy", "ts_ns", (F.col("equity") * 1e6).alias("equity"), (-F.col("drawdown")).alias("drawdown"), F.lit(1.0).alias("leverage"),
                   F.lit(0.0).alias("friction"), F.when(F.col("drawdown") >= -0.01, "NORMAL").when(F.col("drawdown") >= -0.02, "CAUTION").otherwise("DERISK").alias("tier"))
    a = stats.audit(rec, "strategy", 1e6)
    cols = ["total_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "var_95", "var_99", "tail_ratio"]
    return rounded(a.select("strategy", "bars", *cols, "normal_bars", "caution_bars"), 6, *cols)


@query("downside_variance", f"WITH {SMALL} SELECT symbol, round(greatest(avg(pow(least(0, ret - 0.001), 2)), 1e-8), 8) AS semi_variance FROM small GROUP BY 1")
def _(spark, d):
    return rounded(stats.downside_variance(small_returns(spark, d), "symbol", 0.001), 8, "semi_variance")


def votes_source(spark, d):
    """Per hour, each symbol is a model: its return in percent is the forecast."""
    return small_returns(spark, d).select("ts_ns", F.col("symbol").alias("model"), (F.col("ret") * 0.5).alias("prediction"), "ret")


@query("forecast_losses", f"""WITH {SMALL}, f AS (SELECT symbol AS model, ret, (ret * -0.3 + 0.001) / sqrt(1 + (ts_ns // 3600000000000) % 4) AS p FROM small)
SELECT model, round(avg(greatest(0, pow(ret - p, 2) + 2.5::DOUBLE * greatest(0, -ret * p))), 6) AS mean_loss, count(*) AS n FROM f GROUP BY 1""")
def _(spark, d):
    f = small_returns(spark, d).select(F.col("symbol").alias("model"), "ret", (F.col("ret") * -0.3 + 0.001).alias("prediction"),
                                       (1 + F.expr("ts_ns div 3600000000000") % 4).alias("horizon"))
    return rounded(stats.forecast_losses(f), 6, "mean_loss")


ENTROPY = f"""{SMALL}, vt AS (SELECT ts_ns, ret * 0.01 AS p, 0.2::DOUBLE AS w, 0.5::DOUBLE AS al, ((ts_ns // 3600000000000) % 7) * 0.1::DOUBLE AS ep FROM small),
sh AS (SELECT ts_ns, sum(CASE WHEN p > 1e-4 THEN w ELSE 0.0 END) AS pp, sum(CASE WHEN p < -1e-4 THEN w ELSE 0.0 END) AS pn, sum(CASE WHEN abs(p) <= 1e-4 THEN w ELSE 0.0 END) AS pz,
  any_value(ep) / (any_value(al) + any_value(ep)) AS rho FROM vt GROUP BY 1),
en AS (SELECT *, least(1, greatest(0, -(pp * ln(pp + 1e-30::DOUBLE) + pn * ln(pn + 1e-30::DOUBLE) + pz * ln(pz + 1e-30::DOUBLE)) / ln(3.0::DOUBLE))) AS h FROM sh)"""


def entropy(spark, d):
    v = small_returns(spark, d).select("ts_ns", (F.col("ret") * 0.01).alias("prediction"), F.lit(0.2).alias("weight"), F.lit(0.5).alias("aleatoric"),
                                       ((F.expr("ts_ns div 3600000000000") % 7) * 0.1).alias("epistemic"))
    return stats.epistemic_entropy(v)


@query("epistemic_entropy", f"""WITH {ENTROPY} SELECT ts_ns, round(pp, 6) AS p_pos, round(pn, 6) AS p_neg, round(pz, 6) AS p_neu, round(h, 6) AS directional_entropy,
  round(rho, 6) AS epistemic_ratio, round(h * sqrt(rho), 6) AS composite_entropy FROM en""")
def _(spark, d):
    return rounded(entropy(spark, d), 6, "p_pos", "p_neg", "p_neu", "directional_entropy", "epistemic_ratio", "composite_entropy")


@query("shock_haircut", f"""WITH {ENTROPY}, s AS (SELECT ts_ns, least(1, greatest(0, 0.5 * h * sqrt(rho) + 0.3 * rho + 0.2 * least(1, greatest(0, (1 + (ts_ns // 3600000000000) % 6 - 1.0) / 4.0)))) AS shock FROM en)
SELECT ts_ns, round(shock, 6) AS shock, round(least(1, greatest(0, (1 / (1 + exp(10.0 * (shock - 0.5))) - 1 / (1 + exp(5.0))) / (1 / (1 + exp(-5.0)) - 1 / (1 + exp(5.0))))), 6) AS haircut FROM s""")
def _(spark, d):
    s = stats.shock_and_haircut(entropy(spark, d), (1 + F.expr("ts_ns div 3600000000000") % 6).cast("double"))
    return rounded(s.select("ts_ns", "shock", "haircut"), 6, "shock", "haircut")


LOSS = """loss AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts_ns, value - 50.0 AS loss FROM events)"""
TH = f"""{LOSS}, th AS (SELECT symbol, count(*) AS n, avg(loss) AS mu, stddev_samp(loss) AS sigma, avg(loss) + 1.645::DOUBLE * stddev_samp(loss) AS u FROM loss GROUP BY 1),
ex AS (SELECT symbol, ts_ns, loss - u AS y, n, u FROM loss JOIN th USING (symbol) WHERE loss > u)"""


def losses(spark, d):
    return fx.ticks(spark, d).select("symbol", "ts_ns", (F.col("price") - 50.0).alias("loss"))


@query("empirical_var", f"""WITH {LOSS}, q AS (SELECT symbol, quantile_cont(loss, 0.99) AS v FROM loss GROUP BY 1)
SELECT symbol, round(v, 6) AS var, round(greatest(v, avg(loss) FILTER (loss >= v)), 6) AS cvar FROM loss JOIN q USING (symbol) GROUP BY symbol, v""")
def _(spark, d):
    return rounded(tail.empirical(losses(spark, d), ["symbol"]), 6, "var", "cvar")


@query("tail_exceedances", f"WITH {TH} SELECT symbol, ts_ns, round(u, 6) AS threshold, round(y, 6) AS excess FROM ex")
def _(spark, d):
    x = losses(spark, d)
    out = tail.exceedances(x, tail.thresholds(x, ["symbol"]), ["symbol"])
    return rounded(out.select("symbol", "ts_ns", "threshold", "excess"), 6, "threshold", "excess")


@query("evt_pwm_risk", f"""WITH {TH}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY y) AS i, count(*) OVER (PARTITION BY symbol) AS nu FROM ex),
m AS (SELECT symbol, n, u, nu, avg(y) AS m0, sum((nu - i + 0.35::DOUBLE) / (nu * nu) * y) AS m1 FROM r GROUP BY 1, 2, 3, 4),
f AS (SELECT *, CASE WHEN m0 - 2 * m1 <= 1e-12 OR 2 - m0 / (m0 - 2 * m1) <= 0 THEN 0.001 ELSE least(0.999, greatest(0.001, 2 - m0 / (m0 - 2 * m1))) END AS xi,
  CASE WHEN m0 - 2 * m1 <= 1e-12 OR 2 - m0 / (m0 - 2 * m1) <= 0 THEN greatest(m0, 1e-8) ELSE 2 * m0 * m1 / (m0 - 2 * m1) END AS b FROM m),
v AS (SELECT *, u + b / xi * (pow(n / nu * (1 - 0.99::DOUBLE), -xi) - 1) AS var FROM f)
SELECT symbol, n, nu AS n_u, 'EVT_PWM' AS fit, round(xi, 6) AS shape, round(b, 6) AS scale, round(var, 6) AS var, round(greatest(var, (var + b - xi * u) / (1 - xi)), 6) AS cvar FROM v""")
def _(spark, d):
    e = tail.evt_risk(losses(spark, d), ["symbol"]).drop("threshold")
    return rounded(e, 6, "shape", "scale", "var", "cvar")


def grouped_losses(spark, d):
    """Losses per symbol, per user and per user and symbol: samples of three sizes."""
    t = fx.ticks(spark, d)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    keys = F.array(F.col("symbol"), user, F.concat_ws(":", user, F.col("symbol")))
    return t.select(F.explode(keys).alias("book"), (F.col("price") - 50.0).alias("loss"))


@query("student_t_risk")
def _(spark, d):
    return rounded(tail.student_t_risk(grouped_losses(spark, d), ["book"]), 6, "nu", "scale", "var", "cvar")


@query("tail_risk_cascade")
def _(spark, d):
    return rounded(tail.risk_cascade(grouped_losses(spark, d), ["book"]), 6, "threshold", "var", "cvar")


@query("rolling_tail_risk", f"""WITH {LOSS}, w AS (SELECT symbol, ts_ns, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS seq,
  quantile_cont(loss, 0.99) OVER v AS var, list(loss) OVER v AS win FROM loss WINDOW v AS (PARTITION BY symbol ORDER BY ts_ns ROWS 249 PRECEDING))
SELECT symbol, ts_ns, round(var, 6) AS var, round(greatest(var, list_avg(list_filter(win, lambda x: x >= var))), 6) AS cvar FROM w WHERE seq >= 2""")
def _(spark, d):
    out = tail.rolling_empirical(losses(spark, d), 250)
    return rounded(out.select("symbol", "ts_ns", "var", "cvar"), 6, "var", "cvar")


@query("rolling_risk_cascade")
def _(spark, d):
    return rounded(tail.rolling_cascade(losses(spark, d)), 6, "var", "cvar")
