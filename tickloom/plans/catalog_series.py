"""Registered queries: time-series transforms, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import filters, series
from tickloom.plans import sqltext as S
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
H = S.HOUR
U = S.UNIVERSE


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def rounded(df, places: int, *cols: str):
    return df.withColumns({c: F.round(c, places) for c in cols})


def settled(df, digits, *cols):
    """Rounded halves up, five more digits first: sums of another order differ in their last bits and would part at an exact half."""
    return rounded(rounded(df, digits + 5, *cols), digits, *cols)


def settled_sql(x: str, digits: int) -> str:
    """The rule of :func:`settled`; decimals round exact halves as such."""
    return f"round(({x})::DECIMAL(38, {digits + 5}), {digits})::DOUBLE"


SEQ = f"{S.bars()}, seqd AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS seq FROM bars)"


@query("aligned_returns", f"WITH {S.aligned()} SELECT symbol, ts_ns, round(ret, 6) AS ret FROM aligned")
def _(spark, d):
    return rounded(series.aligned_returns(fx.historical_bars(spark, d), U), 6, "ret")


@query("aligned_log_returns", f"WITH {S.aligned('log')} SELECT symbol, ts_ns, round(ret, 6) AS ret FROM aligned")
def _(spark, d):
    return rounded(series.aligned_returns(fx.historical_bars(spark, d), U, kind="log"), 6, "ret")


SPARSE = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def order_prices(spark, d):
    """Daily mean order value per priority and customer segment bucket: a sparse series."""
    o = fx.table(spark, d, "orders")
    return o.groupBy(
        F.col("o_orderpriority").alias("symbol"), fx.to_ns("o_orderdate").alias("ts_ns")
    ).agg(F.max("o_totalprice").alias("close"))


@query("aligned_returns_sparse", """WITH p AS (SELECT o_orderpriority AS symbol, epoch_us(o_orderdate) * 1000 AS ts_ns, max(o_totalprice) AS price
  FROM orders GROUP BY 1, 2),
g AS (SELECT t.ts_ns, s.symbol, p.price FROM (SELECT DISTINCT ts_ns FROM p) t CROSS JOIN (SELECT DISTINCT symbol FROM p) s
  LEFT JOIN p ON p.symbol = s.symbol AND p.ts_ns = t.ts_ns),
f AS (SELECT symbol, ts_ns, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ns) AS now,
  row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS k FROM g),
s AS (SELECT *, lag(now) OVER (PARTITION BY symbol ORDER BY ts_ns) AS prev FROM f)
SELECT symbol, ts_ns, round(coalesce((now - prev) / prev, 0.0), 6) AS ret FROM s WHERE k > 1""")
def _(spark, d):
    return rounded(series.aligned_returns(order_prices(spark, d), SPARSE, field="close", span_ns=90 * 86_400_000_000_000), 6, "ret")


RANGE = (1704456000000000000, 1705968000000000000)


@query("aligned_returns_ranged", f"""WITH {S.aligned().replace("FROM events", f"FROM events WHERE epoch_us(ts) * 1000 // {H} * {H} BETWEEN {RANGE[0]} AND {RANGE[1]}")}
SELECT symbol, ts_ns, round(ret, 6) AS ret FROM aligned""")
def _(spark, d):
    """Hourly returns of a closed range, out of hourly and daily bars."""
    both = fx.historical_bars(spark, d).unionByName(fx.historical_bars(spark, d, 24 * H))
    return rounded(series.aligned_returns(both, U, resolution="1h", start_ns=RANGE[0], end_ns=RANGE[1]), 6, "ret")


@query("aligned_matrix", f"""WITH {S.aligned()} SELECT ts_ns, {', '.join(f"round(max(ret) FILTER (symbol = '{s}'), 6) AS {s}" for s in U)}
FROM aligned GROUP BY 1""")
def _(spark, d):
    wide = series.aligned_matrix(series.aligned_returns(fx.historical_bars(spark, d), U), U)
    return rounded(wide, 6, *U)


@query("simple_returns", f"""WITH {S.bars()} SELECT symbol, ts_ns, round(r, 6) AS ret FROM (
  SELECT symbol, ts_ns, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) - 1.0 AS r FROM bars) WHERE r IS NOT NULL""")
def _(spark, d):
    return rounded(series.simple_returns(fx.bars(spark, d)).select("symbol", "ts_ns", "ret"), 6, "ret")


@query("realised_vol", f"""WITH {SEQ}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS r FROM seqd)
SELECT symbol, ts_ns, round(CASE WHEN seq > 20 THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 19 PRECEDING) ELSE 0 END, 8) AS realised_vol FROM r""")
def _(spark, d):
    return rounded(series.realised_vol(fx.bars(spark, d)).select("symbol", "ts_ns", "realised_vol"), 8, "realised_vol")


PARK = f"""{SEQ}, park AS (SELECT *, CASE WHEN seq > 20 THEN sqrt(greatest(0, sum(pow(ln(high / low), 2)) OVER
  (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) / (4 * ln(2.0::DOUBLE) * 20))) ELSE 0.0 END AS parkinson FROM seqd)"""


@query("parkinson_lagged", f"WITH {PARK} SELECT symbol, ts_ns, round(parkinson, 8) AS parkinson FROM park")
def _(spark, d):
    out = series.parkinson_lagged(series.sequenced(fx.bars(spark, d)))
    return rounded(out.select("symbol", "ts_ns", "parkinson"), 8, "parkinson")


@query("garman_klass_lagged", f"""WITH {PARK}, g AS (SELECT *, CASE WHEN seq > 20 THEN sqrt(greatest(0, avg(
  0.5 * pow(ln(high / greatest(1e-6, low)), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / greatest(1e-6, open)), 2)) OVER
  (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))) ELSE 0.0 END AS gk FROM park)
SELECT symbol, ts_ns, round(parkinson * sqrt(252.0 * 390.0) * 100, 4) AS parkinson_vol, round(gk * sqrt(252.0 * 390.0) * 100, 4) AS garman_klass_vol FROM g""")
def _(spark, d):
    out = series.garman_klass_lagged(fx.bars(spark, d)).select("symbol", "ts_ns", "parkinson_vol", "garman_klass_vol")
    return rounded(out, 4, "parkinson_vol", "garman_klass_vol")


GK = """(0.5 * pow(ln(greatest(greatest(high, 1e-4) / greatest(low, 1e-4), 1)), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(greatest(close, 1e-4) / greatest(open, 1e-4)), 2))"""


@query("range_vol_summary", f"""WITH {S.bars()} SELECT symbol,
  round(sqrt(avg(pow(ln(greatest(greatest(high, 1e-4) / greatest(low, 1e-4), 1)), 2)) / (4 * ln(2.0::DOUBLE))) * sqrt(252.0), 6) AS parkinson,
  round(sqrt(greatest(0, avg({GK}))) * sqrt(252.0), 6) AS garman_klass FROM bars GROUP BY 1""")
def _(spark, d):
    return rounded(series.range_vol_summary(fx.bars(spark, d)), 6, "parkinson", "garman_klass")


@query("bar_inputs", f"""WITH {SEQ}, r AS (SELECT *, ln(greatest(close, 1e-8) / greatest(lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns), 1e-8)) AS r FROM seqd)
SELECT symbol, ts_ns, round(r, 6) AS log_ret, round(greatest(sqrt(pow(ln(greatest(high / greatest(low, 1e-8), 1)), 2) / (4 * ln(2.0::DOUBLE))), 0.005), 6) AS volatility,
  round(greatest(close * volume, 1000000.0::DOUBLE), 4) AS adv FROM r WHERE seq > 1""")
def _(spark, d):
    out = series.bar_inputs(fx.bars(spark, d)).select("symbol", "ts_ns", "log_ret", "volatility", "adv")
    return rounded(rounded(out, 6, "log_ret", "volatility"), 4, "adv")


FFD_D, FFD_CUT = 0.4, 1e-4
FFD_W = series.fractional_weights(FFD_D, FFD_CUT, None, False)
FFD_X = series.fractional_weights(0.4, 1e-3, None, False)


def _values(w):
    return ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(w))


def ffd_weights(table: str) -> str:
    """CTEs: ``lb``, the look-back of each symbol of ``table``, and ``wk``, its weights, which sum to zero."""
    return f"""w(k, w) AS (VALUES {_values(FFD_W)}),
lb AS (SELECT symbol, least({len(FFD_W) - 1}, greatest(10, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT))) AS l FROM {table} GROUP BY 1),
wk AS (SELECT symbol, l, k, w FROM lb JOIN w ON k BETWEEN 1 AND l UNION ALL SELECT symbol, l, 0, -sum(w) FROM lb JOIN w ON k BETWEEN 1 AND l GROUP BY 1, 2)"""


@query("frac_diff", f"""WITH {SEQ}, {ffd_weights('seqd')}
SELECT b.symbol, b.ts_ns, round(sum(w.w * p.close), 6) AS ffd FROM seqd b JOIN wk w ON w.symbol = b.symbol
JOIN seqd p ON p.symbol = b.symbol AND p.seq = b.seq - w.k WHERE b.seq > w.l GROUP BY 1, 2""")
def _(spark, d):
    return rounded(filters.frac_diff(fx.bars(spark, d), FFD_D, FFD_CUT).select("symbol", "ts_ns", "ffd"), 6, "ffd")


@query("frac_diff_expanding", f"""WITH {SEQ}, w(k, w) AS (VALUES {_values(FFD_X)}),
x AS (SELECT symbol, ts_ns, seq, ln(greatest(close, 1e-4)) - first(ln(greatest(close, 1e-4))) OVER (PARTITION BY symbol ORDER BY ts_ns) AS x FROM seqd)
SELECT b.symbol, b.ts_ns, round(sum(w.w * p.x), 6) AS ffd FROM x b JOIN w ON true
JOIN x p ON p.symbol = b.symbol AND p.seq = b.seq - w.k GROUP BY 1, 2""")
def _(spark, d):
    return rounded(series.frac_diff_expanding(fx.bars(spark, d), FFD_X).select("symbol", "ts_ns", "ffd"), 6, "ffd")


@query("ema", f"""WITH RECURSIVE {SEQ}, e AS (
  SELECT symbol, seq, ts_ns, close AS fast, close AS slow FROM seqd WHERE seq = 1
  UNION ALL SELECT s.symbol, s.seq, s.ts_ns, 2.0::DOUBLE / 6 * s.close + (1 - 2.0::DOUBLE / 6) * e.fast,
    2.0::DOUBLE / 27 * s.close + (1 - 2.0::DOUBLE / 27) * e.slow FROM e JOIN seqd s ON s.symbol = e.symbol AND s.seq = e.seq + 1)
SELECT symbol, ts_ns, round(fast, 6) AS fast, round(slow, 6) AS slow FROM e""")
def _(spark, d):
    return rounded(series.ema(fx.bars(spark, d), "close", {"fast": 5, "slow": 26}).select("symbol", "ts_ns", "fast", "slow"), 6, "fast", "slow")


BANDS = f"""{SEQ}, b1 AS (SELECT *, avg(close) OVER w AS sma, stddev_pop(close) OVER w AS sd, avg(volume) OVER w AS av, avg(high - low) OVER w AS mean_range,
  sqrt(greatest(0, avg({GK}) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 4 PRECEDING))) * sqrt(252.0) AS gk_fast,
  sqrt(greatest(0, avg({GK}) OVER w)) * sqrt(252.0) AS gk_base, lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) AS prev_close
  FROM seqd WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns ROWS 19 PRECEDING)),
b2 AS (SELECT *, CASE WHEN seq >= 20 THEN 4.0 * sd / greatest(sma, 1e-4) END AS bandwidth FROM b1),
b3 AS (SELECT *, quantile_cont(bandwidth, 0.15) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 99 PRECEDING) AS squeeze_threshold FROM b2),
bands AS (SELECT *, sma + 2 * sd AS upper_band, sma - 2 * sd AS lower_band, gk_fast / greatest(gk_base, 1e-4) AS vol_expansion,
  volume >= av * 1.15::DOUBLE AS volume_confirmed, bandwidth <= squeeze_threshold AS is_squeeze FROM b3 WHERE seq >= 119)"""


@query("bollinger_bands", f"WITH {BANDS} SELECT symbol, ts_ns, round(sma, 6) AS sma, round(upper_band, 6) AS upper_band, round(lower_band, 6) AS lower_band, round(bandwidth, 6) AS bandwidth FROM bands")
def _(spark, d):
    out = series.bollinger(series.sequenced(fx.bars(spark, d))).select("symbol", "ts_ns", "sma", "upper_band", "lower_band", "bandwidth")
    return rounded(out, 6, "sma", "upper_band", "lower_band", "bandwidth")


@query("squeeze_flag", f"WITH {BANDS} SELECT symbol, ts_ns, round(squeeze_threshold, 6) AS squeeze_threshold, is_squeeze FROM bands")
def _(spark, d):
    out = series.bollinger(series.sequenced(fx.bars(spark, d))).select("symbol", "ts_ns", "squeeze_threshold", "is_squeeze")
    return rounded(out, 6, "squeeze_threshold")


@query("vol_expansion", f"WITH {BANDS} SELECT symbol, ts_ns, round(vol_expansion, 6) AS vol_expansion, volume_confirmed, round(mean_range, 6) AS mean_range FROM bands")
def _(spark, d):
    out = series.bollinger(series.sequenced(fx.bars(spark, d))).select("symbol", "ts_ns", "vol_expansion", "volume_confirmed", "mean_range")
    return rounded(out, 6, "vol_expansion", "mean_range")


@query("annualised_vol", f"""WITH {SEQ}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS r FROM seqd)
SELECT symbol, ts_ns, round(CASE WHEN seq - 1 < 5 THEN 0.20 ELSE greatest(0.05, stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS 19 PRECEDING) * sqrt(252.0)) END, 6) AS ann_vol FROM r""")
def _(spark, d):
    return rounded(series.annualised_vol(fx.bars(spark, d)).select("symbol", "ts_ns", "ann_vol"), 6, "ann_vol")


Z = f"""{S.aligned()}, z0 AS (SELECT symbol, ts_ns, ret, count(*) OVER w AS n, avg(ret) OVER w AS mu, var_samp(ret) OVER w AS vr
  FROM aligned WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns)),
zs AS (SELECT *, CASE WHEN n >= 2 THEN CASE WHEN vr > 1e-12 THEN sqrt(vr) ELSE 0.01 END ELSE greatest(abs(ret), 0.01) END AS std FROM z0),
zz AS (SELECT *, (ret - CASE WHEN n >= 2 THEN mu ELSE 0 END) / std AS z FROM zs)"""


@query("expanding_z", f"WITH {Z} SELECT symbol, ts_ns, round(std, 6) AS std, round(z, 6) AS z FROM zz")
def _(spark, d):
    r = series.aligned_returns(fx.historical_bars(spark, d), U)
    return rounded(series.expanding_z(r).select("symbol", "ts_ns", "std", "z"), 6, "std", "z")


@query("cusum_two_sided", f"""WITH RECURSIVE {Z}, q AS (SELECT symbol, ts_ns, z, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS seq FROM zz),
c AS (SELECT symbol, seq, ts_ns, greatest(0, z - 0.5)::DOUBLE AS p, greatest(0, -z - 0.5)::DOUBLE AS m FROM q WHERE seq = 1
  UNION ALL SELECT q.symbol, q.seq, q.ts_ns, greatest(0, c.p + q.z - 0.5), greatest(0, c.m - q.z - 0.5) FROM c JOIN q ON q.symbol = c.symbol AND q.seq = c.seq + 1)
SELECT symbol, ts_ns, round(p, 6) AS s_pos, round(m, 6) AS s_neg, p >= 3 OR m >= 3 AS is_shock FROM c""")
def _(spark, d):
    r = series.expanding_z(series.aligned_returns(fx.historical_bars(spark, d), U))
    out = series.cusum(r).select("symbol", "ts_ns", "s_pos", "s_neg", "is_shock")
    # a signed zero of the closed form would not match the recursion's plain zero
    return rounded(out, 6, "s_pos", "s_neg").withColumns({c: F.col(c) + F.lit(0.0) for c in ("s_pos", "s_neg")})


def spread_rows(spark, d):
    """Close-open spread per bar as a stand-in spread series."""
    return fx.bars(spark, d).select("symbol", "ts_ns", (F.col("close") - F.col("open")).alias("spread"))


@query("rolling_spread_z", f"""WITH {S.bars()}, s AS (SELECT symbol, ts_ns, close - open AS spread FROM bars)
SELECT symbol, ts_ns, round((spread - avg(spread) OVER w) / greatest(stddev_pop(spread) OVER w, 1e-6), 6) AS z FROM s
WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns ROWS 59 PRECEDING)""")
def _(spark, d):
    return rounded(series.rolling_z(spread_rows(spark, d), "spread").select("symbol", "ts_ns", "z"), 6, "z")


@query("half_life", f"""WITH {S.bars()}, s AS (SELECT symbol, ts_ns, close - open AS e FROM bars),
l AS (SELECT *, lag(e) OVER (PARTITION BY symbol ORDER BY ts_ns) AS p FROM s),
g AS (SELECT symbol, covar_samp(e - p, p) AS c, var_pop(p) AS v, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY 1)
SELECT symbol, round(CASE WHEN n + 1 < 10 OR v < 1e-12 THEN 'nan'::DOUBLE WHEN c / v >= -1e-6 THEN 'inf'::DOUBLE ELSE greatest(0.1, -ln(2.0::DOUBLE) / (c / v)) END, 6) AS half_life FROM g""")
def _(spark, d):
    return rounded(series.half_life(spread_rows(spark, d), "spread"), 6, "half_life")


CURVE = f"""{S.aligned()}, small AS (SELECT symbol, ts_ns, ret / 100 AS ret FROM aligned),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS equity, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS bar FROM small),
pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts_ns) AS peak FROM eq),
dd AS (SELECT *, (equity - peak) / greatest(peak, 1e-8) AS drawdown FROM pk),
curve AS (SELECT *, bar - coalesce(max(CASE WHEN drawdown >= -1e-6 THEN bar END) OVER (PARTITION BY symbol ORDER BY ts_ns), 0) AS below_bars FROM dd)"""


def small_returns(spark, d):
    """Aligned returns over 100: daily-sized moves, so equity stays in range."""
    r = series.aligned_returns(fx.historical_bars(spark, d), U)
    return r.withColumn("ret", F.col("ret") / 100)


@query("equity_curve", f"WITH {CURVE} SELECT symbol, ts_ns, round(ln(equity), 6) AS log_equity, round(drawdown, 6) AS drawdown, below_bars FROM curve")
def _(spark, d):
    c = series.equity_curve(small_returns(spark, d))
    return rounded(c.select("symbol", "ts_ns", F.log("equity").alias("log_equity"), "drawdown", "below_bars"), 6, "log_equity", "drawdown")


@query("dual_ema_signal", f"""WITH RECURSIVE {SEQ}, i AS (SELECT symbol, seq, ts_ns, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS ret,
  greatest(ln(high / low), 0.005::DOUBLE) AS volatility FROM seqd),
r AS (SELECT symbol, ts_ns, ret, volatility, seq - 1 AS seq FROM i WHERE seq > 1),
e AS (SELECT symbol, seq, ts_ns, ret, volatility, 0.0::DOUBLE AS s, 0.0::DOUBLE AS f, 0.0::DOUBLE AS signal FROM r WHERE seq = 1
 UNION ALL SELECT symbol, seq, ts_ns, ret, volatility, s, f, CASE WHEN abs(0.6 * f + 0.4 * s) >= 0.1 * greatest(pv, 1e-4) THEN 0.6 * f + 0.4 * s ELSE 0.0 END FROM (
   SELECT r.symbol, r.seq, r.ts_ns, r.ret, r.volatility, e.volatility AS pv, 2.0::DOUBLE / 21 * e.ret + (1 - 2.0::DOUBLE / 21) * e.s AS s,
     2.0::DOUBLE / 6 * e.ret + (1 - 2.0::DOUBLE / 6) * e.f AS f FROM e JOIN r ON r.symbol = e.symbol AND r.seq = e.seq + 1))
SELECT symbol, ts_ns, round(signal, 6) AS signal FROM e""")
def _(spark, d):
    from tickloom.operators import blocks

    b = blocks.rolling(series.sequenced(fx.bars(spark, d)), ["symbol"], lambda f: {
        "ret": F.col("close") / F.max("close").over(f(-1, -1)) - 1.0,
        "volatility": F.greatest(F.log(F.col("high") / F.col("low")), F.lit(0.005)),
    }, back=1, where=F.col("seq") > 1).select("symbol", "ts_ns", "ret", "volatility")
    return rounded(series.dual_ema_signal(b, 20, 5, 0.6, 0.1).select("symbol", "ts_ns", "signal"), 6, "signal")
