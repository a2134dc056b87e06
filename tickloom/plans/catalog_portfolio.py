"""Registered queries: signals, accounting, order screens and sequential kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import filters, kernels, portfolio, series, stats
from tickloom.plans import sqltext as S
from tickloom.plans.catalog_news import _decay_sql
from tickloom.plans.catalog_posttrade import FILLS
from tickloom.plans.catalog_series import BANDS, FFD_CUT, FFD_D, FFD_W, SEQ, ffd_weights, rounded, small_returns
from tickloom.plans.catalog_stats import ENTROPY, SMALL, entropy
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
U = S.UNIVERSE
H = S.HOUR


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


@query("momentum_signals")
def _(spark, d):
    return portfolio.momentum_signals(fx.bars(spark, d), series.fractional_weights(0.4, 1e-3))


@query("breakout_signals", f"""WITH {BANDS}, b AS (SELECT *, close > upper_band AND prev_close <= upper_band AND vol_expansion >= 1.05 AS up, close < lower_band AND prev_close >= lower_band AND vol_expansion >= 1.05 AS dn, mean_range / close AS atr FROM bands)
SELECT symbol, ts_ns, CASE WHEN up THEN 'LONG' WHEN dn THEN 'SHORT' ELSE 'FLAT' END AS direction, round(CASE WHEN up THEN 1 WHEN dn THEN -1 ELSE 0 END * 0.2 * CASE WHEN volume_confirmed THEN 0.9 ELSE 0.6 END, 4)::DOUBLE AS target_weight FROM b""")
def _(spark, d):
    s = portfolio.breakout_signals(fx.bars(spark, d), 5, expansion=1.05)
    return s.select("symbol", "ts_ns", "direction", (F.col("target_weight") + F.lit(0.0)).alias("target_weight"))


PAIRS = [(y, x) for i, y in enumerate(U) for x in U[i + 1:]]
KALMAN = f"""{S.bars()}, p AS (SELECT y.symbol AS sy, x.symbol AS sx, y.ts_ns, y.close AS y, x.close AS x, row_number() OVER (PARTITION BY y.symbol, x.symbol ORDER BY y.ts_ns) AS n
  FROM bars y JOIN bars x ON y.ts_ns = x.ts_ns AND y.symbol < x.symbol),
run AS (SELECT DISTINCT sy, sx, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts_ns, 0.0::DOUBLE AS y, 0.0::DOUBLE AS x, 0.0::DOUBLE AS e, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS p0, 0.0::DOUBLE AS p1, 1.0::DOUBLE AS p2 FROM p
  UNION ALL SELECT sy, sx, n, ts_ns, y, x, e, a + (q0 + p1 * x) / f * e, b + (p1 + q2 * x) / f * e, q0 - pow(q0 + p1 * x, 2) / f, p1 - (q0 + p1 * x) * (p1 + q2 * x) / f, q2 - pow(p1 + q2 * x, 2) / f
  FROM (SELECT *, greatest(q0 + 2 * p1 * x + q2 * x * x + 1e-3, 1e-8) AS f FROM (
    SELECT p.sy, p.sx, p.n, p.ts_ns, p.y, p.x, p.y - (a + b * p.x) AS e, a, b, p0 + 1e-4 / (1 - 1e-4) AS q0, p1, p2 + 1e-4 / (1 - 1e-4) AS q2 FROM run JOIN p ON p.sy = run.sy AND p.sx = run.sx AND p.n = run.n + 1)))"""


@query("pairs_signals", f"""WITH RECURSIVE {KALMAN},
z AS (SELECT *, (e - avg(e) OVER w) / greatest(stddev_pop(e) OVER w, 1e-6) AS z FROM run WHERE n > 0 WINDOW w AS (PARTITION BY sy, sx ORDER BY ts_ns ROWS 59 PRECEDING)),
d AS (SELECT *, CASE WHEN abs(z) >= 4 THEN 0 WHEN z >= 2 THEN -1 WHEN z <= -2 THEN 1 WHEN abs(z) <= 0.5 THEN 0 END AS d, greatest(0.01, abs(b) * x / y) AS beta FROM z),
h AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY sy, sx ORDER BY ts_ns), 0)::INT AS pos FROM d)
SELECT sy AS y, sx AS x, ts_ns, round(z, 6) AS z, round(a, 6) AS alpha, round(b, 6) AS beta, pos AS position, round(pos / (1.0 + beta), 6) AS weight_y,
  round(-pos * CASE WHEN b >= 0 THEN 1 ELSE -1 END * beta / (1.0 + beta), 6) AS weight_x,
  round(CASE WHEN pos = 0 THEN 0 WHEN abs(z) >= 2 THEN 0.5 + 0.5 * least(1, (abs(z) - 2) / 2) ELSE 0.5 END, 6)::DOUBLE AS conviction FROM h""")
def _(spark, d):
    """Every pair of the universe."""
    return rounded(portfolio.pairs_signals(fx.bars(spark, d), PAIRS), 6, "z", "alpha", "beta", "weight_y", "weight_x", "conviction")


@query("kalman_hedge", f"""WITH RECURSIVE {KALMAN}
SELECT sy AS y, sx AS x, ts_ns, y AS y_price, x AS x_price, round(e, 6) AS spread, round(a, 6) AS alpha, round(b, 6) AS beta FROM run WHERE n > 0""")
def _(spark, d):
    return rounded(kernels.kalman_hedges(fx.bars(spark, d), PAIRS), 6, "spread", "alpha", "beta")


def sentiment_events(spark, d):
    t = fx.ticks(spark, d)
    return t.select("symbol", "ts_ns", ((F.col("event_id") % 21 - 10) / 10.0).alias("polarity"), ((F.col("event_id") % 10) / 10.0).alias("urgency"), F.lit(0.25).alias("centrality"))


@query("sentiment_signals", f"""WITH {S.bars()}, ev AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS t, (event_id % 21 - 10) / 10.0 AS p, (event_id % 10) / 10.0 AS u FROM events),
j AS (SELECT b.symbol, b.ts_ns, e.p, e.u, (b.ts_ns - e.t) / 1e9::DOUBLE AS s FROM bars b LEFT JOIN ev e ON e.symbol = b.symbol AND e.t <= b.ts_ns AND b.ts_ns - e.t <= 604800000000000),
w AS (SELECT symbol, ts_ns, p, {_decay_sql('s', 'u', '7200.0', '72000.0')} AS w FROM j), a AS (SELECT symbol, ts_ns, least(1, greatest(-1, coalesce(sum(p * w * 0.25), 0))) AS s, count(*) FILTER (w > 1e-4) AS active_events FROM w GROUP BY 1, 2)
SELECT symbol, ts_ns, active_events, round(CASE WHEN abs(s) >= 0.15 THEN s ELSE 0 END, 4) AS target_weight FROM a""")
def _(spark, d):
    return portfolio.sentiment_signals(fx.bars(spark, d), sentiment_events(spark, d)).select("symbol", "ts_ns", "active_events", "target_weight")


def toy_signals(spark, d):
    """Two strategies from the bars: trend follows the bar, fade opposes it."""
    b = fx.bars(spark, d)
    move = F.least(F.greatest((F.col("close") - F.col("open")) / 97.31713, F.lit(-1.0)), F.lit(1.0))
    one = lambda name, sign: b.select(F.lit(name).alias("strategy"), "symbol", "ts_ns", (move * sign).alias("target_weight"), F.abs(move).alias("conviction"),
                                      F.lit(0.02).alias("stop_loss_pct"), F.lit(0.04).alias("take_profit_pct"))
    return one("trend", 1.0).unionByName(one("fade", -0.5))


TOY = f"{S.bars()}, mv AS (SELECT symbol, ts_ns, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (close - open) / 97.31713)) AS m FROM bars)"


@query("signal_blend", f"""WITH {TOY}, b AS (SELECT symbol, ts_ns, 0.7 * m + 0.3 * (-0.5 * m) AS w, abs(m) AS c FROM mv)
SELECT symbol, ts_ns, CASE WHEN w > 0.01 THEN 'LONG' WHEN w < -0.01 THEN 'SHORT' ELSE 'FLAT' END AS direction, round(CASE WHEN abs(w) > 0.01 THEN w ELSE 0 END, 4) AS target_weight, round(c, 4) AS conviction FROM b""")
def _(spark, d):
    s = toy_signals(spark, d)
    w = s.select("ts_ns", "strategy").distinct().withColumn("weight", F.when(F.col("strategy") == "trend", 0.7).otherwise(0.3))
    return portfolio.blend_signals(s, w).select("symbol", "ts_ns", "direction", "target_weight", "conviction")


def _weights_sql(names, rate=0.05, pull=0.2):
    """Growth by reward, normalised, then pulled to the prior of the hour's regime, row by row."""
    prior = lambda i: f"CASE WHEN k3 = 0 THEN {portfolio.REGIME_PRIORS['BULL'][i]} WHEN k3 = 1 THEN {portfolio.REGIME_PRIORS['PANIC'][i]} ELSE {portfolio.REGIME_PRIORS['NORMAL'][i]} END"
    grown = [f"{n} * exp({rate} * r{i})" for i, n in enumerate(names)]
    total = f"({' + '.join(grown)})"
    steps = ", ".join(f"(1 - {pull}) * {g} / {total} + {pull} * ({prior(i)})" for i, g in enumerate(grown))
    best = lambda u: f"coalesce(max(CASE WHEN symbol = '{u}' THEN ret END), 0)"
    rewards = ", ".join(f"{' + '.join(map(best, U[i :: len(names)]))} AS r{i}" for i in range(len(names)))
    return f"""WITH RECURSIVE {SMALL}, r AS (SELECT ts_ns, (ts_ns // {H}) % 3 AS k3, row_number() OVER (ORDER BY ts_ns) AS n, {rewards} FROM small GROUP BY ts_ns),
run AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ts_ns, {', '.join(f'{1 / len(names)}::DOUBLE AS {x}' for x in names)}
  UNION ALL SELECT r.n, r.ts_ns, {steps} FROM run JOIN r ON r.n = run.n + 1)
SELECT 'main' AS book, ts_ns, {', '.join(f'round({x}, 6) AS {x}' for x in names)} FROM run WHERE n > 0"""


@query("strategy_weights", _weights_sql(["s0", "s1", "s2", "s3"]))
def _(spark, d):
    names = ["s0", "s1", "s2", "s3"]
    best = {u: F.coalesce(F.max(F.when(F.col("symbol") == u, F.col("ret"))), F.lit(0.0)) for u in U}
    # A strategy's reward is that of its symbols; with more symbols than strategies they are dealt in turn.
    r = small_returns(spark, d).groupBy("ts_ns").agg(*[sum((best[u] for u in U[i :: len(names)][1:]), best[U[i]]).alias(n) for i, n in enumerate(names)])
    k = F.expr(f"ts_ns div {H}") % 3
    r = r.withColumn("book", F.lit("main")).withColumn("regime", F.when(k == 0, "BULL").when(k == 1, "PANIC").otherwise("NORMAL"))
    return rounded(portfolio.strategy_weights(r, names), 6, *names)


@query("leverage_scaling", f"""WITH {TOY}, t AS (SELECT ts_ns, sum(abs(m)) AS t FROM mv GROUP BY 1) SELECT symbol, ts_ns, round(m * CASE WHEN t > 1.000001 THEN 1 / t ELSE 1 END, 6) AS target_weight FROM mv JOIN t USING (ts_ns)""")
def _(spark, d):
    s = portfolio.scale_leverage(toy_signals(spark, d).filter("strategy = 'trend'"))
    return rounded(s.select("symbol", "ts_ns", "target_weight"), 6, "target_weight")


def weights(spark, d):
    """Cross-sectional weights on the aligned grid: the sign of the last return, a tenth each."""
    r = small_returns(spark, d)
    seq = series.sequenced(r)
    from tickloom.operators import blocks

    w = blocks.rolling(seq, ["symbol"], lambda f: {"target_weight": F.signum(F.coalesce(F.max("ret").over(f(-1, -1)), F.lit(0.0))) * 0.1}, back=1)
    return w.select("symbol", "ts_ns", "target_weight"), r


WTS = f"{SMALL}, wt AS (SELECT symbol, ts_ns, ret, sign(coalesce(lag(ret) OVER (PARTITION BY symbol ORDER BY ts_ns), 0)) * 0.1::DOUBLE AS w FROM small), dl AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts_ns), 0)) AS dw FROM wt)"
BT = f"{WTS}, bt AS (SELECT ts_ns, sum(w * ret) AS g, sum(dw) AS t, sum(w * ret) - sum(dw) * 0.0005::DOUBLE AS r FROM dl GROUP BY 1)"


@query("weights_backtest", f"WITH {BT} SELECT ts_ns, round(g, 6) AS gross_return, round(t, 6) AS turnover, round(r, 6) AS ret FROM bt")
def _(spark, d):
    return rounded(portfolio.backtest(*weights(spark, d)), 6, "gross_return", "turnover", "ret")


@query("backtest_equity", f"""WITH RECURSIVE {BT}, o AS (SELECT ts_ns, r, row_number() OVER (ORDER BY ts_ns) AS k FROM bt), e AS (SELECT k, ts_ns, greatest(1.0::DOUBLE, 1000000 * (1 + r)) AS eq FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.ts_ns, greatest(1.0::DOUBLE, eq * (1 + r)) FROM e JOIN o ON o.k = e.k + 1) SELECT ts_ns, round(ln(eq), 6) AS log_equity FROM e""")
def _(spark, d):
    e = portfolio.equity_with_floor(portfolio.backtest(*weights(spark, d)), 1e6)
    return e.select("ts_ns", F.round(F.log("equity"), 6).alias("log_equity"))


@query("trading_costs", f"""WITH {S.bars()}, c AS (SELECT ts_ns, abs((close - open) * 1000) AS a, greatest(ln(high / low), 0.005) AS v, greatest(close * volume, 1000000.0) AS adv FROM bars)
SELECT ts_ns, round(sum(a) * 0.0001, 6) AS fee_cost, round(sum(a) * 0.0002, 6) AS spread_cost, round(sum(0.1::DOUBLE / sqrt(adv) * v * a * sqrt(a)), 4) AS impact_cost FROM c GROUP BY 1""")
def _(spark, d):
    c = fx.bars(spark, d).select("ts_ns", ((F.col("close") - F.col("open")) * 1000).alias("delta"), F.greatest(F.log(F.col("high") / F.col("low")), F.lit(0.005)).alias("volatility"),
                                 F.greatest(F.col("close") * F.col("volume"), F.lit(1e6)).alias("adv"))
    out = portfolio.trading_costs(c).select("ts_ns", "fee_cost", "spread_cost", "impact_cost")
    return rounded(rounded(out, 6, "fee_cost", "spread_cost"), 4, "impact_cost")


def book(spark, d):
    w, r = weights(spark, d)
    p = w.select("symbol", "ts_ns", (F.col("target_weight") * 10_000.0).alias("dollars"))
    c = p.select("ts_ns").distinct().withColumn("cost", F.lit(0.25))
    return p, r, c


LED = f"""{WTS}, ps AS (SELECT symbol, ts_ns, ret, w * 10000 AS p, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts_ns), 0) * 10000 AS p0 FROM wt),
br AS (SELECT ts_ns, sum(p0 * ret) AS g, sum(p) AS net, sum(abs(p)) AS gr, sum(abs(p - p0)) AS tv FROM ps GROUP BY 1), le AS (SELECT *, 100000000 + sum(g - 0.25) OVER (ORDER BY ts_ns) AS eq FROM br),
lg AS (SELECT *, greatest(100000000, max(eq) OVER (ORDER BY ts_ns)) AS pk FROM le)"""


@query("portfolio_ledger", f"WITH {LED} SELECT ts_ns, round(g, 4) AS gross_pnl, round(eq, 3) AS equity, round(eq - net, 3) AS cash, round((pk - eq) / pk, 8) AS drawdown, round(gr / eq, 8) AS leverage FROM lg")
def _(spark, d):
    led = portfolio.portfolio_ledger(*book(spark, d), initial=1e8).select("ts_ns", "gross_pnl", "equity", "cash", "drawdown", "leverage")
    return rounded(rounded(rounded(led, 4, "gross_pnl"), 3, "equity", "cash"), 8, "drawdown", "leverage")


@query("book_turnover", f"WITH {LED} SELECT round(avg(tv / greatest(eq, 1)), 10) AS turnover FROM lg")
def _(spark, d):
    p, r, c = book(spark, d)
    return rounded(portfolio.turnover(p, portfolio.portfolio_ledger(p, r, c, 1e8)), 10, "turnover")


@query("parameter_sweep")
def _(spark, d):
    r = small_returns(spark, d).withColumn("volatility", F.lit(0.05))
    params = spark.range(12).select(
        F.col("id").alias("param_id"), (F.lit(10) + 10 * (F.col("id") % 2)).cast("int").alias("slow_bars"), (F.lit(3) + F.col("id") % 3).cast("int").alias("fast_bars"),
        (F.col("id") % 4 / 4.0).alias("blend"), (F.col("id") % 2 * 0.1).alias("hurdle"))
    return rounded(portfolio.parameter_sweep(r, params), 8, "mean_return", "mean_turnover", "sharpe")


@query("target_allocation", """WITH a AS (SELECT s_name AS symbol, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS close, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_nationkey - 12) / 12.0 END AS prior FROM supplier), n AS (SELECT count(*) AS n FROM a)
SELECT symbol, CASE WHEN close > 0 THEN least(round(10000000 * 0.60::DOUBLE / n * greatest(0, 1 + 0.5 * coalesce(prior, 0)), 2), 2000000.0) ELSE 0.0 END AS target_dollars FROM a CROSS JOIN n""")
def _(spark, d):
    s = fx.table(spark, d, "supplier")
    sym = F.col("s_name").alias("symbol")
    latest = s.filter("s_suppkey % 9 <> 0").select(sym, F.col("s_acctbal").alias("close"))
    priors = s.filter("s_suppkey % 4 <> 0").select(sym, ((F.col("s_nationkey") - 12) / 12.0).alias("prior"))
    return portfolio.target_allocation(s.select(sym), latest, priors, 1e7)


def risk_inputs(spark, d):
    f = fx.fills(spark, d)
    q = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = f.filter("line <= 5 OR symbol = 'N'").groupBy("portfolio_id", "symbol").agg(F.sum(q).alias("position"))
    leaves = f.filter("line > 5 AND symbol <> 'N'").groupBy("portfolio_id", "symbol").agg(F.sum(q).alias("leaves"))
    prices = f.groupBy("symbol").agg(F.round(F.avg("price"), 2).alias("price"))
    accounts = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("portfolio_id"), (F.col("s_acctbal") * 100 + 900000).alias("cash"), F.lit(1.0e6).alias("peak_equity"))
    return portfolio.symbol_exposure(held, leaves, prices), accounts


EXPO = f"""{FILLS}, he AS (SELECT portfolio_id, symbol, sum(q) AS p FROM sg WHERE line <= 5 OR symbol = 'N' GROUP BY 1, 2), lv AS (SELECT portfolio_id, symbol, sum(q) AS l FROM sg WHERE line > 5 AND symbol <> 'N' GROUP BY 1, 2),
px AS (SELECT symbol, round(avg(price), 2) AS px FROM fills GROUP BY 1), ex AS (SELECT portfolio_id, symbol, coalesce(p, 0) AS p, coalesce(l, 0) AS l, px FROM he FULL JOIN lv USING (portfolio_id, symbol) LEFT JOIN px USING (symbol)),
eg AS (SELECT *, CASE WHEN p * l < 0 THEN greatest(abs(p), abs(p + l)) ELSE abs(p) + abs(l) END * px AS g, (p + l) * px AS n, CASE WHEN l > 0 THEN l ELSE greatest(0, abs(l) - greatest(0, p)) END * px AS k FROM ex),
sn AS (SELECT s_suppkey AS portfolio_id, s_acctbal * 100 + 900000 AS cash, sum(p * px) AS h, sum(g) AS g, sum(n) AS n, sum(k) AS k FROM supplier JOIN eg ON portfolio_id = s_suppkey GROUP BY 1, 2),
ss AS (SELECT *, cash + h AS eq, cash - k AS fm, greatest(1000000, cash + h) AS pk FROM sn)"""


@query("exposure_snapshot", f"""WITH {EXPO} SELECT portfolio_id, round(eq, 2) AS equity, CASE WHEN eq <= 0 THEN -1 ELSE round(g / eq, 6) END AS gross_leverage, CASE WHEN eq <= 0 THEN -1 ELSE round(abs(n) / eq, 6) END AS net_leverage,
  round((pk - eq) / pk, 6) AS drawdown, round(fm, 2) AS free_margin FROM ss""")
def _(spark, d):
    expo, acc = risk_inputs(spark, d)
    s = portfolio.exposure_snapshot(expo, acc).select("portfolio_id", "equity", "gross_leverage", "net_leverage", "drawdown", "free_margin")
    fix = lambda c: F.when(F.col(c) == float("inf"), -1.0).otherwise(F.round(c, 6)).alias(c)
    return rounded(rounded(s.select("portfolio_id", "equity", fix("gross_leverage"), fix("net_leverage"), "drawdown", "free_margin"), 2, "equity", "free_margin"), 6, "drawdown")


LIMITS = {"drawdown": 0.9, "quantity": 45.0, "notional": 90000.0, "free_margin": -500000.0, "gross": 6.0, "net": 3.0, "concentration": 2.0}


@query("order_screen", f"""WITH {EXPO}, od AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS order_id, l_suppkey AS portfolio_id, l_returnflag AS symbol, l_quantity AS qty, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS sd, min(l_extendedprice) AS _e FROM lineitem GROUP BY 1, 2, 3, 4, 5),
j AS (SELECT o.order_id, o.portfolio_id, o.symbol, o.qty, sd, sd * qty AS dd, coalesce(e.p, 0) AS p, coalesce(e.l, 0) AS l, e.px, coalesce(e.g, 0) AS g0, coalesce(e.n, 0) AS n0, s.eq, s.g, s.n, s.fm, (s.pk - s.eq) / s.pk AS dw FROM od o LEFT JOIN eg e USING (portfolio_id, symbol) JOIN ss s USING (portfolio_id)),
k AS (SELECT *, greatest(0, qty - CASE WHEN sd = 1 THEN greatest(0, -p - greatest(0, l)) ELSE greatest(0, p - abs(least(0, l))) END) * px AS mg,
  CASE WHEN (p > 0 AND (dd < 0 OR l + dd < 0)) OR (p < 0 AND (dd > 0 OR l + dd > 0)) THEN greatest(abs(p), abs(p + l + dd)) ELSE abs(p) + abs(l + dd) END * px AS mine FROM j)
SELECT CASE WHEN dw >= 0.9 THEN 'DRAWDOWN' WHEN qty > 45 THEN 'QUANTITY' WHEN px IS NULL THEN 'NO_PRICE' WHEN qty * px > 90000 THEN 'NOTIONAL' WHEN mg > 0 AND fm - mg < -500000 THEN 'MARGIN' WHEN eq <= 0 THEN 'LEVERAGE' WHEN g - g0 + mine > 6 * eq THEN 'LEVERAGE'
  WHEN abs(n - n0 + (p + l + dd) * px) > 3 * eq THEN 'LEVERAGE' WHEN mine > 2 * eq THEN 'CONCENTRATION' ELSE 'OK' END AS code, count(*) AS n FROM k GROUP BY 1""")
def _(spark, d):
    expo, acc = risk_inputs(spark, d)
    li = fx.table(spark, d, "lineitem")
    orders = li.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("order_id"), F.col("l_suppkey").alias("portfolio_id"), F.col("l_returnflag").alias("symbol"),
                       F.col("l_quantity").alias("quantity"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.lit(None).cast("double").alias("price")).distinct()
    return portfolio.screen_orders(orders, expo, portfolio.exposure_snapshot(expo, acc), LIMITS).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_gate", """WITH o AS (SELECT event_id AS k, event_id % 5 = 0 AS b, event_id % 41 = 0 AS x, (event_id % 150)::DOUBLE AS age, (event_id % 21 - 10) / 20.0 AS im, (event_id % 40)::DOUBLE AS sp, (event_id % 13 - 8) / 10.0 AS ys, value / 100 AS br, 1.0::DOUBLE AS vo, event_id % 6 AS ls, (event_id % 17)::DOUBLE AS dd FROM events),
f AS (SELECT *, NOT b AS buy, age > 120 AS stale, (NOT b AND im < -0.35) OR (b AND im > 0.35) AS ag, sp > 35 AS wd, NOT b AND ys < -0.5 AS inv, abs(br) > 3 * vo AS spk, NOT b AND br < -2 * vo AS dv, ls >= 4 AS st, dd >= 15 AS dp FROM o),
p AS (SELECT *, 1 / (1 + exp(-(ln(0.1::DOUBLE / 0.9) + CASE WHEN stale THEN 2.5 ELSE 0 END + CASE WHEN ag THEN 2 * abs(im) WHEN wd THEN 1.5 ELSE 0 END + CASE WHEN inv THEN 1.5 * abs(ys) ELSE 0 END + CASE WHEN spk THEN 1.2 ELSE 0 END + CASE WHEN dv THEN 1 ELSE 0 END
  + CASE WHEN st THEN 1.8 * (ls - 3) ELSE 0 END + CASE WHEN dp THEN 2.5 ELSE 0 END))) AS p FROM f), q AS (SELECT *, stale OR ag OR wd OR inv OR spk OR dv OR st OR dp OR p >= 0.65 AS bad FROM p)
SELECT k AS order_id, CASE WHEN x THEN 'BYPASS_EXIT' WHEN bad THEN 'REJECT' ELSE 'PASS' END AS decision, CASE WHEN x THEN 0 ELSE round(p, 4) END AS toxicity,
  CASE WHEN x OR NOT bad THEN 'OK' WHEN stale THEN 'ERR-GATE-001' WHEN ag OR wd THEN 'ERR-GATE-005' WHEN inv THEN 'ERR-GATE-002' WHEN st THEN 'ERR-GATE-004' WHEN dp THEN 'ERR-GATE-003' WHEN p >= 0.65 THEN 'ERR-GATE-005' ELSE 'OK' END AS code FROM q""")
def _(spark, d):
    k = F.col("event_id")
    o = fx.ticks(spark, d).select(
        k.alias("order_id"), F.when(k % 5 == 0, "SELL").otherwise(" buy ").alias("action"), (k % 41 == 0).alias("is_exit"), (k % 150).cast("double").alias("data_age_s"), ((k % 21 - 10) / 20.0).alias("imbalance"),
        (k % 40).cast("double").alias("spread_bps"), ((k % 13 - 8) / 10.0).alias("yield_spread"), (F.col("price") / 100).alias("bar_return_pct"), F.lit(1.0).alias("volatility_pct"), (k % 6).alias("losses"), (k % 17).cast("double").alias("drawdown_pct"))
    return portfolio.evidence_gate(o).select("order_id", "decision", "toxicity", "code")


def scenarios(spark, d):
    """Scenario = part of the sample by hour; candidates are parts with weights from their keys."""
    r = small_returns(spark, d)
    sc = F.concat(F.lit("S"), (F.expr(f"ts_ns div {H}") % 3).cast("string"))
    mu = r.groupBy(sc.alias("scenario"), "symbol").agg(F.avg("ret").alias("mu"))
    covs = None
    for k in range(3):
        c = stats.correlation_table(r.filter(F.expr(f"ts_ns div {H}") % 3 == k), U).select(F.lit(f"S{k}").alias("scenario"), "s1", "s2", F.col("covariance").alias("cov"))
        covs = c if covs is None else covs.unionByName(c)
    p = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.posexplode(F.array(*[F.lit(u) for u in U])).alias("i", "symbol"))
    cand = p.select("id", "symbol", ((F.col("id") * (F.col("i") + 3)) % 7 / 30.0).alias("w"))
    init = spark.createDataFrame([(u, 0.1) for u in U], "symbol string, w0 double")
    return portfolio.scenario_regret(cand, init, mu, covs, [0, 1, 2, 3], rf=0.001)


REGRET = f"""{SMALL}, t AS (SELECT *, 'S' || ((ts_ns // {H}) % 3) AS scenario FROM small), mu AS (SELECT scenario, symbol, avg(ret) AS mu FROM t GROUP BY 1, 2),
cv AS (SELECT a.scenario, a.symbol AS s1, b.symbol AS s2, covar_samp(a.ret, b.ret) AS cov FROM t a JOIN t b USING (ts_ns) GROUP BY 1, 2, 3),
ca AS (SELECT s_suppkey AS id, u.symbol, (s_suppkey * (u.i + 3)) % 7 / 30.0 AS w FROM supplier CROSS JOIN (SELECT unnest({U!r}) AS symbol, unnest([0, 1, 2, 3, 4]) AS i) u),
ln AS (SELECT id, scenario, sum(w * mu) AS m FROM ca JOIN mu USING (symbol) GROUP BY 1, 2), qd AS (SELECT a.id, scenario, sum(a.w * b.w * cov) AS q FROM cv JOIN ca a ON a.symbol = s1 JOIN ca b ON b.symbol = s2 AND b.id = a.id GROUP BY 1, 2),
ow AS (SELECT id, sum(w) AS w, sum(abs(w - 0.1)) * 0.001 AS c FROM ca GROUP BY 1), ut AS (SELECT id, scenario, m + greatest(0, 1 - w) * 0.001 - 0.75 * q - c AS u FROM ln JOIN qd USING (id, scenario) JOIN ow USING (id)),
tp AS (SELECT scenario, max(u) AS t FROM ut WHERE id IN (0, 1, 2, 3) GROUP BY 1),
rg AS (SELECT id, scenario, u, greatest(0, t - u) AS regret FROM ut JOIN tp USING (scenario))"""


@query("scenario_regret", f"WITH {REGRET} SELECT id, scenario, round(u, 6) AS utility, round(regret, 6) AS regret FROM rg")
def _(spark, d):
    return rounded(scenarios(spark, d), 6, "utility", "regret")


@query("worst_case_regret", f"WITH {REGRET} SELECT id, round(max(regret), 6) AS worst_regret, last(scenario ORDER BY regret, scenario) AS worst_scenario FROM rg GROUP BY 1")
def _(spark, d):
    return rounded(portfolio.worst_case(scenarios(spark, d)), 6, "worst_regret")


@query("capped_weights", f"""WITH {S.bars()}, w AS (SELECT ts_ns, symbol, 1 / greatest(ln(high / low), 0.05) AS r FROM bars),
n AS (SELECT ts_ns, symbol, r / sum(r) OVER (PARTITION BY ts_ns) AS w, count(*) OVER (PARTITION BY ts_ns) AS n FROM w),
-- excess over the cap goes in equal parts to the others, again and again; six passes do for five symbols
l AS (SELECT ts_ns, list(symbol ORDER BY symbol) AS s, list(w ORDER BY symbol) AS w0 FROM n GROUP BY ts_ns),
f AS (SELECT ts_ns, s, list_reduce([w0] || list_transform([1, 2, 3, 4, 5, 6], lambda k: w0), lambda a, b: CASE WHEN list_max(a) <= 0.3 OR len(list_filter(a, lambda x: x < 0.3)) = 0 THEN list_transform(a, lambda x: least(x, 0.3))
  ELSE list_transform(a, lambda x: CASE WHEN x >= 0.3 THEN 0.3 ELSE x + list_sum(list_transform(a, lambda y: greatest(y - 0.3, 0))) / len(list_filter(a, lambda y: y < 0.3)) END) END) AS wf FROM l)
SELECT ts_ns, unnest(s) AS symbol, round(unnest(wf), 6) AS weight FROM f""")
def _(spark, d):
    raw = fx.bars(spark, d).select("ts_ns", "symbol", (1.0 / F.greatest(F.log(F.col("high") / F.col("low")), F.lit(0.05))).alias("raw_weight"))
    return rounded(kernels.cap_weights(raw), 6, "weight")


CUSUM_RUN = """run AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ts_ns, false AS alarm, false AS is_negative, 0.0::DOUBLE AS s_pos, 0.0::DOUBLE AS s_neg, 0 AS dwell FROM z GROUP BY symbol
  UNION ALL SELECT symbol, k, ts_ns, hit, hit AND down >= 3.0, CASE WHEN hit THEN 0.0 ELSE up END, CASE WHEN hit THEN 0.0 ELSE down END, CASE WHEN hit THEN 0 ELSE dw END
  FROM (SELECT *, (up >= 3.0 OR down >= 3.0) AND dw >= 3 AS hit FROM (
    SELECT z.symbol, z.k, z.ts_ns, least(dwell + 1, 3) AS dw, greatest(0, s_pos + z - 0.5) AS up, greatest(0, s_neg - z - 0.5) AS down FROM run JOIN z ON z.symbol = run.symbol AND z.k = run.k + 1)))
SELECT symbol, ts_ns, alarm, is_negative, round(s_pos, 6) AS s_pos, round(s_neg, 6) AS s_neg FROM run WHERE k > 0"""


@query("cusum_reset", f"""WITH RECURSIVE {SMALL}, a AS (SELECT symbol, ts_ns, ret, row_number() OVER v AS k, sum(ret) OVER v AS s, sum(ret * ret) OVER v AS ss FROM small WINDOW v AS (PARTITION BY symbol ORDER BY ts_ns)),
v AS (SELECT *, greatest((ss - s * s / k) / (k - 1), 0) AS var FROM a),
z AS (SELECT symbol, ts_ns, k, (ret - CASE WHEN k >= 2 THEN s / k ELSE 0 END) / CASE WHEN k < 2 THEN greatest(abs(ret), 0.01) WHEN var > 1e-12 THEN sqrt(var) ELSE 0.01 END AS z FROM v),
{CUSUM_RUN}""")
def _(spark, d):
    return rounded(kernels.cusum_with_reset(series.expanding_z(small_returns(spark, d))), 6, "s_pos", "s_neg")


SHOCK = f"""{ENTROPY}, shk AS (SELECT ts_ns, row_number() OVER (ORDER BY ts_ns) AS k, least(1, greatest(0, 0.5 * h * sqrt(rho) + 0.3 * rho + 0.2 * least(1, greatest(0, (1 + (ts_ns // {H}) % 6 - 1.0) / 4.0)))) AS shock, (ts_ns // {H}) % 97 = 0 AS panic FROM en),
cut AS (SELECT *, least(1, greatest(0, (1 / (1 + exp(10.0 * (shock - 0.5))) - 1 / (1 + exp(5.0))) / (1 / (1 + exp(-5.0)) - 1 / (1 + exp(5.0))))) AS haircut FROM shk)"""


@query("tier_hysteresis", f"""WITH RECURSIVE {SHOCK},
run AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS ts_ns, 0 AS tier, CAST(0 AS BIGINT) AS bars, 0.0::DOUBLE AS cut
  UNION ALL SELECT k, ts_ns, CASE WHEN want > tier THEN want WHEN want < tier AND shock < 0.3 AND (tier = 1 OR bars >= 5) THEN tier - 1 ELSE tier END,
    CASE WHEN want > tier OR (want < tier AND shock < 0.3 AND (tier = 1 OR bars >= 5)) THEN 1 ELSE bars + 1 END, haircut
  FROM (SELECT c.*, run.tier, run.bars, CASE WHEN panic OR shock >= 0.9 THEN 3 WHEN shock >= 0.7 THEN 2 WHEN shock >= 0.45 THEN 1 ELSE 0 END AS want FROM run JOIN cut c ON c.k = run.k + 1))
SELECT 'main' AS book, ts_ns, ['NORMAL', 'CAUTION', 'DERISK', 'HALT'][tier + 1] AS tier, bars AS bars_in_tier, round(CASE WHEN tier >= 2 THEN 0.0 WHEN tier = 1 THEN least(0.5, cut) ELSE cut END, 6) AS execution_haircut FROM run WHERE k > 0""")
def _(spark, d):
    s = stats.shock_and_haircut(entropy(spark, d), (1 + F.expr(f"ts_ns div {H}") % 6).cast("double"))
    books = s.select(F.lit("main").alias("book"), "ts_ns", "shock", "haircut", (F.expr(f"ts_ns div {H}") % 97 == 0).alias("panic"))
    return rounded(kernels.tier_hysteresis(books), 6, "execution_haircut")


@query("regime_filter")
def _(spark, d):
    return rounded(kernels.regime_filter(small_returns(spark, d), U), 6, "p_calm", "p_trend", "p_panic", "effective_sample_size", "temperature")


@query("shrunk_covariance")
def _(spark, d):
    return rounded(kernels.rolling_shrunk_covariance(small_returns(spark, d), U), 6, "cov")


@query("frac_diff_inverse", f"""WITH {SEQ}, {ffd_weights('seqd')} SELECT s.symbol, ts_ns, round(close, 4) AS value FROM seqd s JOIN lb ON lb.symbol = s.symbol WHERE seq > l""")
def _(spark, d):
    """Differencing and rebuilding gives the close back."""
    b = fx.bars(spark, d)
    diff = filters.frac_diff(b, FFD_D, FFD_CUT)
    back = filters.lookbacks(b, len(FFD_W) - 1)
    head = series.sequenced(b).join(back, "symbol").filter(F.col("seq") <= F.col("lookback")).groupBy("symbol", "lookback").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "close"))), lambda e: e["close"]).alias("anchor"))
    return rounded(filters.inverse_frac_diff(diff.select("symbol", "ts_ns", "ffd"), head, FFD_D, FFD_CUT), 4, "value")


GRID = [round(i * 0.05, 2) for i in range(21)]


@query("stationarity_search")
def _(spark, d):
    stat, _best = kernels.stationarity_search(fx.bars(spark, d), GRID)
    return rounded(stat, 6, "adf_stat", "adf_p", "correlation")
