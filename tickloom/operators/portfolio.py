"""Signals to positions, costs, ledgers, exposures and order screens."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import blocks, kernels, series
from tickloom.operators.blocks import Running

# Strategy weights per regime, in the order of the four sub-strategies.
REGIME_PRIORS = {
    "NORMAL": (0.25, 0.25, 0.25, 0.25), "BULL": (0.10, 0.45, 0.20, 0.25), "BEAR": (0.15, 0.45, 0.15, 0.25),
    "PANIC": (0.05, 0.15, 0.30, 0.50), "MEAN_REVERTING": (0.50, 0.10, 0.20, 0.20), "EVENT_DRIVEN": (0.10, 0.15, 0.55, 0.20),
}


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def momentum_signals(bars: DataFrame, weights: list[float], fast: int = 8, slow: int = 21, vol_lookback: int = 20, max_leverage: float = 1.0) -> DataFrame:
    """Fractional-difference momentum: tanh of the scaled average spread, inverse-volatility weights.

    The cross-section total is one sum per timestamp, joined back.
    """
    ffd = series.frac_diff_expanding(bars, weights).select("symbol", "ts_ns", "seq", "ffd")
    ema = series.ema_many(ffd, "ffd", {"fast_ema": 2.0 / (fast + 1.0), "slow_ema": 2.0 / (slow + 1.0)})
    spread = ema.withColumn("_sp", F.col("fast_ema") - F.col("slow_ema"))
    scored = blocks.rolling(spread, ["symbol"], lambda f: {
        "score": F.tanh(F.col("_sp") / F.greatest(F.stddev_pop("_sp").over(f(1 - slow, 0)), F.lit(1e-5)))}, back=slow)
    vols = series.annualised_vol(bars, vol_lookback).select("symbol", "ts_ns", "ann_vol")
    j = scored.join(vols, ["symbol", "ts_ns"]).withColumn("_iv", F.col("score") / F.col("ann_vol"))
    total = j.groupBy("ts_ns").agg(F.sum(F.abs("_iv")).alias("_t"))
    w = F.when(F.col("_t") > 1e-8, F.col("_iv") / F.col("_t") * max_leverage).otherwise(0.0)
    w = F.when(F.abs(w) > 0.01, w).otherwise(0.0)
    daily = F.col("ann_vol") / math.sqrt(252.0)
    return j.join(total, "ts_ns").select(
        "symbol", "ts_ns", F.round(w, 5).alias("target_weight"), F.round(F.least(F.lit(1.0), F.abs("score")), 4).alias("conviction"),
        direction(w, 0.0).alias("direction"), F.lit(slow).alias("horizon_bars"), F.round(2.0 * daily, 4).alias("stop_loss_pct"), F.round(4.0 * daily, 4).alias("take_profit_pct"))


def direction(weight: Column, band: float) -> Column:
    return F.when(weight > band, "LONG").when(weight < -band, "SHORT").otherwise("FLAT")


def breakout_signals(bars: DataFrame, n_symbols: int, max_leverage: float = 1.0, expansion: float = 1.3) -> DataFrame:
    """Band break-outs confirmed by volatility expansion; volume adds conviction."""
    b = series.bollinger(series.sequenced(bars))
    wide = F.col("vol_expansion") >= expansion
    up = (F.col("close") > F.col("upper_band")) & (F.col("prev_close") <= F.col("upper_band")) & wide
    down = (F.col("close") < F.col("lower_band")) & (F.col("prev_close") >= F.col("lower_band")) & wide
    conv = F.when(up | down, F.when(F.col("volume_confirmed"), 0.9).otherwise(0.6)).otherwise(0.0)
    atr = F.col("mean_range") / F.col("close")
    signed = F.when(up, 1.0).when(down, -1.0).otherwise(0.0) * (max_leverage / n_symbols) * conv
    return b.select(
        "symbol", "ts_ns", F.when(up, "LONG").when(down, "SHORT").otherwise("FLAT").alias("direction"), F.round(signed, 4).alias("target_weight"),
        F.round(conv, 4).alias("conviction"), F.lit(10).alias("horizon_bars"),
        F.round(F.greatest(F.lit(0.01), atr * 2.0), 4).alias("stop_loss_pct"), F.round(F.greatest(F.lit(0.02), atr * 3.5), 4).alias("take_profit_pct"))


def pairs_signals(bars: DataFrame, pairs: Sequence[tuple[str, str]], lookback: int = 60, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, max_leverage: float = 1.0) -> DataFrame:
    """Kalman pairs: per pair (y, x), z-score bands with a carried position.

    The position is the last decision made (entry, exit or stop), carried forward over
    the bars between the bands.
    """
    k = kernels.kalman_hedges(bars, pairs)
    z = series.rolling_z(k, "spread", lookback, keys=["y", "x"])
    zc = F.col("z")
    decided = F.when(F.abs(zc) >= stop, 0).when(zc >= entry, -1).when(zc <= -entry, 1).when(F.abs(zc) <= leave, 0)
    held = blocks.running(z.withColumn("_d", decided), ["y", "x"], ["ts_ns"], blocks.time_block("ts_ns"), {"position": Running("last", F.col("_d"))})
    pos = F.coalesce("position", F.lit(0))
    ratio = F.when(F.col("y_price") > 0, F.col("x_price") / F.greatest("y_price", F.lit(1e-6))).otherwise(1.0)
    beta = F.greatest(F.lit(0.01), F.abs("beta") * ratio)
    wy = pos * max_leverage / (1.0 + beta)
    wx = -pos * F.when(F.col("beta") >= 0, 1.0).otherwise(-1.0) * max_leverage * beta / (1.0 + beta)
    fresh = F.abs(zc) >= entry
    conv = F.when(pos == 0, 0.0).when(fresh, 0.5 + 0.5 * F.least(F.lit(1.0), (F.abs(zc) - entry) / 2.0)).otherwise(0.5)
    return held.select("y", "x", "ts_ns", "z", "alpha", "beta", pos.alias("position"), wy.alias("weight_y"), wx.alias("weight_x"), conv.alias("conviction"))


def sentiment_signals(grid: DataFrame, events: DataFrame, threshold: float = 0.15, fast_s: float = 7200.0, max_leverage: float = 1.0,
                      horizon_s: int = 604_800, bucket_s: int = 86_400, parts: int = 16) -> DataFrame:
    """Decayed polarity sum of each symbol's past events at every (symbol, ts_ns) of ``grid``.

    Events join by (symbol, day) and are copied to the days their horizon reaches, so the
    join has an equality key of bounded time extent. The events of a symbol and day are dealt over
    ``parts`` groups by their values, each with its copy of the grid, so none is read by one task alone.
    """
    day = bucket_s * 1_000_000_000
    g = grid.select("symbol", "ts_ns").withColumn("_b", F.expr(f"ts_ns div {day}")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    reach = horizon_s // bucket_s + 1
    e = events.select("symbol", F.col("ts_ns").alias("_t"), "polarity", "urgency", "centrality").withColumn(
        "_b", F.explode(F.sequence(F.expr(f"_t div {day}"), F.expr(f"_t div {day} + {reach}")))).withColumn(
        "_part", F.pmod(F.xxhash64("_t", "polarity", "urgency", "centrality"), F.lit(parts)).cast("int"))
    lag = (F.col("ts_ns") - F.col("_t")) / 1e9
    w = text.decay(lag, F.col("urgency"), fast=fast_s, slow=fast_s * 10.0)
    hits = g.join(e, ["symbol", "_b", "_part"]).filter((F.col("_t") <= F.col("ts_ns")) & (lag <= horizon_s)).withColumn("_w", w)
    sums = hits.groupBy("symbol", "ts_ns").agg(
        F.sum(F.col("polarity") * F.col("_w") * F.col("centrality")).alias("_s"), F.count(F.when(F.col("_w") > 1e-4, 1)).alias("active_events"))
    j = grid.select("symbol", "ts_ns").join(sums, ["symbol", "ts_ns"], "left")
    s = _clip(F.coalesce("_s", F.lit(0.0)), -1.0, 1.0)
    live = F.abs(s) >= threshold
    return j.select("symbol", "ts_ns", F.coalesce("active_events", F.lit(0)).cast("long").alias("active_events"),
                    F.round(F.when(live, s * max_leverage).otherwise(0.0), 4).alias("target_weight"), F.round(F.when(live, F.abs(s)).otherwise(0.0), 4).alias("conviction"))


def blend_signals(signals: DataFrame, weights: DataFrame, max_leverage: float = 1.0) -> DataFrame:
    """Weighted mix of strategies' signals (strategy, symbol, ts_ns, …) per symbol and time.

    ``weights`` has ts_ns, strategy, weight.
    """
    j = signals.join(weights, ["ts_ns", "strategy"])
    w = F.col("weight")
    a = j.groupBy("ts_ns", "symbol").agg(
        F.sum(w * F.col("target_weight")).alias("_w"), F.sum(w * F.col("conviction")).alias("_c"), F.avg("stop_loss_pct").alias("_s"), F.avg("take_profit_pct").alias("_t"),
        (-F.sum(w * F.log(F.greatest(w, F.lit(1e-12))))).alias("_h"))
    raw = F.col("_w")
    return a.select("ts_ns", "symbol", direction(raw, 0.01).alias("direction"),
                    F.round(F.when(F.abs(raw) > 0.01, _clip(raw, -max_leverage, max_leverage)).otherwise(0.0), 4).alias("target_weight"),
                    F.round(_clip(F.col("_c"), 0.0, 1.0), 4).alias("conviction"), F.round(F.coalesce("_s", F.lit(0.02)), 4).alias("stop_loss_pct"),
                    F.round(F.coalesce("_t", F.lit(0.04)), 4).alias("take_profit_pct"), F.round("_h", 4).alias("entropy"))


def strategy_weights(rewards: DataFrame, strategies: Sequence[str], rate: float = 0.05, prior_weight: float = 0.2, span_ns: int = 30 * blocks.DAY_NS) -> DataFrame:
    """Multiplicative weights after each reward row, pulled to the regime prior.

    ``rewards`` has book, ts_ns, regime (any case) and one reward column per strategy. Before
    normalisation a row maps the weights linearly: with growth g = exp(rate * reward) and prior p
    the new ones are (1 - a) g w + a p (g . w). So blocks are composed as matrices, without a loop
    over them, and weights are only scaled to sum 1 for output.
    """
    names = list(strategies)

    def steps(pdf: pd.DataFrame):
        growth = np.exp(rate * pdf[names].to_numpy(dtype=float))
        for label, g in zip(pdf["regime"], growth):
            pull = np.array(REGIME_PRIORS.get(str(label).upper(), REGIME_PRIORS["NORMAL"]))
            yield g[:, None] / g.max(), pull[:, None] if len(pull) == len(names) else None

    def move(w: np.ndarray, g: np.ndarray, pull: np.ndarray | None) -> np.ndarray:
        grown = g * w
        out = grown if pull is None else (1.0 - prior_weight) * grown + prior_weight * pull * grown.sum(axis=0)
        return out / np.abs(out).max()

    def advance(pdf: pd.DataFrame, states: np.ndarray, forced: bool) -> np.ndarray:
        for g, pull in steps(pdf):
            states = move(states, g, pull)
        return states

    def emit(pdf: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        w, rows = state[:, None], []
        for g, pull in steps(pdf):
            w = move(w, g, pull)
            rows.append(w[:, 0] / w.sum())
        return pd.concat([pdf[["book", "ts_ns"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "book string, ts_ns long, " + ", ".join(f"`{n}` double" for n in names)
    return blocks.linear_scan(rewards.select("book", "ts_ns", "regime", *names), ["book"], ["ts_ns"], blocks.time_block("ts_ns", span_ns),
                              advance, lambda pdf: np.ones(len(names)), emit, schema, projective=True)


def scale_leverage(signals: DataFrame, max_leverage: float = 1.0) -> DataFrame:
    """Scale a timestamp's weights down to the gross limit."""
    total = signals.groupBy("ts_ns").agg(F.sum(F.abs("target_weight")).alias("_t"))
    factor = F.when(F.col("_t") > max_leverage + 1e-6, max_leverage / F.col("_t")).otherwise(1.0)
    return signals.join(total, "ts_ns").withColumn("target_weight", F.col("target_weight") * factor).drop("_t")


def backtest(weights: DataFrame, returns: DataFrame, cost_bps: float = 5.0, initial: float = 1e6, keys: Sequence[str] = ()) -> DataFrame:
    """Net return and equity per bar of target weights (known before the bar) on returns.

    Joined by timestamp and symbol. Turnover is the absolute weight change per symbol;
    equity does not fall below 1.
    """
    by = [*keys, "symbol"]
    seq = blocks.index_rows(weights, by, ["ts_ns"], blocks.time_block("ts_ns"))
    moved = blocks.rolling(seq, by, lambda f: {"_dw": F.abs(F.col("target_weight") - F.coalesce(F.max("target_weight").over(f(-1, -1)), F.lit(0.0)))}, back=1)
    j = moved.join(returns.select("symbol", "ts_ns", "ret"), ["symbol", "ts_ns"])
    bar = j.groupBy(*keys, "ts_ns").agg(F.sum(F.col("target_weight") * F.col("ret")).alias("gross_return"), F.sum("_dw").alias("turnover"))
    return bar.withColumn("ret", F.col("gross_return") - F.col("turnover") * (cost_bps * 1e-4))


def equity_with_floor(bar_returns: DataFrame, initial: float, floor: float = 1.0) -> DataFrame:
    """Equity path max(E·(1+r), floor), in closed form.

    With P the running product of 1+r, the floored path is P·max(initial, max floor/P so
    far) as long as no factor is negative; a factor at or below zero resets to the floor
    and is clamped to a tiny positive number, which the floor then covers.
    """
    factor = F.greatest(F.col("ret") + 1.0, F.lit(1e-12))
    run = blocks.running(bar_returns.withColumn("_all", F.lit("a")), ["_all"], ["ts_ns"], blocks.Rows(), {"_s": Running("sum_min", F.log(factor))})
    lift = F.greatest(F.lit(math.log(initial)), F.lit(math.log(floor)) - F.col("_s_ext"))
    return run.withColumn("equity", F.exp(F.col("_s") + lift)).drop("_all", "_s", "_s_ext")


def trading_costs(changes: DataFrame, fee_bps: float = 1.0, half_spread_bps: float = 2.0, impact: float = 0.1, use_adv: bool = True) -> DataFrame:
    """Fee, half-spread and 3/2-power impact cost per ts_ns of position changes (delta, volatility, adv)."""
    a = F.abs("delta")
    k = F.lit(impact) / F.sqrt("adv") if use_adv else F.lit(impact)
    return changes.groupBy("ts_ns").agg(
        (F.sum(a) * (fee_bps * 1e-4)).alias("fee_cost"), (F.sum(a) * (half_spread_bps * 1e-4)).alias("spread_cost"),
        F.sum(k * F.col("volatility") * a * F.sqrt(a)).alias("impact_cost")).withColumn("cost", F.col("fee_cost") + F.col("spread_cost") + F.col("impact_cost"))


def portfolio_ledger(positions: DataFrame, returns: DataFrame, costs: DataFrame, initial: float = 1e6) -> DataFrame:
    """Per bar: gross and net PnL on the positions held before it, equity, cash, peak, drawdown, leverage.

    ``positions`` (symbol, ts_ns, dollars) are those after the bar; the first bar has no PnL.
    """
    seq = blocks.index_rows(positions, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns"))
    prior = blocks.rolling(seq, ["symbol"], lambda f: {"_p": F.coalesce(F.max("dollars").over(f(-1, -1)), F.lit(0.0))}, back=1)
    bar = prior.join(returns.select("symbol", "ts_ns", "ret"), ["symbol", "ts_ns"]).groupBy("ts_ns").agg(
        F.sum(F.col("_p") * F.col("ret")).alias("gross_pnl"), F.sum("dollars").alias("_net"), F.sum(F.abs("dollars")).alias("_gross"))
    net = bar.join(costs.select("ts_ns", F.col("cost").alias("friction")), "ts_ns", "left").fillna(0.0, ["friction"]).withColumn(
        "net_pnl", F.col("gross_pnl") - F.col("friction")).withColumn("_all", F.lit("a"))
    run = blocks.running(net, ["_all"], ["ts_ns"], blocks.Rows(), {"_c": Running("sum_max", F.col("net_pnl"))})
    equity = F.col("_c") + initial
    return run.withColumns({"equity": equity, "peak": F.greatest(F.col("_c_ext") + initial, F.lit(initial))}).withColumns({
        "cash": F.col("equity") - F.col("_net"), "drawdown": _clip((F.col("peak") - F.col("equity")) / F.col("peak"), 0.0, 1.0),
        "leverage": F.when(F.col("equity") > 0, F.col("_gross") / F.col("equity")).otherwise(0.0)}).drop("_all", "_c", "_c_ext", "_net", "_gross")


def turnover(positions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Mean over bars of Σ|Δposition| over equity (at least 1)."""
    seq = blocks.index_rows(positions, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns"))
    moved = blocks.rolling(seq, ["symbol"], lambda f: {"_d": F.abs(F.col("dollars") - F.coalesce(F.max("dollars").over(f(-1, -1)), F.lit(0.0)))}, back=1)
    bar = moved.groupBy("ts_ns").agg(F.sum("_d").alias("_d")).join(ledger.select("ts_ns", "equity"), "ts_ns")
    return bar.agg(F.avg(F.col("_d") / F.greatest("equity", F.lit(1.0))).alias("turnover"))


def parameter_sweep(inputs: DataFrame, params: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """Score many (slow, fast, blend, hurdle) rows on one universe in a single job.

    Averages depend only on the span, so each distinct span is computed once per symbol;
    parameter rows then pick their two spans by key. ``params`` has param_id, slow_bars,
    fast_bars, blend, hurdle.
    """
    spans = sorted({int(r[0]) for r in params.select(F.explode(F.array("slow_bars", "fast_bars")).alias("s")).distinct().collect()})
    lagged = blocks.rolling(series.sequenced(inputs), ["symbol"], lambda f: {
        "_r": F.coalesce(F.max("ret").over(f(-1, -1)), F.lit(0.0)), "_v": F.greatest(F.max("volatility").over(f(-1, -1)), F.lit(1e-4))}, back=1)
    for s in spans:
        lagged = series.ema_many(lagged, "_r", {f"_e{s}": 2.0 / (s + 1.0)}, seed_first=False)
    values = F.map_from_arrays(F.array(*[F.lit(s) for s in spans]), F.array(*[F.col(f"_e{s}") for s in spans]))
    wide = lagged.select("symbol", "ts_ns", "seq", "ret", "_v", values.alias("_e"))
    rows = params.agg(F.collect_list(F.struct("param_id", "slow_bars", "fast_bars", "blend", "hurdle"))).scalar()
    p = wide.select("symbol", "ts_ns", "seq", "ret", "_v", "_e", F.explode(rows).alias("p"))
    mix = F.col("p.blend") * F.element_at("_e", F.col("p.fast_bars")) + (1.0 - F.col("p.blend")) * F.element_at("_e", F.col("p.slow_bars"))
    live = (F.col("seq") > 1) & (F.abs(mix) >= F.col("p.hurdle") * F.col("_v"))
    w = p.select(F.col("p.param_id").alias("param_id"), "symbol", "ts_ns", "ret", F.when(live, F.signum(mix)).otherwise(0.0).alias("_raw"))
    gross = w.groupBy("param_id", "ts_ns").agg(F.sum(F.abs("_raw")).alias("_g"))
    scaled = w.join(gross, ["param_id", "ts_ns"]).withColumn("target_weight", F.when(F.col("_g") > 1.0, F.col("_raw") / F.col("_g")).otherwise(F.col("_raw")))
    bt = backtest(scaled.select("param_id", "symbol", "ts_ns", "target_weight"), inputs, cost_bps, keys=["param_id"])
    sd = F.stddev_pop("ret")
    return bt.groupBy("param_id").agg(F.count(F.lit(1)).alias("bars"), F.avg("ret").alias("mean_return"), F.avg("turnover").alias("mean_turnover"),
                                      F.when(sd > 1e-8, F.avg("ret") / sd * math.sqrt(252.0)).otherwise(0.0).alias("sharpe"))


def target_allocation(assets: DataFrame, latest: DataFrame, priors: DataFrame, equity: float) -> DataFrame:
    """60% of equity in equal parts times (1 + prior/2), rounded, capped at 20%; zero without a price."""
    n = assets.agg(F.count(F.lit(1))).scalar()
    j = assets.join(latest, "symbol", "left").join(priors, "symbol", "left")
    each = F.round(equity * 0.60 / n * F.greatest(F.lit(0.0), 1.0 + 0.5 * F.coalesce("prior", F.lit(0.0))), 2)
    return j.select("symbol", F.when(F.col("close") > 0, F.least(each, F.lit(equity * 0.20))).otherwise(0.0).alias("target_dollars"))


def symbol_exposure(held: DataFrame, leaves: DataFrame, prices: DataFrame) -> DataFrame:
    """Per (portfolio, symbol): position, pending leaves, price, gross, net and locked notional."""
    j = held.join(leaves, ["portfolio_id", "symbol"], "full").fillna(0.0, ["position", "leaves"]).join(prices, "symbol", "left")
    p, l, px = F.col("position"), F.col("leaves"), F.col("price")
    offset = ((p > 0) & (l < 0)) | ((p < 0) & (l > 0))
    return j.withColumns({
        "gross": F.when(offset, F.greatest(F.abs(p), F.abs(p + l))).otherwise(F.abs(p) + F.abs(l)) * px, "net": (p + l) * px,
        "locked": F.when(l > 0, l).otherwise(F.greatest(F.lit(0.0), F.abs(l) - F.greatest(F.lit(0.0), p))) * px})


def exposure_snapshot(exposure: DataFrame, accounts: DataFrame) -> DataFrame:
    """Equity, gross and net leverage, drawdown and free margin per portfolio (cash, peak_equity)."""
    s = exposure.groupBy("portfolio_id").agg(F.sum(F.col("position") * F.col("price")).alias("_h"), *[F.sum(c).alias(f"_{c}") for c in ("gross", "net", "locked")])
    j = accounts.join(s, "portfolio_id", "left").fillna(0.0, ["_h", "_gross", "_net", "_locked"]).withColumn("equity", F.col("cash") + F.col("_h"))
    e, inf = F.col("equity"), F.lit(float("inf"))
    peak = F.greatest("peak_equity", e)
    dd = F.when(peak <= 0, F.when(e <= 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.try_divide(peak - e, peak)))
    return j.select("portfolio_id", "cash", "equity", F.when(e <= 0, inf).otherwise(F.try_divide(F.col("_gross"), e)).alias("gross_leverage"),
                    F.when(e <= 0, inf).otherwise(F.try_divide(F.abs("_net"), e)).alias("net_leverage"), dd.alias("drawdown"), (F.col("cash") - F.col("_locked")).alias("free_margin"),
                    F.col("_gross").alias("gross_notional"), F.col("_net").alias("net_notional"))


def screen_orders(orders: DataFrame, exposure: DataFrame, snapshot: DataFrame, limits: dict[str, float]) -> DataFrame:
    """First failing limit per candidate order against its portfolio's snapshot, else OK.

    Projected totals are the snapshot totals with the order's symbol exchanged, so each
    order needs two key lookups and no scan of its portfolio.
    """
    cur = exposure.select("portfolio_id", "symbol", F.col("position").alias("_p"), F.col("leaves").alias("_l"), F.col("price").alias("_px"), F.col("gross").alias("_g"), F.col("net").alias("_n"))
    j = orders.join(cur, ["portfolio_id", "symbol"], "left").fillna(0.0, ["_p", "_l", "_g", "_n"]).join(snapshot, "portfolio_id")
    q, ref = F.col("quantity"), F.coalesce("price", "_px")
    buy = F.col("side") == "BUY"
    d = F.when(buy, q).otherwise(-q)
    p, l = F.col("_p"), F.col("_l")
    zero = F.lit(0.0)
    free = F.when(buy, F.greatest(zero, -p - F.greatest(zero, l))).otherwise(F.greatest(zero, p - F.abs(F.least(zero, l))))
    margin = F.greatest(zero, q - free) * ref
    equity = F.col("equity") + p * (ref - F.coalesce("_px", ref))
    offset = ((p > 0) & ((d < 0) | (l + d < 0))) | ((p < 0) & ((d > 0) | (l + d > 0)))
    mine = F.when(offset, F.greatest(F.abs(p), F.abs(p + l + d))).otherwise(F.abs(p) + F.abs(l + d)) * ref
    gross, net = F.col("gross_notional") - F.col("_g") + mine, F.col("net_notional") - F.col("_n") + (p + l + d) * ref
    code = (
        F.when(F.col("drawdown") >= limits["drawdown"], "DRAWDOWN").when(q > limits["quantity"], "QUANTITY").when(ref.isNull() | (ref <= 0), "NO_PRICE")
        .when(q * ref > limits["notional"], "NOTIONAL").when((margin > 0) & (F.col("free_margin") - margin < limits["free_margin"]), "MARGIN")
        .when(equity <= 0, "LEVERAGE").when(gross > limits["gross"] * equity, "LEVERAGE").when(F.abs(net) > limits["net"] * equity, "LEVERAGE")
        .when(mine > limits["concentration"] * equity, "CONCENTRATION").otherwise("OK"))
    return j.select("order_id", "portfolio_id", "symbol", code.alias("code"))


def evidence_gate(orders: DataFrame) -> DataFrame:
    """Pass, reject or bypass with probability, confidence and primary code from five checks.

    Columns: action, is_exit, data_age_s, imbalance, spread_bps, yield_spread, bar_return_pct,
    volatility_pct, losses, drawdown_pct.
    """
    c = F.col
    action = F.upper(F.trim("action"))
    buying = action.isin("BUY", "OPEN_LONG")
    exit_ = c("is_exit") | action.isin("CLOSE", "LIQUIDATE")
    stale = c("data_age_s") > 120.0
    against = (buying & (c("imbalance") < -0.35)) | (~buying & (c("imbalance") > 0.35))
    wide = c("spread_bps") > 35.0
    inverted = buying & (c("yield_spread") < -0.5)
    spike, dive = F.abs("bar_return_pct") > 3.0 * c("volatility_pct"), buying & (c("bar_return_pct") < -2.0 * c("volatility_pct"))
    streak, deep = c("losses") >= 4, c("drawdown_pct") >= 15.0
    odds = (
        F.lit(math.log(0.1 / 0.9)) + F.when(stale, 2.5).otherwise(0.0) + F.when(against, 2.0 * F.abs("imbalance")).when(wide, 1.5).otherwise(0.0)
        + F.when(inverted, 1.5 * F.abs("yield_spread")).otherwise(0.0) + F.when(spike, 1.2).otherwise(0.0) + F.when(dive, 1.0).otherwise(0.0)
        + F.when(streak, 1.8 * (c("losses") - 3)).otherwise(0.0) + F.when(deep, 2.5).otherwise(0.0))
    staged = orders.withColumn("_p", 1.0 / (1.0 + F.exp(-odds)))
    bad = stale | against | wide | inverted | spike | dive | streak | deep | (c("_p") >= 0.65)
    first = (F.when(stale, "ERR-GATE-001").when(against | wide, "ERR-GATE-005").when(inverted, "ERR-GATE-002").when(streak, "ERR-GATE-004").when(deep, "ERR-GATE-003")
             .when(c("_p") >= 0.65, "ERR-GATE-005").otherwise("OK"))
    return staged.select(
        "order_id", F.when(exit_, "BYPASS_EXIT").when(bad, "REJECT").otherwise("PASS").alias("decision"),
        F.when(exit_, 0.0).otherwise(F.round("_p", 4)).alias("toxicity"), F.when(exit_, 1.0).otherwise(F.round(_clip(F.abs(c("_p") - 0.65) / 0.65, 0.0, 1.0), 4)).alias("confidence"),
        F.when(exit_ | ~bad, "OK").otherwise(first).alias("code"))


def scenario_regret(candidates: DataFrame, initial: DataFrame, scenarios: DataFrame, covariance: DataFrame, benchmarks: Sequence[str], rf: float = 0.0,
                    risk_aversion: float = 1.0, shading: float = 0.25, cost_rate: float = 0.001) -> DataFrame:
    """Utility and regret of each candidate in each scenario; benchmark ids set the ceiling.

    ``candidates`` (id, symbol, w), ``initial`` (symbol, w0), ``scenarios`` (scenario, symbol,
    mu), ``covariance`` (scenario, s1, s2, cov). The quadratic form sums over covariance
    cells joined by symbol, candidates and scenarios meet on the symbol key only.
    """
    lin = candidates.join(scenarios, "symbol").groupBy("id", "scenario").agg(F.sum(F.col("w") * F.col("mu")).alias("_m"))
    left = candidates.select("id", F.col("symbol").alias("s1"), F.col("w").alias("w1"))
    right = candidates.select("id", F.col("symbol").alias("s2"), F.col("w").alias("w2"))
    quad = covariance.join(left, "s1").join(right, ["id", "s2"]).groupBy("id", "scenario").agg(F.sum(F.col("w1") * F.col("w2") * F.col("cov")).alias("_q"))
    own = candidates.join(initial, "symbol", "left").groupBy("id").agg(
        F.sum("w").alias("_w"), (F.sum(F.abs(F.col("w") - F.coalesce("w0", F.lit(0.0)))) * cost_rate).alias("_c"))
    u = lin.join(quad, ["id", "scenario"]).join(own, "id").withColumn(
        "utility", F.col("_m") + F.greatest(F.lit(0.0), 1.0 - F.col("_w")) * rf - (0.5 * risk_aversion + shading) * F.col("_q") - F.col("_c"))
    top = u.filter(F.col("id").isin(list(benchmarks))).groupBy("scenario").agg(F.max("utility").alias("_top"))
    return u.join(top, "scenario").select("id", "scenario", "utility", F.greatest(F.lit(0.0), F.col("_top") - F.col("utility")).alias("regret"))


def worst_case(regrets: DataFrame) -> DataFrame:
    return regrets.groupBy("id").agg(F.max("regret").alias("worst_regret"), F.max_by("scenario", F.struct("regret", "scenario")).alias("worst_scenario"))
