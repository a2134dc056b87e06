"""Barrier labels, meta-labels, probability calibration and bet sizing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks, series
from tickloom.operators.blocks import Running


@dataclass(frozen=True)
class Barriers:
    """Label parameters."""

    profit: float = 2.0
    stop: float = 1.0
    horizon: int = 60
    vol_window: int = 20
    vol_floor: float = 1e-4
    vol_cap: float = 0.5
    spread_bps: float = 1.0
    fee_bps: float = 2.0
    delay: int = 1
    log_barriers: bool = True
    sqrt_horizon: bool = False
    pessimistic: bool = True
    sign_at_expiry: bool = False
    tick_size: float | None = None


def triple_barrier(bars: DataFrame, cfg: Barriers = Barriers(), events: DataFrame | None = None,
                   block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Label events by the first barrier their path touches.

    Without ``events`` every bar with a full history and a full horizon is a long event.
    With ``events`` (symbol, seq, side in -1/0/1) the given bars are labelled and a path
    may end early at the last bar. The path is a forward frame of at most horizon + 1
    bars, so the labels cost one shuffle and no self-join.
    """
    seq = series.sequenced(bars)
    pk = F.pow(F.log(F.col("high") / F.col("low")), 2)

    def history(f):
        var = F.sum(pk).over(f(-cfg.vol_window, -1)) / (4.0 * series.LN2 * cfg.vol_window)
        return {"_pk": F.when(F.col("seq") > cfg.vol_window, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)}

    def path(f):
        bar = F.struct("seq", "ts_ns", "open", "high", "low", "close", "_pk")
        return {"_path": F.collect_list(bar).over(f(cfg.delay, cfg.delay + cfg.horizon))}

    framed = blocks.rolling(seq, ["symbol"], [history, path], back=cfg.vol_window, ahead=cfg.delay + cfg.horizon,
                            block_rows=block_rows, where=F.size("_path") > 0)
    framed = framed.select("symbol", "seq", "ts_ns", "_path")
    if events is None:
        chosen = framed.filter((F.col("seq") >= cfg.vol_window + 2) & (F.size("_path") == cfg.horizon + 1)).withColumn("side", F.lit(1))
    else:
        chosen = framed.join(events.select("symbol", "seq", F.col("side").cast("int").alias("side")), ["symbol", "seq"])
        chosen = chosen.withColumn("side", F.when(F.col("side").isin(-1, 0, 1), F.col("side")).otherwise(1))

    entry = F.col("_path")[0]
    short = F.col("side") == -1
    way = (cfg.spread_bps + cfg.fee_bps) * 1e-4
    sigma = F.greatest(F.lit(cfg.vol_floor), F.least(F.lit(cfg.vol_cap), F.col("_e._pk")))
    eff = F.col("_sigma") * (math.sqrt(cfg.horizon) if cfg.sqrt_horizon else 1.0)
    up = F.when(short, cfg.stop).otherwise(cfg.profit) * eff
    down = F.when(short, cfg.profit).otherwise(cfg.stop) * eff
    p = F.col("_e.open")
    if cfg.log_barriers:
        upper, lower = F.exp(F.log(p) + up), F.exp(F.log(p) - down)
    else:
        upper, lower = p * (1.0 + up), p * (1.0 - down)
    if cfg.tick_size is not None:
        upper, lower = (F.bround(x / cfg.tick_size) * cfg.tick_size for x in (upper, lower))
    staged = (
        chosen.withColumn("_e", entry).filter(p > 0)
        .withColumn("_sigma", sigma).withColumns({"_u": upper, "_l": lower})
    )

    u, l = F.col("_u"), F.col("_l")
    # high >= open and low <= open hold for valid bars, so a gap open also touches
    touched = F.filter("_path", lambda b: (b["open"] >= u) | (b["open"] <= l) | (b["high"] >= u) | (b["low"] <= l))
    last = F.element_at("_path", -1)
    hit = staged.withColumn("_hit", F.try_element_at(touched, F.lit(1))).withColumn("_x", F.coalesce("_hit", last))
    o, hi, lo = F.col("_hit.open"), F.col("_hit.high"), F.col("_hit.low")
    both = (hi >= u) & (lo <= l)
    collision = "COLLISION_STOP" if cfg.pessimistic else "UPPER"
    reason = (
        F.when(F.col("_hit").isNull(), "VERTICAL").when(o >= u, "UPPER").when(o <= l, "LOWER")
        .when(both, collision).when(hi >= u, "UPPER").otherwise("LOWER"))
    stop_price = F.when(short, u).otherwise(l) if cfg.pessimistic else u
    price = (
        F.when(F.col("_hit").isNull(), F.col("_x.close")).when((o >= u) | (o <= l), o)
        .when(both, stop_price).when(hi >= u, u).otherwise(l))
    raw = (F.col("exit_price") - p) / p
    side = F.col("side")
    net = F.when(side == 1, raw).when(short, -raw).otherwise(F.abs(raw)) - 2.0 * way
    expiry = F.signum("realized_return").cast("int") if cfg.sign_at_expiry else F.lit(0)
    label = (
        F.when(F.col("touch_reason") == "UPPER", F.when(short, -1).otherwise(1))
        .when(F.col("touch_reason") == "VERTICAL", expiry).otherwise(F.when(short, 1).otherwise(-1)))
    return (
        hit.withColumns({"touch_reason": reason, "exit_price": price})
        .withColumn("realized_return", net)
        .select(
            "symbol", "seq", F.col("ts_ns").alias("event_ns"), F.col("_e.ts_ns").alias("entry_ns"),
            F.col("_x.ts_ns").alias("exit_ns"),
            (p * F.when(side == 1, 1.0 + way).when(short, 1.0 - way).otherwise(1.0)).alias("entry_price"),
            "exit_price", side.cast("long").alias("side"), label.cast("long").alias("label"), "realized_return",
            "touch_reason", (F.col("_x.seq") - F.col("_e.seq")).alias("holding_bars"),
            F.col("_sigma").alias("volatility"), u.alias("upper_barrier"), l.alias("lower_barrier"))
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Hit counts and rates, mean holding and mean net return per symbol."""
    n = F.count(F.lit(1))
    hits = {k: F.count(F.when(F.col("label") == v, 1)) for k, v in (("tp", 1), ("sl", -1), ("vertical", 0))}
    return labels.groupBy("symbol").agg(
        n.alias("events"), *[c.alias(f"{k}_hits") for k, c in hits.items()],
        *[F.round(c / n * 100.0, 1).alias(f"{k}_pct") for k, c in hits.items()],
        F.round(F.avg("holding_bars"), 1).alias("mean_holding"),
        F.round(F.avg("realized_return") * 100.0, 3).alias("mean_return_pct"))


def meta_labels(labels: DataFrame, primary: Column) -> DataFrame:
    """Payoff aligned with the primary side, success flag and payoff odds."""
    sig, side = F.col("primary_side"), F.col("side")
    r = F.col("realized_return")
    payoff = F.when(side == 0, sig * r).when(sig == side, r).otherwise(-r)
    gain = F.when(sig == 1, F.col("upper_barrier") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("lower_barrier"))
    loss = F.when(sig == 1, F.col("entry_price") - F.col("lower_barrier")).otherwise(F.col("upper_barrier") - F.col("entry_price"))
    straddles = (F.col("upper_barrier") > F.col("entry_price")) & (F.col("lower_barrier") < F.col("entry_price"))
    return (
        labels.withColumn("primary_side", primary.cast("long"))
        .withColumn("payoff", payoff)
        .withColumns({
            "meta_label": F.when(F.col("payoff") > 0, 1).otherwise(0).cast("long"),
            "payoff_odds": F.when(straddles, F.greatest(F.lit(0.1), gain / F.greatest(F.lit(1e-6), loss))).otherwise(1.0),
        })
    )


def concurrency(labels: DataFrame, span_ns: int = 7 * blocks.DAY_NS) -> DataFrame:
    """Labels live at each label's entry (entry <= t < exit), at least 1.

    Starts and ends become ±1 per timestamp, a running sum gives the count at every
    entry; n log n work instead of comparing all pairs.
    """
    steps = (
        labels.select("symbol", F.explode(F.array(
            F.struct(F.col("entry_ns").alias("ts_ns"), F.lit(1).alias("d")),
            F.struct(F.col("exit_ns").alias("ts_ns"), F.lit(-1).alias("d")))).alias("s"))
        .groupBy("symbol", F.col("s.ts_ns").alias("ts_ns")).agg(F.sum("s.d").alias("d"))
    )
    live = blocks.running(steps, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns", span_ns), {"live": Running("sum", F.col("d"))})
    at_entry = live.select("symbol", F.col("ts_ns").alias("entry_ns"), F.greatest(F.lit(1), "live").cast("long").alias("concurrency"))
    return labels.join(at_entry, ["symbol", "entry_ns"])


def fit_calibration(scored: DataFrame, l2: float = 1e-3) -> DataFrame:
    """Platt scaling of (score, label): one row with a and b of p = 1 / (1 + exp(a·s + b)).

    Each sample enters twice, as success with weight t and as failure with weight 1 - t,
    where t is its smoothed target. The bounds and the slope penalty are the solver's.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices, Vectors

    n_pos, n = scored.agg(F.sum("label"), F.count(F.lit(1))).first()
    t_pos, t_neg = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n - n_pos + 2.0)
    t = F.when(F.col("label") == 1, t_pos).otherwise(t_neg)
    rows = scored.select("score", F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), t.alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - t).alias("w")))).alias("x"))
    rows = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows.select("score", "x.y", "x.w"))
    model = LogisticRegression(
        labelCol="y", weightCol="w", regParam=l2 / n, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200,
        lowerBoundsOnCoefficients=Matrices.dense(1, 1, [1e-6]), upperBoundsOnCoefficients=Matrices.dense(1, 1, [50.0]),
        lowerBoundsOnIntercepts=Vectors.dense([-50.0]), upperBoundsOnIntercepts=Vectors.dense([50.0]),
    ).fit(rows)
    return scored.sparkSession.range(1).select(
        F.lit(-float(model.coefficients[0])).alias("a"), F.lit(-float(model.intercept)).alias("b"))


def calibrated(score: Column, a: float, b: float) -> Column:
    z = F.least(F.greatest(a * score + b, F.lit(-50.0)), F.lit(50.0))
    return F.least(F.greatest(1.0 / (1.0 + F.exp(z)), F.lit(1e-6)), F.lit(1.0 - 1e-6))


def brier(scored: DataFrame, improvement: float = 0.0) -> DataFrame:
    """Brier score of ``prob`` against ``label`` and of the base rate, and whether it improves.

    The base-rate score needs no second pass: mean (y - m)^2 = m (1 - m) for 0/1 labels.
    """
    m = F.avg("label")
    cal, base = F.avg(F.pow(F.col("label") - F.col("prob"), 2)), m * (1.0 - m)
    return scored.agg(cal.alias("brier"), base.alias("base_brier"), ((base - cal) >= improvement).alias("is_valid"))


def bet_size(prob: Column, odds: Column, duration: Column, live: Column, kelly: float = 0.5, cap: float = 1.0,
             hurdle: float = 0.0, reference_bars: float = 10.0) -> Column:
    """Fractional Kelly size with edge hurdle, square-root duration discount and concurrency divisor."""
    edge = (prob * odds - (1.0 - prob)) / odds
    factor = F.greatest(F.lit(0.1), F.sqrt(F.greatest(F.lit(1.0), duration) / reference_bars))
    size = kelly * edge / factor / F.greatest(live, F.lit(1))
    return F.when(edge <= hurdle, 0.0).otherwise(F.least(F.greatest(size, F.lit(0.0)), F.lit(cap)))
