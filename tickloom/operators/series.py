"""Per-symbol time-series transforms: returns, volatility, filters, bands, curves.

All of them are causal. Bounded frames go through ``blocks.rolling``, unbounded ones
through ``blocks.running``, so no task holds a whole symbol.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks
from tickloom.operators.blocks import Running

LN2 = math.log(2.0)
KEY = ["symbol"]


def sequenced(bars: DataFrame, span_ns: int = 7 * blocks.DAY_NS, keys: Sequence[str] = KEY) -> DataFrame:
    """Bars with their position ``seq`` inside the symbol."""
    return blocks.index_rows(bars, keys, ["ts_ns"], blocks.time_block("ts_ns", span_ns))


# The prices a return may be taken of, and its kinds.
PRICE_FIELDS = ("adj_close", "close", "open", "high", "low", "vwap")
RETURN_KINDS = ("simple", "log")


def in_range(bars: DataFrame, resolution: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Bars of one resolution in a closed range of time; what is None does not restrict."""
    if start_ns is not None and end_ns is not None and start_ns > end_ns:
        raise ValueError("start_ns exceeds end_ns")
    wanted = [F.col(c) == v if how == "=" else F.col(c) >= v if how == ">" else F.col(c) <= v
              for c, how, v in (("resolution", "=", resolution), ("ts_ns", ">", start_ns), ("ts_ns", "<", end_ns)) if v is not None]
    for condition in wanted:
        bars = bars.filter(condition)
    return bars


def aligned_prices(
    bars: DataFrame, universe: Sequence[str], field: str = "adj_close",
    resolution: str | None = None, start_ns: int | None = None, end_ns: int | None = None,
) -> DataFrame:
    """The grid of all timestamps times the universe with the usable price, else null.

    Non-positive and non-finite prices count as missing, their timestamp stays in the
    grid. The grid comes from exploding the universe list, not from a join. A symbol
    listed twice counts once; timestamps are those of the universe within the range.
    """
    universe = list(dict.fromkeys(universe))
    if not universe or not all(isinstance(s, str) and s for s in universe):
        raise ValueError("the universe must be names, at least one")
    if field not in PRICE_FIELDS:
        raise ValueError(f"field must be one of {PRICE_FIELDS}")
    bars = in_range(bars, resolution, start_ns, end_ns)
    price = F.coalesce(F.nullif(F.col(field), F.lit(0.0)), F.col("close"))
    inside = bars.filter(F.col("symbol").isin(list(universe)))
    # of several bars with one key, say of two resolutions, the largest price stands, whatever their order
    each = inside.groupBy("ts_ns", "symbol").agg(F.max(price).alias("p"))
    held = each.groupBy("ts_ns").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "p"))).alias("m"))
    return held.select(
        "ts_ns", F.explode(F.array(*[F.lit(s) for s in universe])).alias("symbol"), "m",
    ).select(
        "symbol", "ts_ns",
        F.try_element_at("m", F.col("symbol")).alias("p"),
    ).select("symbol", "ts_ns", F.when((F.col("p") > 0) & ~F.isnan("p") & (F.col("p") < float("inf")), F.col("p")).alias("price"))


def aligned_returns(
    bars: DataFrame, universe: Sequence[str], field: str = "adj_close", kind: str = "simple",
    span_ns: int = 7 * blocks.DAY_NS, resolution: str | None = None, start_ns: int | None = None, end_ns: int | None = None,
) -> DataFrame:
    """Long (symbol, ts_ns, ret): causal forward fill, never back-fill, 0.0 when a side is missing.

    The filled price at a row and at the row before are the last non-null price up to and
    strictly before it, so one pass gives both. The first timestamp is dropped, also that of a range:
    prices before the range are not looked at.
    """
    if kind not in RETURN_KINDS:
        raise ValueError(f"kind must be one of {RETURN_KINDS}")
    grid = aligned_prices(bars, universe, field, resolution, start_ns, end_ns)
    filled = blocks.running(grid, KEY, ["ts_ns"], blocks.time_block("ts_ns", span_ns), {
        "now": Running("last", F.col("price")),
        "before": Running("last", F.col("price"), inclusive=False),
        "first_ns": Running("first", F.col("ts_ns")),
    })
    ratio = F.col("now") / F.col("before")
    step = F.log(ratio) if kind == "log" else (F.col("now") - F.col("before")) / F.col("before")
    return filled.filter(F.col("ts_ns") > F.col("first_ns")).select(
        "symbol", "ts_ns", F.coalesce(step, F.lit(0.0)).alias("ret"))


def aligned_matrix(returns: DataFrame, universe: Sequence[str]) -> DataFrame:
    """Wide form, one column per symbol of the known universe."""
    return returns.groupBy("ts_ns").pivot("symbol", list(universe)).agg(F.first("ret"))


def simple_returns(bars: DataFrame, price: str = "close") -> DataFrame:
    """Return on the previous bar of the symbol; the first bar has none."""
    return blocks.rolling(
        sequenced(bars), KEY, lambda f: {"ret": F.col(price) / F.max(price).over(f(-1, -1)) - 1.0}, back=1,
        where=F.col("seq") > 1)


def realised_vol(bars: DataFrame, window: int = 20) -> DataFrame:
    """Sample deviation of the last ``window`` log returns, current bar included; 0 before."""
    def build(f):
        prev = F.max("close").over(f(-1, -1))
        return {"log_ret": F.log(F.col("close") / prev)}

    def spread(f):
        return {"realised_vol": F.when(F.col("seq") > window, F.stddev_samp("log_ret").over(f(1 - window, 0))).otherwise(0.0)}

    return blocks.rolling(sequenced(bars), KEY, [build, spread], back=window + 1)


def parkinson_lagged(seq_bars: DataFrame, window: int = 20) -> DataFrame:
    """Range volatility of the ``window`` bars before each bar, else 0."""
    sq = F.pow(F.log(F.col("high") / F.col("low")), 2)

    def build(f):
        var = F.sum(sq).over(f(-window, -1)) / (4.0 * LN2 * window)
        return {"parkinson": F.when(F.col("seq") > window, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)}

    return blocks.rolling(seq_bars, KEY, build, back=window)


def garman_klass_lagged(bars: DataFrame, window: int = 20) -> DataFrame:
    """Both range estimators over the bars before each bar, annualised in percent."""
    tiny = F.lit(1e-6)
    hl = F.pow(F.log(F.col("high") / F.greatest(tiny, "low")), 2)
    co = F.pow(F.log(F.col("close") / F.greatest(tiny, "open")), 2)
    var = 0.5 * hl - (2.0 * LN2 - 1.0) * co
    scale = math.sqrt(252.0 * 390.0) * 100.0

    def build(f):
        w = f(-window, -1)
        ready = F.col("seq") > window
        pk = F.sqrt(F.greatest(F.sum(F.pow(F.log(F.col("high") / F.col("low")), 2)).over(w) / (4.0 * LN2 * window), F.lit(0.0)))
        gk = F.sqrt(F.greatest(F.avg(var).over(w), F.lit(0.0)))
        return {"parkinson_vol": F.when(ready, pk * scale).otherwise(0.0),
                "garman_klass_vol": F.when(ready, gk * scale).otherwise(0.0)}

    return blocks.rolling(sequenced(bars), KEY, build, back=window)


def _clamped_terms() -> tuple[Column, Column]:
    tiny = F.lit(1e-4)
    h, l, o, c = (F.greatest(n, tiny) for n in ("high", "low", "open", "close"))
    hl = F.pow(F.log(F.greatest(h / l, F.lit(1.0))), 2)
    gk = 0.5 * hl - (2.0 * LN2 - 1.0) * F.pow(F.log(c / o), 2)
    return hl, gk


def range_vol_summary(bars: DataFrame) -> DataFrame:
    """Whole-window Parkinson and Garman–Klass volatility per symbol, annualised by √252."""
    hl, gk = _clamped_terms()
    few = F.count(F.lit(1)) < 2
    year = math.sqrt(252.0)
    return bars.groupBy("symbol").agg(
        F.when(few, 0.0).otherwise(F.sqrt(F.avg(hl) / (4.0 * LN2)) * year).alias("parkinson"),
        F.when(few, 0.0).otherwise(F.sqrt(F.greatest(F.avg(gk), F.lit(0.0))) * year).alias("garman_klass"))


def bar_inputs(bars: DataFrame) -> DataFrame:
    """Per bar after the first: log return, one-bar range volatility with floor, dollar volume."""
    tiny = F.lit(1e-8)
    pk = F.sqrt(F.pow(F.log(F.greatest(F.col("high") / F.greatest("low", tiny), F.lit(1.0))), 2) / (4.0 * LN2))
    return blocks.rolling(sequenced(bars), KEY, lambda f: {
        "log_ret": F.log(F.greatest("close", tiny) / F.greatest(F.max("close").over(f(-1, -1)), tiny)),
        "volatility": F.greatest(pk, F.lit(0.005)),
        "adv": F.greatest(F.col("close") * F.col("volume"), F.lit(1_000_000.0)),
    }, back=1, where=F.col("seq") > 1)


def fractional_weights(d: float, threshold: float = 1e-4, max_lookback: int | None = None, zero_sum: bool = True) -> list[float]:
    """Binomial weights of (1 - B)^d, cut at the threshold or look-back."""
    if not 0.0 <= d <= 1.0:
        raise ValueError("d must be in [0, 1]")
    if d in (0.0, 1.0):
        return [1.0] if d == 0.0 else [1.0, -1.0]
    limit = math.inf if max_lookback is None else max_lookback
    out = [1.0]
    for k in range(1, 10_000_000):
        nxt = out[-1] * (k - 1.0 - d) / k
        if abs(nxt) < threshold or k > limit:
            break
        out.append(nxt)
    if zero_sum and len(out) > 1:
        out[0] = -math.fsum(out[1:])
    return out


def _dot(recent_first: Column, weights: list[float]) -> Column:
    literal = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(recent_first, literal, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def frac_diff(bars: DataFrame, weights: list[float], price: str = "close", pad: bool = False) -> DataFrame:
    """Fixed-window fractional difference; rows without a full window are dropped or null."""
    back = len(weights) - 1

    def build(f):
        value = _dot(F.reverse(F.collect_list(price).over(f(-back, 0))), weights)
        return {"ffd": F.when(F.col("seq") > back, value)}

    return blocks.rolling(sequenced(bars), KEY, build, back=back, where=None if pad else F.col("seq") > back)


def frac_diff_expanding(bars: DataFrame, weights: list[float], price: str = "close") -> DataFrame:
    """Fractional difference of the log price above its first value, partial windows kept."""
    back = len(weights) - 1
    log_price = F.log(F.greatest(price, F.lit(1e-4)))
    first = bars.groupBy("symbol").agg(F.min_by(log_price, "ts_ns").alias("_base"))
    based = sequenced(bars).join(first, "symbol").withColumn("_x", log_price - F.col("_base")).drop("_base")
    literal = F.array(*[F.lit(float(w)) for w in weights])

    def build(f):
        got = F.reverse(F.collect_list("_x").over(f(-back, 0)))
        prod = F.zip_with(got, F.slice(literal, F.lit(1), F.size(got)), lambda a, b: a * b)
        return {"ffd": F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)}

    return blocks.rolling(based, KEY, build, back=back).drop("_x")


def ema_many(seq_rows: DataFrame, value: str, alphas: dict[str, float], keys: Sequence[str] = KEY, seed_first: bool = True) -> DataFrame:
    """Exponential averages y_t = a·x_t + (1-a)·y_{t-1}, seeded with the first value or 0.

    Weights below e^-41.5 are beyond double precision, so each average is a bounded frame.
    Inside a block it is a cumulative sum of x·(1-a)^-k scaled back, which stays in
    generated code; the block length keeps the scale inside the double range.
    """
    slowest = min(-math.log1p(-a) for a in alphas.values() if a < 1.0) if any(a < 1.0 for a in alphas.values()) else 1.0
    fastest = max([-math.log1p(-a) for a in alphas.values() if a < 1.0], default=1.0)
    back = max(1, math.ceil(41.5 / slowest))
    room = int(640.0 / fastest)
    if room <= 2 * back and len(alphas) > 1:
        # One span is much faster than another: separate passes keep each inside the range.
        for name, a in alphas.items():
            seq_rows = ema_many(seq_rows, value, {name: a}, keys, seed_first)
        return seq_rows
    size = max(room - back, back)

    def build(f):
        cols = {}
        for name, a in alphas.items():
            x = F.col(value) * F.lit(a)
            if seed_first:
                x = F.when(F.col("seq") == 1, F.col(value)).otherwise(x)
            if a >= 1.0:
                cols[name] = F.col(value)
                continue
            g = -math.log1p(-a)
            # halo rows sit before the block: their scale exponent is (pos - size) < 0
            k = F.when(F.col("_at") > F.col("_home"), (F.col("seq") - 1) % F.lit(size) - F.lit(size)).otherwise((F.col("seq") - 1) % F.lit(size))
            cols[name] = F.sum(x * F.exp(k * F.lit(g))).over(f(_UNBOUNDED, 0)) * F.exp(-k * F.lit(g))
        return cols

    return blocks.rolling(seq_rows, keys, build, back=back, block_rows=size)


_UNBOUNDED = -(1 << 63)


def ema(bars: DataFrame, value: str, spans: dict[str, int]) -> DataFrame:
    """Averages with alpha 2/(span+1), one column per name."""
    return ema_many(sequenced(bars), value, {n: 2.0 / (s + 1.0) for n, s in spans.items()})


def bollinger(seq_bars: DataFrame, period: int = 20, width: float = 2.0, lookback: int = 100, pct: float = 0.15,
              fast: int = 5, volume_mult: float = 1.15) -> DataFrame:
    """Bands, bandwidth, squeeze flag, volatility expansion, volume confirmation, mean range.

    Population deviation, current bar included; the squeeze threshold is the linear
    percentile of the last ``lookback`` bandwidths. Rows without a full history are dropped.
    """
    _, gk = _clamped_terms()
    year = math.sqrt(252.0)

    def first(f):
        w = f(1 - period, 0)
        sma, sd = F.avg("close").over(w), F.stddev_pop("close").over(w)
        gk_fast = F.sqrt(F.greatest(F.avg(gk).over(f(1 - fast, 0)), F.lit(0.0))) * year
        gk_base = F.sqrt(F.greatest(F.avg(gk).over(w), F.lit(0.0))) * year
        return {
            "sma": sma, "upper_band": sma + width * sd, "lower_band": sma - width * sd,
            "bandwidth": F.when(F.col("seq") >= period, 2.0 * width * sd / F.greatest(sma, F.lit(1e-4))),
            "gk_fast": gk_fast, "vol_expansion": gk_fast / F.greatest(gk_base, F.lit(1e-4)),
            "volume_confirmed": F.col("volume") >= F.avg("volume").over(w) * volume_mult,
            "mean_range": F.avg(F.col("high") - F.col("low")).over(w),
            "prev_close": F.max("close").over(f(-1, -1)),
        }

    def second(f):
        return {"squeeze_threshold": F.percentile("bandwidth", F.lit(pct)).over(f(1 - lookback, 0))}

    need = period + lookback - 1
    out = blocks.rolling(seq_bars, KEY, [first, second], back=period + lookback, where=F.col("seq") >= need)
    return out.withColumn("is_squeeze", F.col("bandwidth") <= F.col("squeeze_threshold"))


def annualised_vol(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """Population deviation of the last simple returns by √252, floor 5%, 20% below five returns."""
    def rets(f):
        prev = F.max("close").over(f(-1, -1))
        return {"_r": F.col("close") / prev - 1.0}

    def spread(f):
        sd = F.stddev_pop("_r").over(f(1 - lookback, 0)) * math.sqrt(252.0)
        return {"ann_vol": F.when(F.least(F.col("seq") - 1, F.lit(lookback)) < 5, 0.20).otherwise(F.greatest(sd, F.lit(0.05)))}

    return blocks.rolling(sequenced(bars), KEY, [rets, spread], back=lookback + 1).drop("_r")


def expanding_z(returns: DataFrame, span_ns: int = 7 * blocks.DAY_NS) -> DataFrame:
    """Causal z-score: running mean and sample deviation, with the cited fallbacks."""
    r = F.col("ret")
    acc = blocks.running(returns, KEY, ["ts_ns"], blocks.time_block("ts_ns", span_ns), {
        "_s": Running("sum", r), "_ss": Running("sum", r * r), "_n": Running("count", r)})
    n = F.col("_n")
    var = F.greatest(F.try_divide(F.col("_ss") - F.col("_s") * F.col("_s") / n, n - 1), F.lit(0.0))
    mean = F.when(n >= 2, F.col("_s") / n).otherwise(0.0)
    std = F.when(n >= 2, F.when(var > 1e-12, F.sqrt(var)).otherwise(0.01)).otherwise(F.greatest(F.abs(r), F.lit(0.01)))
    return acc.withColumn("std", std).withColumn("z", (r - mean) / F.col("std")).drop("_s", "_ss", "_n")


def cusum(z_scores: DataFrame, drift: float = 0.5, threshold: float = 3.0, span_ns: int = 7 * blocks.DAY_NS) -> DataFrame:
    """Two-sided CUSUM without reset in closed form: S = C - min(0, running min C).

    C is the running sum of (±z - drift); one block scan gives it and its minimum.
    """
    acc = blocks.running(z_scores, KEY, ["ts_ns"], blocks.time_block("ts_ns", span_ns), {
        "_p": Running("sum_min", F.col("z") - drift), "_n": Running("sum_min", -F.col("z") - drift)})
    zero = F.lit(0.0)
    return acc.withColumns({
        "s_pos": F.col("_p") - F.least(zero, "_p_ext"), "s_neg": F.col("_n") - F.least(zero, "_n_ext"),
    }).withColumn("is_shock", (F.col("s_pos") >= threshold) | (F.col("s_neg") >= threshold)).drop("_p", "_n", "_p_ext", "_n_ext")


def rolling_z(rows: DataFrame, value: str, lookback: int = 60, keys: Sequence[str] = KEY) -> DataFrame:
    """z of the value over its last ``lookback`` rows: population deviation, floor 1e-6."""
    def build(f):
        w = f(1 - lookback, 0)
        return {"z": (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-6))}

    return blocks.rolling(sequenced(rows, keys=keys), keys, build, back=lookback)


def half_life(rows: DataFrame, value: str) -> DataFrame:
    """Mean-reversion half-life from the slope of the change on the level before.

    The covariance divides by n - 1 and the variance by n. NaN below ten values or without
    variance, infinite when the slope does not revert.
    """
    pairs = blocks.rolling(
        sequenced(rows), KEY, lambda f: {"_e": F.max(value).over(f(-1, -1))}, back=1, where=F.col("seq") > 1)
    slope = F.col("cov") / F.col("var")
    agg = pairs.groupBy("symbol").agg(
        F.covar_samp(F.col(value) - F.col("_e"), F.col("_e")).alias("cov"),
        F.var_pop("_e").alias("var"), F.count(F.lit(1)).alias("n"))
    return agg.select("symbol", F.when((F.col("n") + 1 < 10) | (F.col("var") < 1e-12), F.lit(float("nan")))
                      .when(slope >= -1e-6, F.lit(float("inf")))
                      .otherwise(F.greatest(F.lit(0.1), -LN2 / slope)).alias("half_life"))


def equity_curve(returns: DataFrame, key: str = "symbol", span_ns: int = 30 * blocks.DAY_NS) -> DataFrame:
    """Equity, running peak, drawdown and bars below the peak, per key in time order."""
    blk = blocks.time_block("ts_ns", span_ns)
    eq = blocks.running(returns, [key], ["ts_ns"], blk, {
        "equity": Running("product_max", F.col("ret") + 1.0), "bar": Running("count", F.col("ret"))})
    dd = eq.withColumnRenamed("equity_ext", "peak").withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.greatest("peak", F.lit(1e-8)))
    at_peak = F.when(F.col("drawdown") >= -1e-6, F.col("bar"))
    run = blocks.running(dd, [key], ["ts_ns"], blk, {"_last": Running("last", at_peak)})
    return run.withColumn("below_bars", F.col("bar") - F.coalesce("_last", F.lit(0))).drop("_last")


def dual_ema_signal(inputs: DataFrame, slow_bars: int, fast_bars: int, blend: float, hurdle: float) -> DataFrame:
    """Blended fast and slow averages of lagged returns, zeroed below the volatility hurdle.

    The first row has no signal input and yields 0. ``inputs`` has symbol, ts_ns, ret and
    volatility.
    """
    lagged = blocks.rolling(sequenced(inputs), KEY, lambda f: {
        "_r": F.coalesce(F.max("ret").over(f(-1, -1)), F.lit(0.0)),
        "_v": F.greatest(F.max("volatility").over(f(-1, -1)), F.lit(1e-4)),
    }, back=1)
    both = ema_many(lagged, "_r", {"_slow": 2.0 / (slow_bars + 1.0), "_fast": 2.0 / (fast_bars + 1.0)}, seed_first=False)
    mix = blend * F.col("_fast") + (1.0 - blend) * F.col("_slow")
    live = (F.col("seq") > 1) & (F.abs(mix) >= hurdle * F.col("_v"))
    return both.withColumn("signal", F.when(live, mix).otherwise(0.0)).drop("_r", "_v", "_slow", "_fast")
