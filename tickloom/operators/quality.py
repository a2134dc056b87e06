"""Validation and conformance checks that return violation codes instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks


def _codes(*rules: tuple[str, Column]) -> Column:
    """Array of the codes whose rule holds; a null rule result counts as a violation."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(code)) for code, rule in rules]))


def _not_finite(name: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def bar_violations(envelope: bool = True) -> Column:
    """Codes of broken bar invariants; ``envelope`` adds the vwap-within-range rule."""
    o, h, l, c, v, w = (F.col(n) for n in ("open", "high", "low", "close", "volume", "vwap"))
    rules = [
        ("TIMESTAMP", F.col("ts_ns").isNull() | (F.col("ts_ns") <= 0)),
        ("NON_FINITE", _not_finite("open") | _not_finite("high") | _not_finite("low")
         | _not_finite("close") | _not_finite("volume") | _not_finite("vwap")),
        ("NON_POSITIVE_PRICE", F.least(o, h, l, c) <= 0),
        ("HIGH_BELOW_BODY", h < F.greatest(o, c)),
        ("LOW_ABOVE_BODY", l > F.least(o, c)),
        ("NEGATIVE_VOLUME", v < 0),
        ("VWAP_NOT_POSITIVE", (v > 0) & (w <= 0)),
    ]
    if envelope:
        rules.append(("VWAP_OUTSIDE_RANGE", (v > 0) & (w > 0) & ((w < l - 1e-4) | (w > h + 1e-4))))
    return _codes(*rules)


def violation_report(bars: DataFrame) -> DataFrame:
    """Rows per (symbol, violation code)."""
    return (
        bars.select("symbol", F.explode(bar_violations()).alias("violation"))
        .groupBy("symbol", "violation").agg(F.count(F.lit(1)).alias("n"))
    )


def order_violations(batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows whose timestamp does not exceed the one that arrived before it, per symbol."""
    seq = blocks.index_rows(batch, ["symbol"], [arrival], F.floor(F.col(arrival) / 100_000).cast("long"))
    seen = blocks.rolling(seq, ["symbol"], lambda f: {"prev_ns": F.max("ts_ns").over(f(-1, -1))}, back=1)
    return seen.filter(F.col("ts_ns") <= F.col("prev_ns"))


def split_adjust(bars: DataFrame) -> DataFrame:
    """Prices times the split factor, volume over it, dividend times it; factor becomes 1."""
    f = F.col("split_factor")
    same = F.abs(f - 1.0) <= 1e-9 * F.greatest(F.abs(f), F.lit(1.0))
    scaled = {n: F.when(same, F.col(n)).otherwise(F.col(n) * f) for n in ("open", "high", "low", "close", "vwap", "dividend_amount")}
    return bars.withColumns({
        **scaled,
        "volume": F.when(same | (f <= 0), F.col("volume")).otherwise(F.try_divide(F.col("volume"), f)),
        "split_factor": F.when(same, f).otherwise(1.0),
    })


def fill_historical_defaults(bars: DataFrame) -> DataFrame:
    """Adjusted close falls back to close, split factor to 1, dividend to 0."""
    def usable(name: str, rule: Column) -> Column:
        return F.when(F.col(name).isNotNull() & ~F.isnan(name) & rule, F.col(name))

    return bars.withColumns({
        "adj_close": F.coalesce(usable("adj_close", F.col("adj_close") > 0), "close"),
        "split_factor": F.coalesce(usable("split_factor", F.col("split_factor") > 0), F.lit(1.0)),
        "dividend_amount": F.coalesce(usable("dividend_amount", F.col("dividend_amount") >= 0), F.lit(0.0)),
    })


def causality(articles: DataFrame, now_ns: int, clock_s: float = 2.0, skew_s: float = 60.0) -> DataFrame:
    """Flag articles available before publication and publications from the future."""
    ns = 1_000_000_000
    return articles.withColumns({
        "is_causal": F.col("available_ns") >= F.col("published_ns") - F.lit(int(clock_s * ns)),
        "is_future": F.col("published_ns") > F.lit(now_ns + int(skew_s * ns)),
    })


def signal_violations() -> Column:
    """Codes of a broken signal contract."""
    d, w, k = F.col("direction"), F.col("target_weight"), F.col("conviction")
    return _codes(
        ("WEIGHT_NON_FINITE", _not_finite("target_weight")),
        ("WEIGHT_BOUNDS", (w < -1.0) | (w > 1.0)),
        ("CONVICTION_BOUNDS", _not_finite("conviction") | (k < 0.0) | (k > 1.0)),
        ("HORIZON", F.col("horizon_bars") <= 0),
        ("LONG_SIGN", (d == "LONG") & (w <= 0.0)),
        ("SHORT_SIGN", (d == "SHORT") & (w >= 0.0)),
        ("FLAT_SIGN", (d == "FLAT") & (F.abs(w) > 1e-7)),
        ("STOP", F.coalesce(_not_finite("stop_loss_pct") | (F.col("stop_loss_pct") <= 0.0), F.lit(False)) & F.col("stop_loss_pct").isNotNull()),
        ("TAKE_PROFIT", F.coalesce(_not_finite("take_profit_pct") | (F.col("take_profit_pct") <= 0.0), F.lit(False)) & F.col("take_profit_pct").isNotNull()),
    )


def warm(bars: DataFrame, min_bars: int) -> DataFrame:
    """Rows with at least ``min_bars`` bars of their symbol up to and including them."""
    seq = blocks.index_rows(bars, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns"))
    return seq.filter(F.col("seq") >= min_bars)
