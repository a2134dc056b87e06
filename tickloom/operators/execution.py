"""Execution analytics: shortfall, roll-ups, mark-outs, quotes, audits, heartbeats."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks
from tickloom.operators.blocks import Running

# Legal order-state transitions.
TRANSITIONS = {
    "PENDING_NEW": ["NEW", "PARTIALLY_FILLED", "FILLED", "REJECTED", "EXPIRED"],
    "NEW": ["PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED", "EXPIRED"],
    "PARTIALLY_FILLED": ["PARTIALLY_FILLED", "FILLED", "PENDING_CANCEL", "CANCELLED", "EXPIRED"],
    "PENDING_CANCEL": ["CANCELLED", "FILLED", "PARTIALLY_FILLED"],
    "FILLED": [], "CANCELLED": [], "REJECTED": [], "EXPIRED": [],
}


def fill_rollup(parents: DataFrame, fills: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Filled quantity, average price, fees, leaves and violation flags per parent order."""
    f = fills.groupBy("parent_id").agg(
        F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("_n"), F.sum("fee").alias("fees"),
        F.sum("spread_slippage").alias("spread_slippage"), F.min("ts_ns").alias("_first"))
    j = parents.join(f, "parent_id", "left").fillna(0.0, ["filled", "_n", "fees", "spread_slippage"])
    return j.withColumns({
        "average_price": F.when(F.col("filled") > tolerance, F.col("_n") / F.col("filled")).otherwise(0.0),
        "leaves": F.greatest(F.lit(0.0), F.col("total_quantity") - F.col("filled")),
        "over_filled": F.col("filled") > F.col("total_quantity") + tolerance,
        "early_fill": F.coalesce(F.col("_first") < F.col("start_ns"), F.lit(False)),
    }).drop("_n", "_first")


def shortfall(rolled: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Delay, impact, fees and opportunity cost per parent, in money and bps of arrival notional.

    The delay sign is decision minus arrival. Without ``terminal_price`` the average
    execution price, or the arrival price when nothing filled, values the rest.
    """
    q, u = F.col("filled"), F.col("leaves")
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    arrive, decide, avg = F.col("arrival_price"), F.col("decision_price"), F.col("average_price")
    own = F.when(q > tolerance, avg).otherwise(arrive)
    terminal = F.coalesce("terminal_price", own) if "terminal_price" in rolled.columns else own
    zero = F.lit(0.0)
    out = rolled.withColumns({
        "delay_cost": F.when(q > tolerance, side * q * (decide - arrive)).otherwise(zero),
        "price_impact": F.when(q > tolerance, side * q * (avg - decide)).otherwise(zero),
        "opportunity_cost": F.when(u > tolerance, side * u * (terminal - arrive)).otherwise(zero),
    }).withColumn("total_shortfall", F.col("delay_cost") + F.col("price_impact") + F.col("fees") + F.col("opportunity_cost"))
    scale = 10_000.0 / (F.col("total_quantity") * arrive)
    return out.withColumns({f"{c}_bps": F.col(c) * scale for c in ("delay_cost", "price_impact", "opportunity_cost", "fees", "total_shortfall")})


def markouts(fills: DataFrame, quotes: DataFrame, horizon_ns: int) -> DataFrame:
    """Mark-out bps of each fill against the first midpoint at or after fill time + horizon.

    Fills and quotes are merged on one time axis, mirrored so that "first after" becomes
    "last before"; no range join, and a hot symbol spreads over blocks of bounded rows.
    """
    f = fills.select("symbol", (F.col("ts_ns") + horizon_ns).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("_m"),
                     F.struct(*fills.columns).alias("_f"))
    q = quotes.select("symbol", F.col("ts_ns").alias("_t"), F.lit(1).alias("_k"), F.col("midpoint").alias("_m"),
                      F.lit(None).cast(f.schema["_f"].dataType).alias("_f"))
    both = f.unionByName(q).withColumn("_r", -F.col("_t")).withColumn("_z", F.col("_k") * -1)
    # mirrored order; at equal times the quote precedes the fill
    merged = blocks.running(both, ["symbol"], ["_r", "_z"], blocks.Rows(), {"mid": Running("last", F.col("_m"))})
    hit = merged.filter("_k = 0").select("_f.*", F.col("mid").alias("later_mid"))
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    return hit.withColumn("markout_bps", side * (F.col("later_mid") - F.col("price")) / F.col("price") * 10_000.0)


def venue_markouts(marked: DataFrame) -> DataFrame:
    return marked.filter(F.col("markout_bps").isNotNull()).groupBy("venue").agg(
        F.count(F.lit(1)).alias("fills"), F.avg("markout_bps").alias("average_markout_bps"))


def quote_metrics(quotes: DataFrame) -> DataFrame:
    """Midpoint, spread, imbalance and depth over the venue map (venue to bid and ask size)."""
    b, a = F.col("bid_price"), F.col("ask_price")
    total = F.col("bid_quantity") + F.col("ask_quantity")
    depth = lambda k: F.aggregate(F.transform(F.map_values("venue_depths"), lambda d: d[k]), F.lit(0.0), lambda s, x: s + x)
    return quotes.withColumns({
        "midpoint": (a + b) / 2.0, "spread": a - b, "spread_bps": (a - b) / ((a + b) / 2.0) * 10_000.0,
        "imbalance": F.when(total > 0, F.try_divide(F.col("bid_quantity") - F.col("ask_quantity"), total)).otherwise(0.0),
        "bid_depth": depth("bid"), "ask_depth": depth("ask")})


def illegal_transitions(history: DataFrame, order: str = "step", block: int = 100_000) -> DataFrame:
    """Order-state changes that the transition table does not allow."""
    seq = blocks.index_rows(history, ["order_id"], [order], F.floor(F.col(order) / block).cast("long"))
    prev = blocks.rolling(seq, ["order_id"], lambda f: {"prev_state": F.max("state").over(f(-1, -1))}, back=1)
    legal = F.lit(False)
    for state, after in TRANSITIONS.items():
        if after:
            legal = legal | ((F.col("prev_state") == state) & F.col("state").isin(after))
    return prev.filter(F.col("prev_state").isNotNull() & ~legal)


def client_order_id(namespace: str, strategy: Column, symbol: Column, side: Column, ts_ns: Column, nonce: Column) -> Column:
    """Version-5 UUID of the order fields in the given namespace, prefixed ``cl-``."""
    name = F.concat_ws(":", strategy, symbol, side, ts_ns.cast("string"), nonce.cast("string"))
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.substring(F.sha1(raw), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.lit("cl-"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
                    F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def duplicate_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy("cl_ord_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def heartbeat_report(beats: DataFrame, interval_s: float = 5.0, timeout_s: float = 15.0, max_misses: int = 3, warn_ms: float = 100.0) -> DataFrame:
    """Per heartbeat: gap against the expected sequence, misses since the last, status, outage.

    The expected number is one above the highest sequence seen so far.
    """
    run = blocks.running(beats, ["gateway"], ["ts_ns", "sequence"], blocks.Rows(), {
        "_top": Running("max", F.col("sequence"), inclusive=False), "_prev": Running("last", F.col("ts_ns"), inclusive=False)})
    gap_s = (F.col("ts_ns") - F.col("_prev")) / 1e9
    misses = F.coalesce(F.floor(gap_s / interval_s), F.lit(0)).cast("long")
    return run.withColumns({
        "expected": F.coalesce("_top", F.lit(0)) + 1, "misses": misses,
        "degraded_latency": F.col("latency_ms") >= warn_ms,
        "disconnected_before": F.coalesce((gap_s >= timeout_s) | (misses >= max_misses), F.lit(False)), "gap_seconds": F.coalesce(gap_s, F.lit(0.0)),
    }).withColumn("sequence_gap", F.col("sequence") != F.col("expected")).drop("_top", "_prev")
