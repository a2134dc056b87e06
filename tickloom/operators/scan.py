"""Range, latest, summary and lookup queries over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import blocks


class EmptyResult(ValueError):
    """A historical range that must not be empty has no bars."""


def bars_range(bars: DataFrame, symbol: str, start_ns: int, end_ns: int, resolution: str) -> DataFrame:
    """Closed range of one symbol, oldest first."""
    if start_ns > end_ns:
        raise ValueError("start_ns exceeds end_ns")
    return bars.filter(
        (F.col("symbol") == symbol) & (F.col("resolution") == resolution)
        & F.col("ts_ns").between(start_ns, end_ns)
    ).orderBy("ts_ns")


def require_rows(df: DataFrame) -> DataFrame:
    """The historical scan's contract: an empty range is an error (runs one bounded job)."""
    if df.isEmpty():
        raise EmptyResult("no bars in the requested range")
    return df


def latest_bars(bars: DataFrame, count: int) -> DataFrame:
    """Latest ``count`` bars per symbol, oldest first.

    Each time block first keeps its own latest ``count`` rows, so the window per symbol
    sees at most ``count`` rows per block.
    """
    if count <= 0:
        raise ValueError("count must be positive")
    local = Window.partitionBy("symbol", "resolution", "_blk").orderBy(F.desc("ts_ns"))
    whole = Window.partitionBy("symbol", "resolution").orderBy(F.desc("ts_ns"))
    return (
        bars.withColumn("_blk", blocks.time_block("ts_ns"))
        .withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= count)
        .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= count)
        .drop("_r", "_blk").orderBy("symbol", "ts_ns")
    )


def available_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "resolution").agg(
        F.min("ts_ns").alias("min_ns"), F.max("ts_ns").alias("max_ns"))


def symbols(bars: DataFrame, resolution: str | None = None) -> DataFrame:
    if resolution is not None:
        bars = bars.filter(F.col("resolution") == resolution)
    return bars.select("symbol").distinct().orderBy("symbol")


def bar_count(bars: DataFrame, symbol: str | None = None, resolution: str | None = None) -> DataFrame:
    for name, value in (("symbol", symbol), ("resolution", resolution)):
        if value is not None:
            bars = bars.filter(F.col(name) == value)
    return bars.agg(F.count(F.lit(1)).alias("n"))


def effective_price(field: str) -> Column:
    """The field, or close where it is zero or null."""
    return F.coalesce(F.nullif(F.col(field), F.lit(0.0)), F.col("close"))


def universe_prices(bars: DataFrame, universe: list[str], field: str) -> DataFrame:
    return bars.filter(F.col("symbol").isin(universe)).select("symbol", "ts_ns", effective_price(field).alias("price"))


def candlesticks(bars: DataFrame) -> DataFrame:
    """One candle per symbol and second: the first bar of each second."""
    second = F.expr("ts_ns div 1000000000")
    return (
        bars.groupBy("symbol", second.alias("time_s"))
        .agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "ts_ns").alias("b"))
        .select("symbol", "time_s", "b.*")
    )


def bar_summary(bars: DataFrame) -> DataFrame:
    """Count, first and last timestamp, latest close, latest realised volatility.

    The volatility window of a symbol with n bars is min(20, max(2, n - 1)); it needs the
    last 21 closes only, which is what each symbol keeps.
    """
    stats = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"),
        F.max_by("close", "ts_ns").alias("latest_close"))
    tail = latest_bars(bars, 21)
    step = Window.partitionBy("symbol").orderBy("ts_ns")
    logs = tail.withColumn("r", F.log(F.col("close") / F.lag("close").over(step)))
    vol = logs.join(stats.select("symbol", "n"), "symbol").withColumn(
        "back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts_ns")))
    ).withColumn("win", F.least(F.lit(20), F.greatest(F.lit(2), F.col("n") - 1)))
    latest = vol.groupBy("symbol").agg(
        F.stddev_samp(F.when(F.col("back") <= F.col("win"), F.col("r"))).alias("s"),
        F.first("win").alias("win"), F.first("n").alias("n"))
    out = latest.select("symbol", F.when(F.col("n") < 2, F.lit(None)).when(F.col("n") - 1 >= F.col("win"), F.col("s"))
                        .otherwise(0.0).alias("realized_volatility"))
    return stats.join(out, "symbol")


def events_for_asset(events: DataFrame, edges: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Events of each asset in a closed time range with their centrality, newest first."""
    inside = events.filter(F.col("ts_ns").between(start_ns, end_ns))
    return inside.join(edges, "event_id").orderBy(F.desc("ts_ns"), "event_id", "asset_id")


def lookup(df: DataFrame, column: str, value: object, upper: bool = False) -> DataFrame:
    """Point lookup; tickers compare in upper case."""
    return df.filter(F.col(column) == (value.upper() if upper else value))


def active(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("is_active"))


def top_by_fitness(population: DataFrame, cohort: str, limit: int) -> DataFrame:
    return (
        population.filter(F.col("cohort") == cohort)
        .orderBy(F.desc_nulls_last("fitness"), "id").limit(limit)
    )


def query_reports(reports: DataFrame, cl_ord_id: str | None = None, symbol: str | None = None, limit: int = 100) -> DataFrame:
    if limit <= 0:
        raise ValueError("limit must be positive")
    if cl_ord_id is not None:
        reports = reports.filter(F.col("cl_ord_id") == cl_ord_id)
    if symbol is not None:
        reports = reports.filter(F.col("symbol") == symbol)
    return reports.orderBy("ts_ns", "report_id").limit(limit)


def list_orders(orders: DataFrame, symbol: str | None = None, closed: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; the page size is clamped to 1..500 and the offset to 0 or more."""
    if symbol is not None:
        orders = orders.filter(F.col("symbol") == symbol)
    if closed is not None:
        orders = orders.filter(F.col("is_closed") == closed)
    return (
        orders.orderBy(F.desc("created_ns"), F.desc("order_id"))
        .offset(max(0, offset)).limit(max(1, min(500, limit)))
    )


def apply_scores(population: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Overlay evaluation results on the population; missing scores keep the old value."""
    new = scores.select("id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    return (
        population.join(new, "id", "left")
        .withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
        .drop(*[f"_new_{c}" for c in columns])
    )
