"""The operators' input shapes, derived by Spark from the star-schema tables.

Every frame here is a lazy projection or aggregation of a whole table, so its size
follows the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
# Factor on fill prices, so that amounts have no exact rounding halves.
MARKUP = 1.000371937


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_ns(col: str | Column) -> Column:
    """Nanoseconds since the epoch of a zone-less timestamp; the session zone is UTC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp")) * F.lit(1000)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event: symbol, ts_ns, price, size 1, event_id as tie-break."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("symbol"), to_ns("ts").alias("ts_ns"),
        F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id", "user_id",
    )


def bars(spark: SparkSession, sf_dir: str, every_ns: int = HOUR_NS) -> DataFrame:
    """OHLCV bars of the ticks; open and close by (ts, event_id)."""
    pos = F.struct("ts_ns", "event_id")
    start = F.col("ts_ns") - F.pmod("ts_ns", F.lit(every_ns))
    resolution = {HOUR_NS: "1h", 24 * HOUR_NS: "1d", HOUR_NS // 60: "1m"}[every_ns]
    return (
        ticks(spark, sf_dir)
        .groupBy("symbol", start.alias("bar_ns"))
        .agg(
            F.min_by("price", pos).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", pos).alias("close"),
            F.sum("size").alias("volume"), F.avg("price").alias("vwap"),
        )
        .filter(F.col("low") > 0)  # non-positive prices fail the bar checks
        .withColumnRenamed("bar_ns", "ts_ns")
        .withColumn("resolution", F.lit(resolution))
        .select("symbol", "resolution", "ts_ns", "open", "high", "low", "close", "volume", "vwap")
    )


def historical_bars(spark: SparkSession, sf_dir: str, every_ns: int = HOUR_NS) -> DataFrame:
    """Bars with adjusted close (sometimes missing or zero), split factor and dividend."""
    n = F.expr(f"ts_ns div {every_ns}")
    return bars(spark, sf_dir, every_ns).withColumns({
        "adj_close": F.when(n % 11 == 0, F.lit(None).cast("double"))
        .when(n % 13 == 0, F.lit(0.0)).otherwise(F.col("close") * 0.5),
        "split_factor": F.when(n % 17 == 0, 0.5).when(n % 19 == 0, F.lit(None).cast("double")).otherwise(1.0),
        "dividend_amount": F.when(n % 23 == 0, F.lit(None).cast("double")).otherwise((n % 5) * 0.25),
    })


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a known share of broken rows, for the checks."""
    n = F.expr(f"ts_ns div {HOUR_NS}")
    return bars(spark, sf_dir).withColumns({
        "high": F.when(n % 7 == 0, F.col("low") * 0.5).otherwise(F.col("high")),
        "open": F.when(n % 29 == 0, -F.col("open")).otherwise(F.col("open")),
        "volume": F.when(n % 31 == 0, -1.0).otherwise(F.col("volume")),
        "vwap": F.when(n % 13 == 0, 0.0).when(n % 37 == 0, F.col("high") * 3).otherwise(F.col("vwap")),
    })


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of the line items: supplier is the portfolio, return flag the symbol."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("portfolio_id"), F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity") * MARKUP).alias("price"),
        to_ns("l_shipdate").alias("ts_ns"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part_id"),
        (F.col("l_extendedprice") * F.col("l_tax") * 0.01 * MARKUP).alias("fee"),
    )
