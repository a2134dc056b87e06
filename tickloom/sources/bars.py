"""Bar ingest: coercion, upsert, provider payloads, source precedence, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.quality import bar_violations
from tickloom.session import cut_lineage

BAR_FIELDS = ["open", "high", "low", "close", "volume", "vwap"]

CHART_SCHEMA = """chart struct<
  error: struct<code: string, description: string>,
  result: array<struct<
    timestamp: array<bigint>,
    indicators: struct<
      quote: array<struct<open: array<double>, high: array<double>, low: array<double>,
                          close: array<double>, volume: array<double>>>,
      adjclose: array<struct<adjclose: array<double>>>>,
    events: struct<
      splits: map<string, struct<date: bigint, numerator: double, denominator: double>>,
      dividends: map<string, struct<date: bigint, amount: double>>>>>>"""
AGGREGATE_MS_SCHEMA = "array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, vw: double>>"
AGGREGATE_ISO_SCHEMA = "array<struct<t: string, o: double, h: double, l: double, c: double, v: double, vw: double>>"


def finite(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def coerce_bars(rows: DataFrame) -> DataFrame:
    """Text or numeric columns to the bar types; what does not convert becomes null."""
    cast = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in BAR_FIELDS}
    return rows.withColumns({"ts_ns": F.expr("try_cast(ts_ns AS BIGINT)"), **cast})


def ingest_bars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good bars, quarantine with violation codes)."""
    judged = coerce_bars(rows).withColumn("violations", bar_violations(envelope=False))
    good = judged.filter(F.size("violations") == 0).drop("violations")
    return good, judged.filter(F.size("violations") > 0)


def ingest_counts(rows: DataFrame) -> DataFrame:
    """Per resolution: rows seen, rows valid, rows quarantined, distinct keys persisted.

    The key count is a two-step group-by, so no key list is collected.
    """
    judged = coerce_bars(rows).withColumn("ok", F.size(bar_violations(envelope=False)) == 0)
    per_key = judged.groupBy("resolution", "symbol", "ts_ns").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"))
    return per_key.groupBy("resolution").agg(
        F.sum("n").alias("received"), F.sum("n_ok").alias("valid"),
        (F.sum("n") - F.sum("n_ok")).alias("quarantined"),
        F.count(F.when(F.col("n_ok") > 0, 1)).alias("persisted"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str = "batch_seq") -> DataFrame:
    """Last write per key wins: highest ``version`` over both inputs.

    ``max_by`` combines map-side, so copies of one key never meet in full.
    """
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _last_per_timestamp(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != pos]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def _empty(col: Column, kind: str) -> Column:
    return F.coalesce(col, F.array().cast(kind))


def parse_chart(payloads: DataFrame) -> DataFrame:
    """Chart JSON (symbol, resolution, payload_id, body) to historical bars.

    Parallel arrays are zipped by position; null or non-positive prices drop the bar,
    missing or negative volume becomes 0, high and low widen to hold open and close,
    vwap is the typical price, the last entry of a repeated timestamp wins.
    """
    r = F.from_json("body", CHART_SCHEMA)["chart"]["result"][0]
    q = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))
    ac = F.try_element_at(F.col("r.indicators.adjclose"), F.lit(1))
    zipped = F.arrays_zip(
        _empty(F.col("r.timestamp"), "array<bigint>").alias("t"),
        _empty(q["open"], "array<double>").alias("o"), _empty(q["high"], "array<double>").alias("h"),
        _empty(q["low"], "array<double>").alias("l"), _empty(q["close"], "array<double>").alias("c"),
        _empty(q["volume"], "array<double>").alias("v"), _empty(ac["adjclose"], "array<double>").alias("a"))
    names = ["t", "o", "h", "l", "c", "v", "a"]
    entries = (
        payloads.select("symbol", "resolution", "payload_id", r.alias("r"))
        .select("symbol", "resolution", "payload_id", F.posexplode(zipped).alias("pos", "e"))
        .select("symbol", "resolution", "payload_id", "pos",
                *[F.col(f"e.{n}").alias(n) for n in names])
    )
    usable = entries.filter(
        (F.col("t") > 0) & finite("o") & finite("h") & finite("l") & finite("c")
        & (F.least("o", "h", "l", "c") > 0))
    bars = usable.select(
        "symbol", "resolution", "payload_id", "pos", (F.col("t") * 1_000_000_000).alias("ts_ns"),
        F.col("o").alias("open"), F.greatest("h", "o", "c").alias("high"),
        F.least("l", "o", "c").alias("low"), F.col("c").alias("close"),
        F.when(finite("v") & (F.col("v") >= 0), F.col("v")).otherwise(0.0).alias("volume"),
        F.when(~F.isnan("a"), F.col("a")).alias("adj_close"),
    ).withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    legal = bars.filter(F.col("adj_close").isNull() | (F.col("adj_close") > 0))
    return _last_per_timestamp(legal, ["symbol", "resolution", "payload_id", "ts_ns"], "pos").withColumns(
        {"split_factor": F.lit(1.0), "dividend_amount": F.lit(0.0)})


def parse_corporate_actions(payloads: DataFrame) -> DataFrame:
    """Splits and dividends of the same chart JSON."""
    r = F.from_json("body", CHART_SCHEMA)["chart"]["result"][0]
    events = payloads.select("symbol", r["events"].alias("ev"))
    splits = (
        events.select("symbol", F.explode("ev.splits").alias("k", "s"))
        .select("symbol", F.coalesce("s.date", F.lit(0)).alias("d"),
                F.coalesce("s.numerator", F.lit(1.0)).alias("num"), F.coalesce("s.denominator", F.lit(1.0)).alias("den"))
        .filter("d > 0 AND num > 0 AND den > 0")
        .select("symbol", (F.col("d") * 1_000_000_000).alias("ts_ns"), F.lit("SPLIT").alias("action_type"),
                (F.col("num") / F.col("den")).alias("split_ratio"), F.lit(0.0).alias("cash_dividend"))
    )
    dividends = (
        events.select("symbol", F.explode("ev.dividends").alias("k", "s"))
        .select("symbol", F.coalesce("s.date", F.lit(0)).alias("d"), F.coalesce("s.amount", F.lit(0.0)).alias("amount"))
        .filter("d > 0 AND amount >= 0")
        .select("symbol", (F.col("d") * 1_000_000_000).alias("ts_ns"), F.lit("CASH_DIVIDEND").alias("action_type"),
                F.lit(1.0).alias("split_ratio"), F.col("amount").alias("cash_dividend"))
    )
    return splits.unionByName(dividends)


def parse_aggregates(payloads: DataFrame, iso_time: bool) -> DataFrame:
    """Aggregate-bar JSON arrays; ``t`` is epoch milliseconds or an RFC 3339 string."""
    schema = AGGREGATE_ISO_SCHEMA if iso_time else AGGREGATE_MS_SCHEMA
    rows = payloads.select("symbol", "resolution", "payload_id", F.posexplode(F.from_json("body", schema)).alias("pos", "e"))
    if iso_time:
        ts = F.unix_micros(F.try_to_timestamp(F.col("e.t"))) * 1000
    else:
        ts = F.when(F.col("e.t") > 0, F.col("e.t") * 1_000_000)
    zero = F.lit(0.0)
    flat = rows.select(
        "symbol", "resolution", "payload_id", "pos", ts.alias("ts_ns"),
        *[F.coalesce(F.col(f"e.{n}"), zero).alias(n) for n in ("o", "h", "l", "c", "v")],
        F.coalesce("e.vw", "e.c", zero).alias("vw"))
    kept = flat.filter(F.col("ts_ns").isNotNull() & (F.least("o", "h", "l", "c") > 0))
    high, low = F.greatest("h", "o", "c"), F.least("l", "o", "c")
    bars = kept.select(
        "symbol", "resolution", "payload_id", "pos", "ts_ns", F.col("o").alias("open"), high.alias("high"),
        low.alias("low"), F.col("c").alias("close"), F.greatest(zero, "v").alias("volume"),
        F.when(F.col("vw") > 0, F.col("vw")).otherwise((high + low + F.col("c")) / 3.0).alias("vwap"),
        F.col("c").alias("adj_close"), F.lit(1.0).alias("split_factor"), F.lit(0.0).alias("dividend_amount"))
    legal = bars.filter(F.size(bar_violations(envelope=True)) == 0)
    return _last_per_timestamp(legal, ["symbol", "resolution", "payload_id", "ts_ns"], "pos")


# Provider order, first with data wins.
PROVIDER_RANK = {"polygon": 1, "alpaca": 2, "yahoo": 3}


def first_provider(bars: DataFrame) -> DataFrame:
    """Keep, per symbol, only rows of the best-ranked provider that has any.

    The best rank per symbol is a map-side-combined minimum, joined back; no window holds
    a symbol.
    """
    rank = F.lit(99)
    for name, r in PROVIDER_RANK.items():
        rank = F.when(F.col("provider") == name, r).otherwise(rank)
    ranked = bars.withColumn("_rank", rank)
    best = ranked.groupBy("symbol").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["symbol", "_rank"], "left_semi").drop("_rank")


#: Days of one stored partition.
SLICE_DAYS = 30
PARTS = ["resolution", "slice"]


def slice_of(ts_ns: str | Column) -> Column:
    """The stored partition of a time: whole runs of ``SLICE_DAYS`` days since the epoch."""
    return F.call_function("div", F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns, F.lit(SLICE_DAYS * 86_400_000_000_000))


def _store(sliced: DataFrame, path: str, mode: str) -> None:
    """Write sorted row ranges: few files a partition, and a heavy symbol spreads over its times."""
    placed = sliced.repartitionByRange(*PARTS, "symbol", "ts_ns").sortWithinPartitions(*PARTS, "symbol", "ts_ns")
    placed.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*PARTS).parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars partitioned by resolution and time slice, sorted by symbol and time for row-group skipping."""
    _store(bars.withColumn("slice", slice_of("ts_ns")), path, "static")


def stored_bars(spark: SparkSession, path: str, resolution: str | None = None, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Stored bars of one resolution in a closed range of time: only the partitions it touches are listed and read."""
    if start_ns is not None and end_ns is not None and start_ns > end_ns:
        raise ValueError("start_ns exceeds end_ns")
    found = spark.read.parquet(path)
    if resolution is not None:
        found = found.filter(F.col("resolution") == resolution)
    if start_ns is not None:
        found = found.filter((F.col("slice") >= slice_of(F.lit(start_ns))) & (F.col("ts_ns") >= start_ns))
    if end_ns is not None:
        found = found.filter((F.col("slice") <= slice_of(F.lit(end_ns))) & (F.col("ts_ns") <= end_ns))
    return found.drop("slice")


def upsert_bars(spark: SparkSession, path: str, incoming: DataFrame, version: str = "batch_seq") -> None:
    """Merge bars into the store; only partitions that incoming rows touch are rewritten, after the merge is safe in the checkpoint folder."""
    # held once: the merge and the list of partitions must see the same rows
    inc = cut_lineage(incoming.withColumn("slice", slice_of("ts_ns")))
    touched = inc.select(*PARTS).distinct()
    current = spark.read.parquet(path).join(touched, PARTS, "left_semi")
    merged = upsert(current.select(*inc.columns), inc, ["symbol", *PARTS, "ts_ns"], version)
    _store(cut_lineage(merged), path, "dynamic")


def latest_macro(observations: DataFrame, defaults: DataFrame) -> DataFrame:
    """Latest finite value per series; ``defaults`` (series_id, default_value) fill gaps."""
    clean = observations.withColumn("v", F.expr("try_cast(nullif(nullif(value, '.'), '') AS DOUBLE)")).filter(finite("v"))
    newest = clean.groupBy("series_id").agg(F.max_by("v", "date").alias("v"), F.max("date").alias("date"))
    return defaults.join(newest, "series_id", "full").select(
        "series_id", F.coalesce("v", "default_value").alias("value"), F.coalesce("date", F.lit("")).alias("date"),
        F.col("v").isNull().alias("is_default"))
