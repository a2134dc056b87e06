"""Registered queries: bar ingest, scans and checks, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import quality, scan
from tickloom.plans import sqltext as S
from tickloom.session import workspace
from tickloom.sources import bars as src
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}
H = S.HOUR


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def _n(every: int = H):
    return F.expr(f"ts_ns div {every}")


@query("bar_ingest_counts", f"""WITH {S.raw()},
ok AS (SELECT *, open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close)
       AND low <= least(open, close) AND volume >= 0 AND NOT (volume > 0 AND vwap <= 0) AS ok FROM raw)
SELECT resolution, count(*) AS received, CAST(sum(ok::INT) AS BIGINT) AS valid,
       CAST(sum((NOT ok)::INT) AS BIGINT) AS quarantined,
       count(DISTINCT CASE WHEN ok THEN symbol || ':' || ts_ns END) AS persisted FROM ok GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.raw_bars(spark, d)
    text = rows.select("symbol", "resolution", *[F.col(c).cast("string").alias(c) for c in ["ts_ns", *src.BAR_FIELDS]])
    return src.ingest_counts(text)


@query("bar_ingest_good_rows", f"""WITH {S.raw()}
SELECT symbol, ts_ns, open, high, low, close, volume FROM raw
WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close)
  AND low <= least(open, close) AND volume >= 0 AND NOT (volume > 0 AND vwap <= 0)""")
def _(spark, d):
    good, _ = src.ingest_bars(fx.raw_bars(spark, d))
    return good.select("symbol", "ts_ns", "open", "high", "low", "close", "volume")


@query("bar_upsert", f"""WITH {S.bars()}, u AS (
  SELECT symbol, resolution, ts_ns, close, 1 AS b FROM bars
  UNION ALL SELECT symbol, resolution, ts_ns, close * 2, 2 FROM bars WHERE (ts_ns // {H}) % 3 = 0
  UNION ALL SELECT symbol, resolution, ts_ns + 1, close, 2 FROM bars WHERE (ts_ns // {H}) % 4 = 0)
SELECT symbol, resolution, ts_ns, close, CAST(b AS BIGINT) AS batch_seq FROM u
QUALIFY row_number() OVER (PARTITION BY symbol, resolution, ts_ns ORDER BY b DESC) = 1""")
def _(spark, d):
    b = fx.bars(spark, d).select("symbol", "resolution", "ts_ns", "close")
    old = b.withColumn("batch_seq", F.lit(1).cast("long"))
    new = b.filter(_n() % 3 == 0).withColumn("close", F.col("close") * 2).unionByName(
        b.filter(_n() % 4 == 0).withColumn("ts_ns", F.col("ts_ns") + 1)).withColumn("batch_seq", F.lit(2).cast("long"))
    return src.upsert(old, new, ["symbol", "resolution", "ts_ns"])


STORED = (1704412800000000000, 1706054400000000000)


@query("stored_range_scan", f"""WITH {S.bars()}, u AS (
  SELECT symbol, ts_ns, close, 1 AS b FROM bars
  UNION ALL SELECT symbol, ts_ns, close * 2, 2 FROM bars WHERE (ts_ns // {H}) % 3 = 0
  UNION ALL SELECT symbol, ts_ns + 1, close, 2 FROM bars WHERE (ts_ns // {H}) % 4 = 0)
SELECT symbol, ts_ns, close, CAST(b AS BIGINT) AS batch_seq FROM u WHERE ts_ns BETWEEN {STORED[0]} AND {STORED[1]}
QUALIFY row_number() OVER (PARTITION BY symbol, ts_ns ORDER BY b DESC) = 1""")
def _(spark, d):
    """Two resolutions stored, hourly bars merged in, then a closed range of hourly bars read back."""
    hourly, daily = fx.bars(spark, d), fx.bars(spark, d, 24 * H)
    path = workspace(spark, "bars")
    src.write_bars(hourly.unionByName(daily).withColumn("batch_seq", F.lit(1).cast("long")), path)
    again = hourly.filter(_n() % 3 == 0).withColumn("close", F.col("close") * 2)
    late = hourly.filter(_n() % 4 == 0).withColumn("ts_ns", F.col("ts_ns") + 1)
    src.upsert_bars(spark, path, again.unionByName(late).withColumn("batch_seq", F.lit(2).cast("long")))
    return src.stored_bars(spark, path, "1h", *STORED).select("symbol", "ts_ns", "close", "batch_seq")


def chart_payloads(spark: SparkSession, d: str) -> DataFrame:
    """One chart payload per symbol and day, with nulls, repeats and narrow ranges."""
    n = _n()
    b = fx.bars(spark, d).withColumns({
        "high": F.when(n % 9 == 0, F.col("high") * 0.5).otherwise(F.col("high")),
        "close": F.when(n % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("close")),
        "low": F.when(n % 19 == 0, -1.0).otherwise(F.col("low")),
        "volume": F.when(n % 4 == 0, F.lit(None).cast("double")).when(n % 6 == 1, -5.0).otherwise(F.col("volume")),
        "adj": F.when(n % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("close") * 0.9), "dup": F.lit(0)})
    again = b.filter(n % 5 == 0).withColumns({"dup": F.lit(1), "close": F.col("close") * 1.25})
    day = F.expr("ts_ns div 86400000000000")
    e = F.array_sort(F.collect_list(F.struct(
        F.expr("ts_ns div 1000000000").alias("t"), "dup", "open", "high", "low", "close", "volume", "adj")))
    per = b.unionByName(again).groupBy("symbol", "resolution", day.alias("payload_id")).agg(e.alias("e"))
    col = {k: F.col(f"e.{k}") for k in ("t", "open", "high", "low", "close", "volume", "adj")}
    quote = F.struct(*[col[k].alias(k) for k in ("open", "high", "low", "close", "volume")])
    first = F.col("e")[0]["t"]
    events = F.struct(
        F.when(F.col("payload_id") % 2 == 0, F.create_map(F.lit("s1"), F.struct(
            first.alias("date"), F.lit(4.0).alias("numerator"),
            F.when(F.col("payload_id") % 4 == 0, 0.0).otherwise(2.0).alias("denominator")))).alias("splits"),
        F.create_map(F.lit("d1"), F.struct(first.alias("date"), ((F.col("payload_id") % 5) * 0.1 - 0.1).alias("amount"))).alias("dividends"))
    result = F.struct(
        col["t"].alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(col["adj"].alias("adjclose"))).alias("adjclose")).alias("indicators"),
        events.alias("events"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return per.select("symbol", "resolution", "payload_id", body.alias("body"))


N = f"(ts_ns // {H})"


@query("chart_json_bars", f"""WITH {S.bars()}, x AS (
  SELECT symbol, ts_ns, open, CASE WHEN {N} % 9 = 0 THEN high * 0.5 ELSE high END AS high,
    CASE WHEN {N} % 19 = 0 THEN -1.0 ELSE low END AS low,
    CASE WHEN {N} % 7 = 0 THEN NULL ELSE close * (CASE WHEN {N} % 5 = 0 THEN 1.25 ELSE 1.0 END)::DOUBLE END AS close,
    CASE WHEN {N} % 4 = 0 THEN NULL WHEN {N} % 6 = 1 THEN -5.0 ELSE volume END AS volume,
    CASE WHEN {N} % 3 = 0 OR {N} % 7 = 0 THEN NULL ELSE close * 0.9 END AS adj_close FROM bars),
y AS (SELECT symbol, ts_ns, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close,
  CASE WHEN volume >= 0 THEN volume ELSE 0.0 END AS volume, adj_close FROM x
  WHERE close IS NOT NULL AND least(open, high, low, close) > 0)
SELECT *, round((high + low + close) / 3.0, 6) AS vwap FROM y""")
def _(spark, d):
    return src.parse_chart(chart_payloads(spark, d)).select(
        "symbol", "ts_ns", "open", "high", "low", "close", "volume", "adj_close", F.round("vwap", 6).alias("vwap"))


@query("corporate_actions", f"""WITH {S.bars()}, p AS (
  SELECT symbol, ts_ns // {24 * H} AS day, min(ts_ns) AS ts_ns FROM bars GROUP BY 1, 2)
SELECT symbol, ts_ns, 'SPLIT' AS action_type, 2.0::DOUBLE AS split_ratio, 0.0::DOUBLE AS cash_dividend
FROM p WHERE day % 2 = 0 AND day % 4 <> 0
UNION ALL SELECT symbol, ts_ns, 'CASH_DIVIDEND', 1.0, (day % 5) * 0.1::DOUBLE - 0.1::DOUBLE FROM p WHERE day % 5 > 0""")
def _(spark, d):
    return src.parse_corporate_actions(chart_payloads(spark, d))


def aggregate_payloads(spark: SparkSession, d: str, iso: bool) -> DataFrame:
    n = _n()
    b = fx.bars(spark, d).withColumns({
        "open": F.when(n % 7 == 0, 0.0).otherwise(F.col("open")),
        "vw": F.when(n % 5 == 0, F.lit(None).cast("double")).when(n % 3 == 0, 0.0).otherwise(F.col("close")), "dup": F.lit(0)})
    again = b.filter(n % 4 == 0).withColumns({"dup": F.lit(1), "volume": F.col("volume") + 7})
    micros = F.expr("ts_ns div 1000")
    t = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'") if iso else F.expr("ts_ns div 1000000")
    t = F.when(n % 11 == 0, F.lit(None)).otherwise(t)
    e = F.struct("ts_ns", "dup", t.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                 F.col("close").alias("c"), F.col("volume").alias("v"), "vw")
    per = b.unionByName(again).groupBy("symbol", "resolution", F.expr("ts_ns div 86400000000000").alias("payload_id")).agg(
        F.array_sort(F.collect_list(e)).alias("e"))
    rows = F.transform("e", lambda x: F.struct(
        x["t"].alias("t"), x["o"].alias("o"), x["h"].alias("h"), x["l"].alias("l"), x["c"].alias("c"),
        x["v"].alias("v"), x["vw"].alias("vw")))
    return per.select("symbol", "resolution", "payload_id", F.to_json(rows).alias("body"))


AGGREGATE_SQL = f"""WITH {S.bars()}, x AS (
  SELECT symbol, ts_ns, open, high, low, close, CASE WHEN {N} % 4 = 0 THEN volume + 7 ELSE volume END AS volume,
    CASE WHEN {N} % 5 = 0 THEN close WHEN {N} % 3 = 0 THEN (high + low + close) / 3.0 ELSE close END AS vwap
  FROM bars WHERE {N} % 7 <> 0 AND {N} % 11 <> 0)
SELECT symbol, ts_ns, open, high, low, close, volume, round(vwap, 6) AS vwap, close AS adj_close FROM x"""


def _aggregate(spark, d, iso):
    return src.parse_aggregates(aggregate_payloads(spark, d, iso), iso).select(
        "symbol", "ts_ns", "open", "high", "low", "close", "volume", F.round("vwap", 6).alias("vwap"), "adj_close")


query("aggregate_json_bars_ms", AGGREGATE_SQL)(lambda spark, d: _aggregate(spark, d, False))
query("aggregate_json_bars_iso", AGGREGATE_SQL)(lambda spark, d: _aggregate(spark, d, True))


@query("provider_precedence", f"""WITH {S.bars()}, u AS (
  SELECT symbol, ts_ns, close, 'yahoo' AS provider, 3 AS r FROM bars
  UNION ALL SELECT symbol, ts_ns, close * 1.5, 'alpaca', 2 FROM bars WHERE symbol IN ('click', 'view')
  UNION ALL SELECT symbol, ts_ns, close * 2.0, 'polygon', 1 FROM bars WHERE symbol IN ('error', 'view'))
SELECT symbol, ts_ns, close, provider FROM u QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY r) = 1""")
def _(spark, d):
    b = fx.bars(spark, d).select("symbol", "ts_ns", "close")
    landed = b.withColumn("provider", F.lit("yahoo")).unionByName(
        b.filter(F.col("symbol").isin("click", "view")).withColumn("close", F.col("close") * 1.5).withColumn("provider", F.lit("alpaca"))
    ).unionByName(
        b.filter(F.col("symbol").isin("error", "view")).withColumn("close", F.col("close") * 2.0).withColumn("provider", F.lit("polygon")))
    return src.first_provider(landed)


@query("macro_latest", """WITH o AS (
  SELECT 'S' || (o_custkey % 50) AS series_id, strftime(o_orderdate, '%Y-%m-%d') || ':' || lpad(o_orderkey::VARCHAR, 12, '0') AS date,
    CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 50 = 7 THEN NULL ELSE o_totalprice END AS v FROM orders),
c AS (SELECT series_id, arg_max(v, date) AS v, max(date) AS date FROM o WHERE v IS NOT NULL GROUP BY 1),
dflt AS (SELECT DISTINCT 'S' || (o_custkey % 50) AS series_id FROM orders)
SELECT series_id, coalesce(v, 0.15::DOUBLE) AS value, coalesce(date, '') AS date, v IS NULL AS is_default
FROM dflt LEFT JOIN c USING (series_id)""")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    sid = F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string"))
    date = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(":"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    value = F.when((F.col("o_orderkey") % 3 == 0) | (F.col("o_custkey") % 50 == 7),
                   F.element_at(F.array(F.lit("."), F.lit(""), F.lit("NaN"), F.lit("n/a")), (F.col("o_orderkey") % 4 + 1).cast("int"))
                   ).otherwise(F.col("o_totalprice").cast("string"))
    obs = o.select(sid.alias("series_id"), date.alias("date"), value.alias("value"))
    defaults = obs.select("series_id").distinct().withColumn("default_value", F.lit(0.15))
    return src.latest_macro(obs, defaults)


@query("range_scan", f"""WITH {S.bars()} SELECT symbol, ts_ns, open, high, low, close, volume FROM bars
WHERE symbol = 'click' AND ts_ns BETWEEN 1704412800000000000 AND 1705276800000000000""")
def _(spark, d):
    return scan.bars_range(fx.bars(spark, d), "click", 1704412800000000000, 1705276800000000000, "1h").select(
        "symbol", "ts_ns", "open", "high", "low", "close", "volume")


@query("latest_bars", f"""WITH {S.bars()} SELECT symbol, ts_ns, close FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC) <= 25""")
def _(spark, d):
    return scan.latest_bars(fx.bars(spark, d), 25).select("symbol", "ts_ns", "close")


@query("available_range", f"WITH {S.bars()} SELECT symbol, resolution, min(ts_ns) AS min_ns, max(ts_ns) AS max_ns FROM bars GROUP BY 1, 2")
def _(spark, d):
    return scan.available_range(fx.bars(spark, d))


@query("all_symbols", f"WITH {S.bars()} SELECT DISTINCT symbol FROM bars WHERE resolution = '1h'")
def _(spark, d):
    return scan.symbols(fx.bars(spark, d), "1h")


@query("bar_count", f"WITH {S.bars()} SELECT count(*) AS n FROM bars WHERE symbol = 'view' AND resolution = '1h'")
def _(spark, d):
    return scan.bar_count(fx.bars(spark, d), "view", "1h")


@query("universe_prices", f"""WITH {S.hist()} SELECT symbol, ts_ns, coalesce(nullif(adj_close, 0), close) AS price
FROM hist WHERE symbol IN ('click', 'view', 'signup')""")
def _(spark, d):
    return scan.universe_prices(fx.historical_bars(spark, d), ["click", "view", "signup"], "adj_close")


@query("candlesticks", f"""WITH t AS (SELECT event_type AS symbol, epoch_us(ts) * 1000 AS ts_ns, value, event_id FROM events),
q AS (SELECT symbol, (ts_ns // 250000000) * 250000000 AS b, first(value ORDER BY ts_ns, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts_ns, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY 1, 2)
SELECT symbol, b // 1000000000 AS time_s, open, high, low, close, volume FROM q
QUALIFY row_number() OVER (PARTITION BY symbol, b // 1000000000 ORDER BY b) = 1""")
def _(spark, d):
    pos = F.struct("ts_ns", "event_id")
    quarter = fx.ticks(spark, d).groupBy("symbol", (F.expr("ts_ns div 250000000") * 250000000).alias("b")).agg(
        F.min_by("price", pos).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", pos).alias("close"), F.sum("size").alias("volume")).withColumnRenamed("b", "ts_ns")
    return scan.candlesticks(quarter)


@query("bar_summary", f"""WITH {S.bars()}, r AS (
  SELECT *, ln(close / lag(close) OVER w) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns DESC) AS back FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns))
SELECT symbol, count(*) AS n, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, arg_max(close, ts_ns) AS latest_close,
  round(stddev_samp(r) FILTER (back <= 20), 8) AS realized_volatility FROM r GROUP BY 1""")
def _(spark, d):
    return scan.bar_summary(fx.bars(spark, d)).withColumn("realized_volatility", F.round("realized_volatility", 8))


@query("events_for_asset", """SELECT d.doc_id AS event_id, d.source AS asset_id, d.doc_id * 60000000000 AS ts_ns,
  1.0::DOUBLE / (1 + d.doc_id % 4) AS centrality FROM documents d
WHERE d.doc_id * 60000000000 BETWEEN 3600000000000 AND 36000000000000""")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    events = docs.select(F.col("doc_id").alias("event_id"), (F.col("doc_id") * 60_000_000_000).alias("ts_ns"))
    edges = docs.select(F.col("doc_id").alias("event_id"), F.col("source").alias("asset_id"),
                        (F.lit(1.0) / (1 + F.col("doc_id") % 4)).alias("centrality"))
    return scan.events_for_asset(events, edges, 3_600_000_000_000, 36_000_000_000_000)


@query("point_lookup", "SELECT s_suppkey AS id, upper(s_name) AS ticker, s_acctbal FROM supplier WHERE upper(s_name) = 'SUPPLIER#000000042'")
def _(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("ticker"), "s_acctbal")
    return scan.lookup(s, "ticker", "Supplier#000000042", upper=True)


@query("active_assets", "SELECT c_custkey AS id, c_name AS ticker FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("ticker"), (F.col("c_acctbal") > 0).alias("is_active"))
    return scan.active(c).select("id", "ticker")


@query("alpha_cohort", """SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS fitness FROM part
WHERE p_brand = 'Brand#2' ORDER BY fitness DESC NULLS LAST, id LIMIT 20""")
def _(spark, d):
    p = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("cohort"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("fitness"))
    return scan.top_by_fitness(p, "Brand#2", 20).select("id", "fitness")


@query("generation_filter", "SELECT p_partkey AS id, p_size::BIGINT AS generation FROM part WHERE p_size = 7")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("generation"))
    return scan.lookup(p, "generation", 7)


def reports(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "lineitem").groupBy(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("report_id")
    ).agg(F.min("l_orderkey").cast("string").alias("cl_ord_id"), F.min("l_returnflag").alias("symbol"),
          F.min(fx.to_ns("l_shipdate")).alias("ts_ns"), F.sum("l_quantity").alias("last_quantity"))


@query("audit_query", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS report_id,
  min(l_orderkey)::VARCHAR AS cl_ord_id, min(l_returnflag) AS symbol, min(epoch_us(l_shipdate) * 1000) AS ts_ns, sum(l_quantity) AS last_quantity
FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = 'R' ORDER BY ts_ns, report_id LIMIT 200""")
def _(spark, d):
    return scan.query_reports(reports(spark, d), symbol="R", limit=200)


@query("order_listing", """SELECT o_orderkey AS order_id, o_orderpriority AS symbol, epoch_us(o_orderdate) * 1000 AS created_ns, true AS is_closed
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY created_ns DESC, order_id DESC LIMIT 500 OFFSET 30""")
def _(spark, d):
    o = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("symbol"),
        fx.to_ns("o_orderdate").alias("created_ns"), (F.col("o_orderstatus") == "F").alias("is_closed"))
    return scan.list_orders(o, "1-URGENT", True, limit=9999, offset=30)


@query("score_update", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_size % 5 <> 0 THEN p_retailprice * 2 ELSE p_retailprice END AS fitness FROM part""")
def _(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("fitness"), "p_size")
    scores = p.filter(F.col("p_size") % 3 == 0).select(
        "id", F.when(F.col("p_size") % 5 != 0, F.col("fitness") * 2).alias("fitness"))
    return scan.apply_scores(p.drop("p_size"), scores, ["fitness"])


@query("bar_violations", f"""WITH {S.raw()}, v AS (
  SELECT symbol, unnest([CASE WHEN least(open, high, low, close) <= 0 THEN 'NON_POSITIVE_PRICE' END,
    CASE WHEN high < greatest(open, close) THEN 'HIGH_BELOW_BODY' END, CASE WHEN low > least(open, close) THEN 'LOW_ABOVE_BODY' END,
    CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN volume > 0 AND vwap <= 0 THEN 'VWAP_NOT_POSITIVE' END,
    CASE WHEN volume > 0 AND vwap > 0 AND (vwap < low - 1e-4 OR vwap > high + 1e-4) THEN 'VWAP_OUTSIDE_RANGE' END]) AS violation FROM raw)
SELECT symbol, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return quality.violation_report(fx.raw_bars(spark, d))


@query("timestamp_order", """WITH e AS (SELECT event_type AS symbol, event_id AS arrival,
  (epoch_us(ts) * 1000) - CASE WHEN event_id % 17 = 0 THEN 9000000000000 ELSE 0 END AS ts_ns FROM events)
SELECT symbol, arrival, ts_ns, prev_ns FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY arrival) AS prev_ns FROM e)
WHERE ts_ns <= prev_ns""")
def _(spark, d):
    t = fx.ticks(spark, d).select(
        "symbol", F.col("event_id").alias("arrival"),
        (F.col("ts_ns") - F.when(F.col("event_id") % 17 == 0, F.lit(9_000_000_000_000)).otherwise(F.lit(0))).alias("ts_ns"))
    return quality.order_violations(t).select("symbol", "arrival", "ts_ns", "prev_ns")


@query("split_adjusted", f"""WITH {S.hist()}, f AS (SELECT *, coalesce(split_factor, 1.0) AS sf, coalesce(dividend_amount, 0.0) AS dv FROM hist)
SELECT symbol, ts_ns, round(open * sf, 6) AS open, round(high * sf, 6) AS high, round(low * sf, 6) AS low, round(close * sf, 6) AS close,
  round(volume / sf, 6) AS volume, round(dv * sf, 6) AS dividend_amount, 1.0::DOUBLE AS split_factor FROM f""")
def _(spark, d):
    b = quality.split_adjust(quality.fill_historical_defaults(fx.historical_bars(spark, d)))
    return b.select("symbol", "ts_ns", "split_factor", *[F.round(c, 6).alias(c) for c in (
        "open", "high", "low", "close", "volume", "dividend_amount")])


@query("historical_defaults", f"""WITH {S.hist()} SELECT symbol, ts_ns, CASE WHEN adj_close > 0 THEN adj_close ELSE close END AS adj_close,
  CASE WHEN split_factor > 0 THEN split_factor ELSE 1.0 END AS split_factor,
  CASE WHEN dividend_amount >= 0 THEN dividend_amount ELSE 0.0 END AS dividend_amount FROM hist""")
def _(spark, d):
    return quality.fill_historical_defaults(fx.historical_bars(spark, d)).select(
        "symbol", "ts_ns", "adj_close", "split_factor", "dividend_amount")


@query("news_causality", """WITH a AS (SELECT doc_id, doc_id * 1000000000 AS published_ns,
  doc_id * 1000000000 + (doc_id % 7 - 4) * 1000000000 AS available_ns FROM documents)
SELECT doc_id, available_ns >= published_ns - 2000000000 AS is_causal, published_ns > 560000000000 AS is_future FROM a""")
def _(spark, d):
    a = fx.table(spark, d, "documents").select(
        "doc_id", (F.col("doc_id") * 1_000_000_000).alias("published_ns"),
        ((F.col("doc_id") + F.col("doc_id") % 7 - 4) * 1_000_000_000).alias("available_ns"))
    return quality.causality(a, 500_000_000_000).select("doc_id", "is_causal", "is_future")


@query("signal_contract", f"""WITH {S.bars()}, s AS (SELECT symbol, ts_ns, (ts_ns // {H}) % 5 AS m, (close - open) / 100 AS w FROM bars),
v AS (SELECT symbol, ts_ns, unnest([CASE WHEN w < -1 OR w > 1 THEN 'WEIGHT_BOUNDS' END, CASE WHEN m = 4 THEN 'CONVICTION_BOUNDS' END,
  CASE WHEN m = 3 THEN 'HORIZON' END, CASE WHEN m IN (0, 3) AND w <= 0 THEN 'LONG_SIGN' END, CASE WHEN m IN (1, 4) AND w >= 0 THEN 'SHORT_SIGN' END,
  CASE WHEN m = 2 AND abs(w) > 1e-7 THEN 'FLAT_SIGN' END, CASE WHEN m = 1 THEN 'STOP' END]) AS violation FROM s)
SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1""")
def _(spark, d):
    m = _n() % 5
    s = fx.bars(spark, d).select(
        "symbol", "ts_ns", ((F.col("close") - F.col("open")) / 100).alias("target_weight"),
        F.when(m.isin(0, 3), "LONG").when(m.isin(1, 4), "SHORT").otherwise("FLAT").alias("direction"),
        F.when(m == 4, 1.5).otherwise(0.5).alias("conviction"), F.when(m == 3, 0).otherwise(10).alias("horizon_bars"),
        F.when(m == 1, 0.0).when(m == 2, F.lit(None).cast("double")).otherwise(0.02).alias("stop_loss_pct"),
        F.lit(None).cast("double").alias("take_profit_pct"))
    return s.select(F.explode(quality.signal_violations()).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("warm_rows", f"""WITH {S.bars()} SELECT symbol, ts_ns, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS seq FROM bars
QUALIFY seq >= 120""")
def _(spark, d):
    return quality.warm(fx.bars(spark, d), 120).select("symbol", "ts_ns", "seq")
