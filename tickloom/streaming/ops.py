"""Event-time operators over streams. State steps are those of the batch kernels.

Every function maps a streaming DataFrame to a streaming DataFrame; ``ts`` is the event
time. State per key is bounded by a watermark, a look-back length or a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, StructField, StructType

from tickloom.operators.filters import weights_for
from tickloom.operators.kernels import TIERS, cusum_step, tier_step


def with_event_time(stream: DataFrame, ns: str = "ts_ns") -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros(F.expr(f"{ns} div 1000")))


def tick_bars(ticks: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars of (symbol, ts, ts_ns, event_id, price, size)."""
    pos = F.struct("ts_ns", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "symbol").agg(
        F.min_by("price", pos).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", pos).alias("close"),
        F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"))
    return bars.select("symbol", (F.unix_micros("w.start") * 1000).alias("ts_ns"), "open", "high", "low", "close", "volume", "vwap")


def unique(stream: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """First row per key within the watermark: article hashes or client order ids."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def intensity(news: DataFrame, length: str = "2 hours", slide: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sliding article counts per ticker."""
    return news.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w"), "ticker").agg(F.count(F.lit(1)).alias("articles")).select(
        "ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "articles")


def sessions(news: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Bursts of articles per ticker, closed after a quiet gap."""
    return news.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "ticker").agg(F.count(F.lit(1)).alias("articles")).select(
        "ticker", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "articles")


PIECE = 100_000


def _order(stream: DataFrame) -> list[str]:
    """Time, then the event_id of rows of one time, where there is one; output rows carry both."""
    return ["ts_ns", "event_id"] if "event_id" in stream.columns else ["ts_ns"]


def _schema(key: str, order: list[str], rest: str) -> str:
    return ", ".join([f"{key} string", *[f"{c} long" for c in order], rest])


def _rows(batches: Iterator[pd.DataFrame], order: list[str], values: list[str] | None = None) -> pd.DataFrame:
    """The batches in order, without the columns that a step does not read."""
    keep = [*order, *(values or [])]
    return pd.concat([b[keep] for b in batches]).sort_values(order, kind="stable")


def _pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Bounded runs of rows, so that a step holds the Python objects of few of them."""
    for at in range(0, len(rows), PIECE):
        yield rows.iloc[at : at + PIECE]


def online_frac_diff(bars: DataFrame, weights: list[float], history: dict[str, list[float]] | None = None) -> DataFrame:
    """Fractional difference per new bar; state is the last L closes, seeded from ``history``.

    ``history`` holds at most L closes per symbol of the bars before the stream. A column ``lookback`` of ``bars``
    gives a symbol its own L: of ``weights``, those up to it count, the first one replaced so that all sum to zero.
    Bars of one time follow their event_id, where there is one.
    """
    seed, own, cut = history or {}, "lookback" in bars.columns, weights_for(weights)
    order = _order(bars)

    def step(key, batches, state: GroupState):
        rows = _rows(batches, order, ["close", "lookback"] if own else ["close"])
        w = cut(int(rows["lookback"].iloc[0])) if own else np.array(weights)
        l = len(w) - 1
        before = list(state.get[0]) if state.exists else list(seed.get(key[0], []))
        x = np.concatenate([before[len(before) - min(l, len(before)) :], rows["close"].to_numpy(dtype=float)])
        y = np.convolve(x, w, "valid") if len(x) > l else np.zeros(0)
        state.update((x[max(0, len(x) - l) :].tolist(),))
        named = rows[order].iloc[len(rows) - len(y) :].assign(ffd=y)
        del rows
        for piece in _pieces(named):
            yield piece.assign(symbol=key[0])[["symbol", *order, "ffd"]]

    return bars.groupBy("symbol").applyInPandasWithState(
        step, _schema("symbol", order, "ffd double"), "buf array<double>", "append", GroupStateTimeout.NoTimeout)


def online_cusum(z_scores: DataFrame, threshold: float = 3.0, drift: float = 0.5, min_dwell: int = 3) -> DataFrame:
    """Resetting CUSUM alarms per symbol, same step as the batch kernel; rows of one time follow their event_id."""
    order = _order(z_scores)

    def step(key, batches, state: GroupState):
        pos, neg, dwell = state.get if state.exists else (0.0, 0.0, 0)
        for piece in _pieces(_rows(batches, order, ["z"])):
            out = []
            for *at, z in piece.itertuples(index=False):
                dwell = min(dwell + 1, min_dwell)
                alarm, down, pos, neg = cusum_step(z, dwell, pos, neg, threshold, drift, min_dwell)
                dwell = 0 if alarm else dwell
                out.append((key[0], *at, alarm, down, pos, neg))
            yield pd.DataFrame(out, columns=["symbol", *order, "alarm", "is_negative", "s_pos", "s_neg"])
        state.update((float(pos), float(neg), int(dwell)))

    return z_scores.groupBy("symbol").applyInPandasWithState(
        step, _schema("symbol", order, "alarm boolean, is_negative boolean, s_pos double, s_neg double"), "p double, n double, d long", "append", GroupStateTimeout.NoTimeout)


def online_tiers(shocks: DataFrame, dwell: int = 5) -> DataFrame:
    """Breaker tier per bar of (book, ts_ns, shock, haircut, panic); rows of one time follow their event_id."""
    order = _order(shocks)

    def step(key, batches, state: GroupState):
        tier, bars = state.get if state.exists else (0, 0)
        for piece in _pieces(_rows(batches, order, ["shock", "haircut", "panic"])):
            out = []
            for *at, shock, cut, panic in piece.itertuples(index=False):
                tier, bars = tier_step(tier, bars, shock, bool(panic), dwell=dwell)
                out.append((key[0], *at, TIERS[tier], bars, 0.0 if tier >= 2 else min(0.5, cut) if tier == 1 else cut))
            yield pd.DataFrame(out, columns=["book", *order, "tier", "bars_in_tier", "execution_haircut"])
        state.update((int(tier), int(bars)))

    return shocks.groupBy("book").applyInPandasWithState(
        step, _schema("book", order, "tier string, bars_in_tier long, execution_haircut double"), "t int, b long", "append", GroupStateTimeout.NoTimeout)


def liveness(beats: DataFrame, timeout_s: float = 15.0, delay: str = "0 seconds") -> DataFrame:
    """CONNECTED on each first beat after silence, DISCONNECTED when the watermark passes the timeout."""
    ms = int(timeout_s * 1000)

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], last + ms * 1_000_000, "DISCONNECTED")], columns=["gateway", "ts_ns", "status"])
            return
        last = state.get[0] if state.exists else None
        out = []
        for ts in _rows(batches, ["ts_ns"])["ts_ns"]:
            if last is None or ts - last >= ms * 1_000_000:
                if last is not None:
                    out.append((key[0], last + ms * 1_000_000, "DISCONNECTED"))
                out.append((key[0], int(ts), "CONNECTED"))
            last = int(ts)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1_000_000 + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["gateway", "ts_ns", "status"])

    return beats.withWatermark("ts", delay).groupBy("gateway").applyInPandasWithState(
        step, "gateway string, ts_ns long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def portfolio_alerts(changes: DataFrame, max_drawdown: float = 0.1, max_leverage: float = 2.0) -> DataFrame:
    """Drawdown and leverage alerts from per-portfolio equity and gross exposure updates."""
    order = _order(changes)

    def step(key, batches, state: GroupState):
        peak = state.get[0] if state.exists else float("-inf")
        out = []
        for *at, equity, gross in _rows(batches, order, ["equity", "gross"]).itertuples(index=False):
            peak = max(peak, equity)
            dd = max(0.0, (peak - equity) / peak) if peak > 0 else (1.0 if equity <= 0 else 0.0)
            lev = gross / equity if equity > 0 else float("inf")
            if dd >= max_drawdown:
                out.append((key[0], *at, "DRAWDOWN", dd))
            if lev > max_leverage:
                out.append((key[0], *at, "LEVERAGE", lev))
        state.update((float(peak),))
        yield pd.DataFrame(out, columns=["portfolio_id", *order, "alert", "level"])

    return changes.groupBy("portfolio_id").applyInPandasWithState(
        step, _schema("portfolio_id", order, "alert string, level double"), "peak double", "append", GroupStateTimeout.NoTimeout)


BLOCK = 4_096
HELD = 2_000_000


def _in_blocks(rows: DataFrame, at: str, name: str) -> DataFrame:
    """Rows of one (symbol, bucket) as arrays ``name`` of at most BLOCK rows in order of ``at``, with its first and last value.

    A task holds at most HELD rows; what arrives later goes into further blocks.
    """
    key = ["symbol", "bucket"]
    cells = [f for f in rows.schema if f.name not in key]

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in [*key, at]]).combine_chunks()
        n = t.num_rows
        symbol = pc.dictionary_encode(t["symbol"].combine_chunks()).indices.to_numpy()
        bucket = t["bucket"].cast(pa.int64()).to_numpy()
        runs = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (bucket[1:] != bucket[:-1])))
        place = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
        edges = np.append(np.flatnonzero(place % BLOCK == 0), n)
        first, last = t.take(edges[:-1]), t.take(edges[1:] - 1)
        parts = pa.StructArray.from_arrays([t[f.name].combine_chunks() for f in cells], [f.name for f in cells])
        found = [*(first[c] for c in key), first[at], last[at], pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts)]
        return pa.Table.from_arrays(found, [*key, "first", "last", name]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield cut(held)
                held, n = [], 0
        if n:
            yield cut(held)

    kind = rows.schema[at].dataType
    schema = StructType([*(rows.schema[c] for c in key), StructField("first", kind), StructField("last", kind), StructField(name, ArrayType(StructType(cells)))])
    return rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*key, at])).repartition(*key).mapInArrow(run, schema)


def markout_blocks(fills: DataFrame, quotes: DataFrame, horizon: str = "1 minute", tolerance: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Blocks of fills beside the blocks of quotes that may lie in their windows, by a watermarked join of streams.

    Time is cut into buckets one tolerance long: a quote is in one, a fill looks into at most two, so no row meets its
    whole symbol. What the stream keeps and hands on are blocks, which grow with the events; ``markouts_of`` takes the
    pairs out of them, which grow with their square. An event_id of the quotes comes out as quote_id. A block has the
    time of its bucket, so the watermark waits two buckets longer than ``delay``.
    """
    named = [F.col("event_id").alias("quote_id")] if "event_id" in quotes.columns else []
    length = f"greatest(unix_micros(timestamp_micros(0) + INTERVAL {tolerance}), 1000000L)"
    bucket = lambda at: f"unix_micros({at}) - pmod(unix_micros({at}), {length})"
    start = f"fill_ts + INTERVAL {horizon}"
    wait = f"{delay} {tolerance} {tolerance} 2 seconds"
    f = fills.select("symbol", "event_id", "venue", "side", "price", F.col("ts").alias("fill_ts"))
    f = f.withColumn("us", F.explode(F.expr(f"sequence({bucket(start)}, {bucket(f'{start} + INTERVAL {tolerance}')}, {length})")))
    f = _in_blocks(f.withColumn("bucket", F.timestamp_micros("us")).drop("us"), "fill_ts", "fills").withWatermark("bucket", wait)
    q = quotes.select("symbol", *named, "midpoint", F.col("ts").alias("quote_ts"))
    q = _in_blocks(q.withColumn("bucket", F.expr(f"timestamp_micros({bucket('quote_ts')})")), "quote_ts", "quotes").withWatermark("bucket", wait)
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in ("symbol", "bucket", "first", "last")], "quotes")
    on = F.expr(f"symbol = q_symbol AND bucket = q_bucket AND q_last >= first + INTERVAL {horizon} AND q_first <= last + INTERVAL {horizon} + INTERVAL {tolerance}")
    return f.join(q, on, "inner").select("symbol", "fills", "quotes")


def markouts_of(blocks: DataFrame, horizon: str = "1 minute", tolerance: str = "1 minute") -> DataFrame:
    """The pairs of a fill and a quote in its window, out of ``markout_blocks``; none is stored or shuffled."""
    start = f"fill_ts + INTERVAL {horizon}"
    # the window is reckoned once a fill, not once a pair
    window = [f"unix_micros({start}) AS opens", f"unix_micros({start} + INTERVAL {tolerance}) AS closes"]
    fills = blocks.select("symbol", "quotes", F.inline("fills")).selectExpr("*", *window)
    pairs = fills.select(*[c for c in fills.columns if c != "quotes"], F.inline("quotes")).filter("unix_micros(quote_ts) BETWEEN opens AND closes")
    side = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    return pairs.select("symbol", "event_id", "venue", "fill_ts", *[c for c in pairs.columns if c == "quote_id"], "quote_ts", (side * (F.col("midpoint") - F.col("price")) / F.col("price") * 10_000.0).alias("markout_bps"))


def markout_join(fills: DataFrame, quotes: DataFrame, horizon: str = "1 minute", tolerance: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Quotes in [fill + horizon, fill + horizon + tolerance] per fill, by a watermarked interval join."""
    return markouts_of(markout_blocks(fills, quotes, horizon, tolerance, delay), horizon, tolerance)
