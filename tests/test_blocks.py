"""Block helpers give what plain windows give, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import blocks, execution, kernels, lots, series, stats, tail
from tickloom.operators.blocks import Running


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    # symbol A holds most rows; times are irregular
    sym = np.where(rng.random(600) < 0.7, "A", "B")
    ts = np.cumsum(rng.integers(1, 50, 600))
    pdf = pd.DataFrame({"symbol": sym, "ts_ns": ts, "v": rng.normal(size=600), "n": rng.integers(0, 4, 600)})
    pdf["gap"] = pdf["v"].where(rng.random(600) < 0.3)
    return spark.createDataFrame(pdf).withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))).cache()


def same(a, b, cols):
    x, y = (d.select("symbol", "ts_ns", *cols).orderBy("symbol", "ts_ns").toPandas() for d in (a, b))
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=1e-9, atol=1e-9)


def plain():
    return Window.partitionBy("symbol").orderBy("ts_ns")



@pytest.mark.parametrize("span", [40, 700, 10**9])
def test_index_and_running(rows, span):
    blk = blocks.time_block("ts_ns", span)
    got = blocks.running(rows, ["symbol"], ["ts_ns"], blk, {
        "s": Running("sum", F.col("v")), "m": Running("max", F.col("v")), "lo": Running("min", F.col("v")), "p": Running("product", F.col("v") * 0.01 + 1),
        "l": Running("last", F.col("gap")), "lb": Running("last", F.col("gap"), inclusive=False), "f": Running("first", F.col("gap")), "c": Running("count", F.col("gap")),
        "x": Running("sum_min", F.col("v")), "q": Running("product_max", F.col("v") * 0.01 + 1)})
    up = plain().rowsBetween(Window.unboundedPreceding, 0)
    below = plain().rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({
        "s": F.sum("v").over(up), "m": F.max("v").over(up), "lo": F.min("v").over(up), "p": F.product(F.col("v") * 0.01 + 1).over(up),
        "l": F.last("gap", True).over(up), "lb": F.last("gap", True).over(below), "f": F.first("gap", True).over(up), "c": F.count("gap").over(up)})
    want = want.withColumns({"x": F.col("s"), "q": F.col("p")}).withColumns({"x_ext": F.min("x").over(up), "q_ext": F.max("q").over(up)})
    same(got, want, ["s", "m", "lo", "p", "l", "lb", "f", "c", "x", "q", "x_ext", "q_ext"])
    same(blocks.index_rows(rows, ["symbol"], ["ts_ns"], blk), rows.withColumn("seq", F.row_number().over(plain())), ["seq"])


@pytest.mark.parametrize("size", [1, 7, 64, 65_536])
def test_rolling(rows, size):
    seq = blocks.index_rows(rows, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns", 500))
    got = blocks.rolling(seq, ["symbol"], lambda f: {"a": F.avg("v").over(f(-5, 0)), "z": F.max("v").over(f(2, 4))}, back=5, ahead=4, block_rows=size)
    want = rows.withColumns({"a": F.avg("v").over(plain().rowsBetween(-5, 0)), "z": F.max("v").over(plain().rowsBetween(2, 4))})
    same(got, want, ["a", "z"])


def test_relay_matches_one_pass(rows):
    z = rows.select("symbol", "ts_ns", (F.col("v") * 1.5).alias("z"))
    cols = ["alarm", "is_negative", "s_pos", "s_neg"]
    whole = kernels.cusum_with_reset(z, span_ns=10**9)
    same(kernels.cusum_with_reset(z, span_ns=300), whole, cols)
    assert whole.filter("alarm").count() > 3


def test_ema_matches_recursion(rows):
    got = series.ema_many(blocks.index_rows(rows, ["symbol"], ["ts_ns"], blocks.time_block("ts_ns", 100)), "v", {"e": 2 / 3, "s": 2 / 31}).toPandas()
    for _, g in got.sort_values("ts_ns").groupby("symbol"):
        for name, a in (("e", 2 / 3), ("s", 2 / 31)):
            assert np.allclose(g[name], g["v"].ewm(alpha=a, adjust=False).mean(), atol=1e-10)


def test_no_lookahead(rows):
    """Dropping the future changes nothing before it."""
    bars = rows.select("symbol", "ts_ns", (F.exp("v") + 1).alias("close"), (F.exp("v") + 2).alias("high"), F.lit(0.5).alias("low"), F.exp("v").alias("open"), F.lit(1.0).alias("volume"))
    cut = 8000
    for op, col in ((series.realised_vol, "realised_vol"), (series.garman_klass_lagged, "garman_klass_vol"), (lambda b: series.ema(b, "close", {"e": 5}), "e")):
        same(op(bars).filter(F.col("ts_ns") <= cut), op(bars.filter(F.col("ts_ns") <= cut)), [col])


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine tenths of 12,000 rows share one symbol, day and value; nulls and NaN among the rest."""
    n = 12_000
    rng = np.random.default_rng(5)
    hot = rng.random(n) < 0.9
    pdf = pd.DataFrame({"symbol": np.where(hot, "A", rng.choice(["A", "B"], n)), "ts_ns": rng.permutation(n) + 7, "id": [f"{i:05d}" for i in range(n)],
                        "v": np.where(hot, 0.25, rng.normal(size=n)), "w": rng.normal(size=n)})
    v = F.when(F.col("ts_ns") % 401 == 0, None).when(F.col("ts_ns") % 403 == 0, float("nan")).otherwise(F.col("v"))
    return blocks.cut_lineage(spark.createDataFrame(pdf).withColumn("v", v))


@pytest.mark.parametrize("order", [["ts_ns"], ["v", "id"], ["v", "w", "ts_ns"], ["id"]])
def test_blocks_bounded_by_rows(skewed, order):
    cut = blocks.row_blocks(skewed, ["symbol"], order, 400)
    sizes = cut.groupBy("symbol", "_blk").count().agg(F.max("count"), F.sum("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 400 and sizes[1] == 12_000 and sizes[2] < 400
    w = Window.partitionBy("symbol").orderBy(*order)
    got = blocks.index_rows(skewed, ["symbol"], order, blocks.Rows(400))
    assert got.join(skewed.withColumn("_w", F.row_number().over(w)), ["symbol", "id"]).filter("seq <> _w").isEmpty()
    run = blocks.running(skewed, ["symbol"], order, blocks.Rows(400), {"s": Running("sum", F.col("w"))})
    plain_sum = skewed.select("symbol", "id", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    assert run.join(plain_sum, ["symbol", "id"]).filter(F.abs(F.col("s") - F.col("_s")) > 1e-9).isEmpty()


def test_blocks_of_alike_null_and_no_rows(spark, skewed):
    alike = spark.range(900).select(F.lit("A").alias("k"), F.lit(1.0).alias("v"))
    assert blocks.row_blocks(alike, ["k"], ["v"], 100).select("_blk").distinct().count() == 1
    assert blocks.index_rows(alike, ["k"], ["v"], blocks.Rows(100)).agg(F.countDistinct("seq")).first()[0] == 900
    empty = alike.withColumn("v", F.when(F.col("v") > 5, 1.0))
    assert blocks.row_blocks(empty, ["k"], ["v"], 100).count() == 900
    assert blocks.row_blocks(alike.limit(0), ["k"], ["v"], 100).count() == 0
    lost = skewed.withColumn("symbol", F.when(F.col("symbol") == "B", "B"))
    sizes = blocks.row_blocks(lost, ["symbol"], ["ts_ns"], 400).groupBy("symbol", "_blk").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 400 and sizes[1] == 12_000


def test_operators_do_not_depend_on_row_bound(spark, skewed, monkeypatch):
    """Quantiles, tails, FDR, mark-outs, heartbeats and cash: 300 rows a block or the usual number."""
    plain_rows = skewed.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    tests = plain_rows.select("id", F.abs("v").alias("p"))
    fills = skewed.select("symbol", "ts_ns", "id", F.when(F.col("w") > 0, "BUY").otherwise("SELL").alias("side"), (F.exp("w") + 1).alias("price"),
                          F.lit(1.0).alias("quantity"), F.lit("P").alias("portfolio_id"))
    quotes = skewed.filter("ts_ns % 3 = 0").select("symbol", "ts_ns", (F.exp("w") + 1).alias("midpoint"))
    beats = skewed.select(F.col("symbol").alias("gateway"), (F.floor(F.col("ts_ns") / 50) * 4_000_000_000).alias("ts_ns"), F.col("ts_ns").alias("sequence"), F.abs("w").alias("latency_ms"))
    loss = plain_rows.select("symbol", F.abs("w").alias("excess"))

    def results():
        return [
            (stats.quantiles(plain_rows, ["symbol"], "w", {"a": 0.1, "b": 0.5}), ["symbol"]), (stats.fdr_adjust(tests, "p", "id"), ["id"]),
            (tail.gpd_fit(loss, ["symbol"]), ["symbol"]), (execution.markouts(fills, quotes, 5), ["symbol", "id"]),
            (execution.heartbeat_report(beats), ["gateway", "sequence"]), (lots.cash_balance(fills, ["ts_ns"], 10.0), ["id"])]

    usual = [d.orderBy(*k).toPandas() for d, k in results()]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 300)
    for want, (d, k) in zip(usual, results()):
        pd.testing.assert_frame_equal(d.orderBy(*k).toPandas()[want.columns], want, rtol=1e-9, atol=1e-7)
