"""Fractional filters by FFT against plain sums, for several look-backs, blocks and keys at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import filters, series


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for symbol, n in (("short", 9), ("ten", 40), ("mid", 300), ("long", 2500)):
        x = rng.normal(size=n).cumsum() + 400
        rows += [(symbol, 7 * i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts_ns long, close double").repartition(4).cache()


def plain(x, d, threshold):
    w = series.fractional_weights(d, threshold, max(10, math.floor(len(x) * 0.2)), True)
    return w, {7 * t: sum(w[k] * x[t - k] for k in range(len(w))) for t in range(len(w) - 1, len(x))}


@pytest.mark.parametrize("d, threshold", [(0.4, 1e-4), (0.9, 1e-3), (1.0, 1e-4), (0.0, 1e-4)])
@pytest.mark.parametrize("block_rows", [64, 1 << 16])
def test_each_key_has_its_own_look_back(walks, d, threshold, block_rows):
    got = filters.frac_diff(walks, d, threshold, block_rows=block_rows).collect()
    found = {(r.symbol, r.ts_ns): r.ffd for r in got}
    want, backs = {}, {}
    for symbol in ("short", "ten", "mid", "long"):
        x = [r.close for r in walks.filter(F.col("symbol") == symbol).orderBy("ts_ns").collect()]
        w, y = plain(x, d, threshold)
        backs[symbol] = len(w) - 1
        want |= {(symbol, t): v for t, v in y.items()}
    assert found == pytest.approx(want, abs=1e-9)
    assert {r.symbol: r.lookback for r in got}.items() <= backs.items()
    if (d, threshold) == (0.4, 1e-4):
        assert backs["long"] > 250 and backs["mid"] == 60 and backs["ten"] == 10


def test_padded_rows_are_null(walks):
    got = filters.frac_diff(walks, 0.4, 1e-4, pad=True)
    assert got.count() == walks.count()
    assert got.filter("ffd is null").count() == 9 + 10 + 60 + len(series.fractional_weights(0.4, 1e-4)) - 1


@pytest.mark.parametrize("block_rows", [50, 333, 1 << 16])
def test_inverse_gives_the_series_back(walks, block_rows):
    diff = filters.frac_diff(walks, 0.4, 1e-4)
    back = filters.lookbacks(walks, len(series.fractional_weights(0.4, 1e-4)) - 1)
    head = series.sequenced(walks).join(back, "symbol").filter("seq <= lookback").groupBy("symbol", "lookback").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "close"))), lambda e: e["close"]).alias("anchor"))
    got = {(r.symbol, r.ts_ns): r.value for r in filters.inverse_frac_diff(diff.select("symbol", "ts_ns", "ffd"), head, 0.4, 1e-4, block_rows).collect()}
    want = {(r.symbol, r.ts_ns): r.close for r in walks.collect() if (r.symbol, r.ts_ns) in got}
    assert len(got) == diff.count() and got == pytest.approx(want, abs=1e-6)


def test_blocks_hand_on_a_look_back_not_its_square(walks):
    diff = filters.frac_diff(walks, 0.4, 1e-4).select("symbol", "ts_ns", "ffd")
    anchors = walks.groupBy("symbol").agg(F.lit(10).alias("lookback"), F.array(*[F.lit(0.0)] * 10).alias("anchor"))
    plan = filters.inverse_frac_diff(diff, anchors, 0.4)._jdf.queryExecution().analyzed().toString()
    assert "_map" not in plan and "_tail" in plan


def test_reciprocal_series():
    w = filters.weights_for(series.fractional_weights(0.4, 1e-4, None, False))(200)
    g = filters.reciprocal(w, 1000)
    one = filters.convolve(w, g, 1000)
    assert one[0] == pytest.approx(1.0) and np.abs(one[1:]).max() < 1e-12


def test_empty(walks):
    none = walks.limit(0)
    assert filters.frac_diff(none, 0.4).count() == 0
    anchors = none.select("symbol", F.lit(1).alias("lookback"), F.array("close").alias("anchor"))
    assert filters.inverse_frac_diff(none.select("symbol", "ts_ns", F.col("close").alias("ffd")), anchors, 0.4).count() == 0
