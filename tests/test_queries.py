"""Registered queries against DuckDB, streams against batch, and plan shapes."""

import re

import pytest

import __spark_entry__ as entry
import check
from tickloom.operators import kernels, series
from tickloom.plans import catalog_streams, registry
from tickloom.sources import fixtures as fx
from tickloom.streaming import ops

# A cross-section of every area; tools/check.py runs them all.
SAMPLE = [
    "bar_upsert", "chart_json_bars", "aligned_returns", "cusum_two_sided", "ema", "triple_barrier_sides", "cv_roles", "fdr_by", "tear_sheet_daily", "evt_pwm_risk",
    "news_novelty", "entity_centrality", "active_news_state", "fifo_matches", "journal_accounts", "markouts", "order_screen", "population_ranking", "backtest_equity", "stream_bars", "stream_sessions",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    note = check.compare(entry.queries()[name](spark, sf), check.oracle(sf), entry.oracle_sql()[name])
    assert note is None, note


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_stream_cusum_equals_batch(spark, sf):
    z = fx.ticks(spark, sf).selectExpr("symbol", "ts_ns", "(price - 50.0) / 50.0 AS z")
    batch = {(r.symbol, r.ts_ns): r.alarm for r in kernels.cusum_with_reset(z).collect()}
    stream = catalog_streams.QUERIES["stream_cusum"](spark, sf)
    assert {(r.symbol, r.ts_ns): r.alarm for r in stream.collect()} == batch


def test_online_ffd_uses_history(spark, tmp_path):
    w = series.fractional_weights(0.4, 1e-3, 4)
    rows = [("A", i, float(i * i)) for i in range(20)]
    spark.createDataFrame(rows[10:], "symbol string, ts_ns long, close double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("symbol string, ts_ns long, close double").parquet(str(tmp_path / "in"))
    q = ops.online_frac_diff(src, w, {"A": [r[2] for r in rows[:10]]}).writeStream.format("memory").queryName("ffd_out").start()
    q.processAllAvailable()
    q.stop()
    got = {r.ts_ns: r.ffd for r in spark.table("ffd_out").collect()}
    want = {t: sum(w[k] * rows[t - k][2] for k in range(len(w))) for t in range(10, 20)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["aligned_returns", "realised_vol", "triple_barrier", "fifo_matches", "markouts", "active_news_state", "sentiment_signals", "cv_roles", "label_concurrency"])
def test_plan_shapes(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for w in re.findall(r"Window \[.*", plan):
        assert "windowspecdefinition(" in w and not re.search(r"\], \[ts_ns#\d+L? ASC[^]]*\]$", w) or "_blk" in w or "symbol" in w
