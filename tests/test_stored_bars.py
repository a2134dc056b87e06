"""Stored bars, closed ranges of aligned returns, and the fallbacks of the cohort split."""

import pytest

from tickloom.operators import ranking, series
from tickloom.sources import bars as src

DAY = 86_400_000_000_000
BARS = "symbol string, resolution string, ts_ns long, close double, adj_close double, batch_seq long"


def bars(spark, rows, batch=1):
    return spark.createDataFrame([(s, r, t * DAY, float(p), float(p), batch) for s, r, t, p in rows], BARS)


def held(df):
    return sorted((r.symbol, r.resolution, r.ts_ns // DAY, r.close) for r in df.collect())


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [(s, r, t, 10 * t) for s in "AB" for r in ("1d", "1h") for t in (1, 29, 30, 61, 95)]
    src.write_bars(bars(spark, rows), path)
    files = lambda where: sorted(p.name for p in (tmp_path / "bars" / where).glob("*.parquet"))
    before = {w: files(w) for w in ("resolution=1d/slice=0", "resolution=1d/slice=1", "resolution=1h/slice=2")}
    src.upsert_bars(spark, path, bars(spark, [("A", "1d", 30, 7), ("A", "1d", 31, 8), ("C", "1w", 1, 9)], 2))
    src.upsert_bars(spark, path, bars(spark, [("A", "1d", 30, 5)], 1))  # older than what is stored
    want = {(s, r, t): 10.0 * t for s, r, t, _ in rows} | {("A", "1d", 30): 7.0, ("A", "1d", 31): 8.0, ("C", "1w", 1): 9.0}
    assert held(src.stored_bars(spark, path)) == sorted((*k, v) for k, v in want.items())
    after = {w: files(w) for w in before}
    assert [w for w in before if before[w] != after[w]] == ["resolution=1d/slice=1"]


def test_ranges_are_closed_and_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    src.write_bars(bars(spark, [("A", r, t, t) for r in ("1d", "1h") for t in range(1, 200)]), path)
    found = src.stored_bars(spark, path, "1h", 40 * DAY, 70 * DAY)
    assert [t for _, _, t, _ in held(found)] == list(range(40, 71))
    scan = next(line for line in found._jdf.queryExecution().toString().splitlines() if "FileScan parquet" in line and "PartitionFilters" in line)
    pruned = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "resolution" in pruned and "slice" in pruned
    read = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numPartitions").value()
    assert read == 2  # of 14 stored
    with pytest.raises(ValueError):
        src.stored_bars(spark, path, "1h", 2, 1)


def test_aligned_returns_of_a_range(spark):
    rows = [("A", "1d", t, 100 + t) for t in range(1, 6)] + [("A", "1h", t, 500) for t in range(1, 6)] + [("B", "1d", 1, 50), ("B", "1d", 4, 60)]
    b = bars(spark, rows)
    got = {(r.symbol, r.ts_ns // DAY): r.ret for r in series.aligned_returns(b, ["A", "B", "A"], resolution="1d", start_ns=2 * DAY, end_ns=4 * DAY).collect()}
    # B has no price in the range before day 4: the one of day 1 is not looked at
    assert got == pytest.approx({("A", 3): 103 / 102 - 1, ("A", 4): 104 / 103 - 1, ("B", 3): 0.0, ("B", 4): 0.0})
    assert series.aligned_returns(b, ["A"], resolution="1d", start_ns=9 * DAY).count() == 0
    for bad in ({"universe": []}, {"universe": [""]}, {"universe": ["A"], "field": "volume"}, {"universe": ["A"], "kind": "ratio"}, {"universe": ["A"], "start_ns": 2, "end_ns": 1}):
        with pytest.raises(ValueError):
            series.aligned_returns(b, **bad)


RANKED = "id long, rank long, dsr double, feasible boolean, score double"


def cohorts(spark, rows, alpha):
    found = ranking.cohort_split(spark.createDataFrame(rows, RANKED), alpha).collect()
    return {c: sorted(r.id for r in found if r.cohort == c) for c in ("ALPHA", "ASPIRANT")}


def test_cohorts_without_fronts_and_without_aspirants(spark):
    flat = [(i, None, 0.5 + i / 10, i != 3, None) for i in range(5)] + [(9, None, float("nan"), True, None)]
    assert cohorts(spark, flat, 0.4) == {"ALPHA": [2, 4], "ASPIRANT": [0, 1]}
    # ties by id; one candidate leads itself
    assert cohorts(spark, [(2, None, 0.9, True, None), (1, None, 0.9, True, None)], 0.5) == {"ALPHA": [1], "ASPIRANT": [2]}
    assert cohorts(spark, [(1, None, 0.9, True, None)], 0.2) == {"ALPHA": [1], "ASPIRANT": [1]}
    # all of front 1: everyone is in both cohorts
    assert cohorts(spark, [(i, 1, 0.9, True, 0.0) for i in range(3)], 0.2) == {"ALPHA": [0, 1, 2], "ASPIRANT": [0, 1, 2]}
    # a front of an infeasible candidate is a front all the same
    mixed = [(1, 1, 0.9, False, 0.0), (2, None, 0.8, True, 0.0), (3, 2, 0.7, True, 0.5), (4, 2, 0.7, True, 0.1)]
    assert cohorts(spark, mixed, 0.3) == {"ALPHA": [4], "ASPIRANT": [2, 3]}
    assert cohorts(spark, [(1, 1, 0.1, True, 0.0)], 0.2) == {"ALPHA": [], "ASPIRANT": []}
