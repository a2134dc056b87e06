"""Finite-state scans: any cut into blocks gives what one pass over the rows gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import kernels, machines

SHOCKS = "book string, ts_ns long, shock double, haircut double, panic boolean"


def plain(rows, dwell):
    """Tier, haircut and bars in the tier of each row of one book, one row after another."""
    tier, bars, out = 0, 0, []
    for _, _, shock, cut, panic in rows:
        want = 3 if panic or (shock or 0) >= 0.9 else 2 if (shock or 0) >= 0.7 else 1 if (shock or 0) >= 0.45 else 0
        down = want < tier and shock is not None and shock < 0.3 and (tier == 1 or bars >= dwell)
        tier, bars = (want, 1) if want > tier else (tier - 1, 1) if down else (tier, bars + 1)
        out.append((kernels.TIERS[tier], 0.0 if tier >= 2 else min(0.5, cut) if tier == 1 else cut, bars))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tables_compose_to_one_pass(seed):
    rng = np.random.default_rng(seed)
    states, signals = int(rng.integers(2, 9)), int(rng.integers(1, 6))
    go, marked = rng.integers(0, states, (signals, states)), rng.random((signals, states)) < 0.3
    machine = machines.Machine(states, signals, lambda s, g: (go[g][s], marked[g][s]))
    seen = rng.integers(0, signals, 200)
    want, state, mark = [], 0, 0
    for i, g in enumerate(seen, 1):
        mark, state = (i if marked[g][state] else mark), int(go[g][state])
        want.append((state, mark))
    at, state, mark = 0, 0, 0
    while at < len(seen):
        part = slice(at, min(len(seen), at + int(rng.integers(1, 30))))
        seq = np.arange(part.start + 1, part.stop + 1)
        got = machine.run(seen[part], seq, state, mark)
        assert list(zip(*[g.tolist() for g in got])) == want[part]
        to, last = machine.table(seen[part], seq)
        state, mark, at = int(to[state]), max(mark, int(last[state])), part.stop
        assert (state, mark) == want[at - 1]


def test_tiers_like_one_row_after_another(spark):
    rng, books = random.Random(5), {}
    for book in ("hot", "thin", None):
        books[book] = [(book, 10 * i, rng.choice((None, 0.1, 0.2, 0.29, 0.3, 0.45, 0.6, 0.7, 0.9, 1.0)), rng.random(), rng.random() < 0.05) for i in range(300 if book == "hot" else 9)]
    d = spark.createDataFrame([r for rows in books.values() for r in rows], SHOCKS)
    for size in (1, 7, 1000):
        got = {(r.book, r.ts_ns): (r.tier, r.execution_haircut, r.bars_in_tier) for r in kernels.tier_hysteresis(d, dwell=3, block_rows=size).collect()}
        assert len(got) == 318
        for book, rows in books.items():
            assert [got[book, r[1]] for r in rows] == plain(rows, 3), (book, size)


def test_empty_rows_nan_shocks_and_null_panic(spark):
    assert kernels.tier_hysteresis(spark.createDataFrame([], SHOCKS)).count() == 0
    rows = [("b", 1, 0.95, 0.8, None), ("b", 2, float("nan"), 0.8, None), ("b", 3, None, None, None)]
    got = kernels.tier_hysteresis(spark.createDataFrame(rows, SHOCKS), dwell=1).orderBy("ts_ns").collect()
    assert [(r.tier, r.bars_in_tier) for r in got] == [("HALT", 1), ("HALT", 2), ("HALT", 3)]


def test_number_of_passes_does_not_follow_the_blocks(spark):
    rows = spark.range(3000).select(F.lit("b").alias("book"), F.col("id").alias("ts_ns"), (F.pmod(F.col("id") * 37, F.lit(101)) / 100).alias("shock"), F.lit(0.7).alias("haircut"), F.lit(False).alias("panic"))
    found = {n: kernels.tier_hysteresis(rows, block_rows=n) for n in (13, 100_000)}
    plans = {n: f._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInPandas") for n, f in found.items()}
    assert plans[13] == plans[100_000]
    assert sorted(map(tuple, found[13].collect())) == sorted(map(tuple, found[100_000].collect()))
