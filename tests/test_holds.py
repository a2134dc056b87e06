"""Streaks and quarantines: any cut into blocks gives what one pass over the fills gives."""

import random

import numpy as np
import pytest

from tickloom.operators import holds


def plain(fills, limit, hold):
    """One fill after another: (streak, end of quarantine) after each."""
    out, streak, until = [], 0, 0
    for now, toxic in fills:
        if until and now >= until:
            streak = until = 0
        streak = streak + 1 if toxic else 0
        if streak >= limit:
            until = max(until, now + hold)
        out.append((streak, until))
    return out


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_blocks_compose_to_one_pass(limit):
    rng = random.Random(limit)
    for _ in range(400):
        n, now, fills = rng.randrange(1, 40), 1, []
        for _ in range(n):
            now += rng.choice((0, 1, 1, 2, 9))
            fills.append((now, rng.random() < rng.choice((0.5, 0.8))))
        hold = rng.choice((0, 1, 3, 6, 20))
        want, got, state, k = plain(fills, limit, hold), [], (0, 0), 0
        while k < n:
            part = fills[k : k + rng.randrange(1, 9)]
            block = holds.Fills(np.array([t for t, _ in part]), np.array([x for _, x in part]), limit, hold)
            streak, until = block.states(*state)
            got += list(zip(streak.tolist(), until.tolist()))
            state = tuple(map(int, holds.apply(block.summary(), *state)))
            k += len(part)
            assert state == got[-1], (fills, limit, hold)
        assert got == want, (fills, limit, hold)


def test_quarantine_golden(spark):
    sec = 1_000_000_000
    marks = [-5.0, -5.0, -5.0, -5.0, 1.0, -5.0]
    rows = [("V", i * 10 * sec, i, m) for i, m in enumerate(marks)] + [("V", 500 * sec, 6, -5.0)]
    m = spark.createDataFrame(rows, "venue string, ts_ns long, event_id long, markout_bps double")
    for block_rows in (1, 2, 10_000):
        got = [(r.streak, r.quarantined) for r in holds.quarantines(m, ["ts_ns", "event_id"], block_rows=block_rows).orderBy("ts_ns").collect()]
        assert got == [(1, False), (2, False), (3, True), (4, True), (0, True), (1, True), (1, False)]
    assert holds.quarantines(m.limit(0), ["ts_ns", "event_id"]).count() == 0


def test_number_of_jobs_does_not_follow_the_blocks(spark):
    rng = random.Random(1)
    rows = [(f"v{i % 2}", 10 * i, i, rng.choice((-5.0, -5.0, 1.0))) for i in range(600)]
    m = spark.createDataFrame(rows, "venue string, ts_ns long, event_id long, markout_bps double")
    found = {n: sorted(map(tuple, holds.quarantines(m, ["ts_ns", "event_id"], hold_ns=35, block_rows=n).collect())) for n in (7, 1000)}
    assert found[7] == found[1000]
    plans = [holds.quarantines(m, ["ts_ns", "event_id"], block_rows=n)._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInPandas") for n in (7, 1000)]
    assert plans == [3, 3] or plans[0] == plans[1]
