"""Venue health: streaks of toxic fills and the quarantines they cause, as a scan over blocks without rounds.

A fill is toxic below a mark-out. ``limit`` toxic fills in a row trigger a quarantine of ``hold_ns``, which each further
toxic fill of the streak renews. The first fill at or after its end releases the venue and starts the streak anew.

After a trigger everything follows from that fill alone. So in a block of n fills, ``next`` links each possible
trigger to the one after it, and a block acts on the state before it (streak, end of quarantine) in one of few ways:
it triggers where the streak that came in is long enough, or it is released first, by whatever fill meets the end of
the quarantine that came in. Those answers are the block's summary; a key's summaries compose in order, and each block
then runs with its true state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks

#: In a summary: the time of a trigger that does not come.
NEVER = -(2**63)


class Fills:
    """A block of fills in order: times, whether toxic, and the links between possible triggers."""

    def __init__(self, times: np.ndarray, toxic: np.ndarray, limit: int, hold_ns: int):
        n = len(times)
        self.times, self.toxic, self.limit, self.hold, self.n = times, toxic, limit, hold_ns, n
        rows = np.arange(n)
        self.run = rows - np.maximum.accumulate(np.where(toxic, -1, rows))  # toxic fills in a row, of this block
        self.full = np.flatnonzero(self.run >= limit)
        self.free = np.searchsorted(times, times + hold_ns, "left").clip(rows + 1)  # the fill that ends a hold from here
        after, clean = rows + 1, self.fresh(rows + 2)
        eased = np.where(clean < self.free, clean, self.fresh(self.free))
        renewed = (after < self.free) & np.append(toxic[1:], False)
        self.next = np.where(after >= n, n, np.where(renewed, after, np.where(after >= self.free, self.fresh(after), eased)))
        # Whether the hold ends before the next trigger, and so where the streak starts anew.
        self.release = np.where(self.free <= np.minimum(self.next, n - 1), self.free, -1)
        self.final = np.empty(n, np.int64)
        for j in range(n - 1, -1, -1):
            self.final[j] = j if self.next[j] >= n else self.final[self.next[j]]

    def fresh(self, start):
        """The first trigger when the streak is zero before row ``start``; n if there is none."""
        at = np.searchsorted(self.full, np.asarray(start) + self.limit - 1, "left")
        return np.append(self.full, self.n)[at]

    def trigger(self, streak: int) -> int:
        """The first trigger after a streak that came in, if nothing releases before."""
        lead = int(np.argmin(self.toxic)) if not self.toxic.all() else self.n
        need = max(self.limit - streak, 1) - 1
        return need if need < lead else int(self.fresh(lead))

    def exit(self, first: int, released: int, streak: int, until: int) -> tuple[int, int]:
        """Streak and end of quarantine after the block; ``released`` is the row of a release before ``first``, or -1."""
        if first < self.n:
            # Releases after the first trigger: the last one on its path decides.
            last, until, j = int(self.final[first]), 0, first
            released = max(released, self.last_release(j))
            until = 0 if self.release[last] >= 0 else int(self.times[last]) + self.hold
        elif released >= 0:
            until = 0
        tail = int(self.run[-1])
        if released >= 0:
            return min(tail, self.n - released), until
        return tail + (streak if tail == self.n else 0), until

    def last_release(self, j: int) -> int:
        if not hasattr(self, "_last"):
            self._last = np.empty(self.n, np.int64)
            for k in range(self.n - 1, -1, -1):
                later = -1 if self.next[k] >= self.n else self._last[self.next[k]]
                self._last[k] = max(later, self.release[k])
        return int(self._last[j])

    def summary(self) -> dict:
        """What the block does to any state: see :func:`apply`."""
        by_streak = [self.trigger(s) for s in range(self.limit + 1)]
        outs = [self.exit(int(g), r, 0, 0) for r, g in enumerate(self.fresh(np.arange(self.n)))]
        ends = [r for r in range(self.n) if r + 1 == self.n or outs[r] != outs[r + 1]]
        return {
            "n": self.n, "tail": int(self.run[-1]), "trigger_ns": [int(self.times[f]) if f < self.n else NEVER for f in by_streak],
            "trigger_exit": [list(self.exit(f, -1, s, 0)) if f < self.n else [0, 0] for s, f in enumerate(by_streak)],
            "whole_exit": [self.last_release(f) < 0 if f < self.n else True for f in by_streak],
            "free_ns": [int(self.times[r]) for r in ends], "free_exit": [list(outs[r]) for r in ends],
        }

    def states(self, streak: int, until: int) -> tuple[np.ndarray, np.ndarray]:
        """(streak, end of quarantine or 0) after each fill, given the state before the block."""
        first = self.trigger(streak)
        opened = int(np.searchsorted(self.times, until, "left")) if until else self.n
        event = np.full(self.n, -1, np.int64)
        starts = np.full(self.n, -1, np.int64)  # rows of releases
        if opened <= min(first, self.n - 1):
            event[opened], starts[opened] = 0, opened
            first = int(self.fresh(opened))
        while first < self.n:
            event[first] = self.times[first] + self.hold
            r = self.release[first]
            first = int(self.next[first])
            if r >= 0:
                event[r], starts[r] = 0, r
        at = np.maximum.accumulate(np.where(event >= 0, np.arange(self.n), -1))
        held = np.where(at >= 0, event[at], until)
        since = np.maximum.accumulate(starts)
        count = np.minimum(self.run, np.arange(self.n) - np.maximum(since, 0) + 1)
        return count + np.where((since < 0) & (self.run == np.arange(self.n) + 1), streak, 0), held


def apply(block: dict, streak: int, until: int) -> tuple[int, int]:
    """The state after a block, from its summary and the state before it."""
    k = min(streak, len(block["trigger_ns"]) - 1)
    trigger = block["trigger_ns"][k]
    if until and until <= block["free_ns"][-1] and (trigger == NEVER or trigger >= until):
        return tuple(block["free_exit"][int(np.searchsorted(block["free_ns"], until, "left"))])
    whole = block["tail"] == block["n"]
    if trigger == NEVER:
        return block["tail"] + (streak if whole else 0), until
    count, end = block["trigger_exit"][k]
    return count + (streak - k if whole and block["whole_exit"][k] else 0), end


SUMMARY = "n long, tail long, trigger_ns array<long>, trigger_exit array<array<long>>, whole_exit array<boolean>, free_ns array<long>, free_exit array<array<long>>"


def quarantines(marked: DataFrame, order: Sequence[str], threshold: float = -2.0, limit: int = 3, hold_ns: int = 60_000_000_000, block_rows: int = 1 << 16) -> DataFrame:
    """(venue, ``order``, markout_bps, streak, quarantined, until_ns) after each fill with a mark-out.

    Three passes whatever the number of blocks: summaries, their composition per venue (one row a block), states.
    """
    base = marked.select("venue", "ts_ns", *[c for c in order if c != "ts_ns"], "markout_bps").filter(F.col("markout_bps").isNotNull())
    rows = blocks.index_rows(base, ["venue"], list(order), blocks.Rows()).withColumn("_blk", F.expr(f"(seq - 1) div {block_rows}"))
    venue = f"venue {base.schema['venue'].dataType.simpleString()}"
    shown = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)

    def fills(pdf: pd.DataFrame) -> Fills:
        return Fills(pdf["ts_ns"].to_numpy(), pdf["markout_bps"].to_numpy() < threshold, limit, hold_ns)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        made = fills(pdf.sort_values("seq")).summary()
        return pdf[["venue", "_blk"]].iloc[:1].assign(**{k: [v] for k, v in made.items()})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, starts = pdf.sort_values("_blk"), (0, 0), []
        for block in pdf.to_dict("records"):
            starts.append(state)
            state = tuple(map(int, apply(block, *state)))
        return pdf[["venue", "_blk"]].assign(_streak=[s for s, _ in starts], _until=[u for _, u in starts])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        streak, until = fills(pdf).states(int(pdf["_streak"].iloc[0]), int(pdf["_until"].iloc[0]))
        return pdf.drop(columns=["seq", "_blk", "_streak", "_until"]).assign(streak=streak, quarantined=until > 0, until_ns=until)

    made = rows.groupBy("venue", "_blk").applyInPandas(summarise, f"{venue}, _blk long, {SUMMARY}")
    starts = made.groupBy("venue").applyInPandas(compose, f"{venue}, _blk long, _streak long, _until long")
    return rows.join(starts, ["venue", "_blk"]).groupBy("venue", "_blk").applyInPandas(finish, f"{shown}, streak long, quarantined boolean, until_ns long")
