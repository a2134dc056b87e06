"""Finite-state machines over ordered rows, as a scan over blocks without rounds.

A machine has a few states and a few signals; a signal maps each state to the next one. So a block of rows maps
each state before it to the state after it, a table of one entry per state, and tables compose: neighbours are
joined pairwise until the block has one. A key's tables compose in order, and each block then runs from its true
state. Marked transitions, such as entering a tier, are kept with their position, so the rows since the last one
need no further scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks


class Machine:
    """``step(state, signal)`` gives the next state and whether the transition is marked."""

    def __init__(self, states: int, signals: int, step: Callable[[int, int], tuple[int, bool]]):
        made = [[step(s, g) for s in range(states)] for g in range(signals)]
        self.go = np.array([[int(to) for to, _ in row] for row in made], np.int32)
        self.marked = np.array([[bool(m) for _, m in row] for row in made])

    def table(self, signals: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state before the rows: the state after them and the position of the last marked transition (0: none)."""
        to, mark = self.go[signals], np.where(self.marked[signals], seq[:, None], 0)
        while len(to) > 1:
            odd = len(to) % 2
            left, right = slice(0, len(to) - odd, 2), slice(1, None, 2)
            last = (to[-1:], mark[-1:]) if odd else (to[:0], mark[:0])
            marks = np.maximum(mark[left], np.take_along_axis(mark[right], to[left], 1))
            to = np.concatenate([np.take_along_axis(to[right], to[left], 1), last[0]])
            mark = np.concatenate([marks, last[1]])
        return to[0], mark[0]

    def run(self, signals: np.ndarray, seq: np.ndarray, state: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """State and position of the last marked transition after each row."""
        go, passed, before = self.go.tolist(), [], []
        for g in signals.tolist():
            before.append(state)
            state = go[g][state]
            passed.append(state)
        here = np.where(self.marked[signals, np.array(before, np.int64)], seq, 0)
        return np.array(passed, np.int64), np.maximum(np.maximum.accumulate(here), mark)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, signal: Column, start: int = 0, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Add ``seq``, ``state`` and ``mark_seq`` (position of the last marked transition, 0: none) to each row of (keys, order).

    Three passes whatever the number of blocks: tables, their composition per key (one row of a few numbers per
    ``block_rows`` rows), states. Null keys make up one key. Rows alike in all of ``order`` have no defined order.
    """
    seen = df.withColumn("_signal", signal.cast("int"))
    filled = [F.struct(F.col(k).isNull().alias("gone"), F.col(k).alias("value")).alias(f"_k_{k}") for k in keys]
    names = [f"_k_{k}" for k in keys]
    rows = blocks.index_rows(seen.select("*", *filled), names, list(order), blocks.Rows()).withColumn("_blk", F.expr(f"(seq - 1) div {block_rows}"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = rows.withColumn("_key", F.to_json(F.struct(*names))).drop(*names)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        to, mark = machine.table(pdf["_signal"].to_numpy(), pdf["seq"].to_numpy())
        return pdf[["_key", "_blk"]].iloc[:1].assign(to=[to.tolist()], mark=[mark.tolist()])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, mark, starts, marks = pdf.sort_values("_blk"), start, 0, [], []
        for to, last in zip(pdf["to"], pdf["mark"]):
            starts.append(state)
            marks.append(mark)
            state, mark = int(to[state]), max(mark, int(last[state]))
        return pdf[["_key", "_blk"]].assign(_start=starts, _mark=marks)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        state, mark = machine.run(pdf["_signal"].to_numpy(), pdf["seq"].to_numpy(), int(pdf["_start"].iloc[0]), int(pdf["_mark"].iloc[0]))
        return pdf.drop(columns=["_signal", "_key", "_blk", "_start", "_mark"]).assign(state=state, mark_seq=mark)

    tables = rows.select("_key", "_blk", "seq", "_signal").groupBy("_key", "_blk").applyInPandas(summarise, "_key string, _blk long, to array<int>, mark array<long>")
    starts = tables.groupBy("_key").applyInPandas(compose, "_key string, _blk long, _start long, _mark long")
    return rows.join(starts, ["_key", "_blk"]).groupBy("_key", "_blk").applyInPandas(finish, f"{kept}, seq long, state long, mark_seq long")
