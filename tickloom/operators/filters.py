"""Fractional filters of any length: FFT convolution on blocks of rows, and the inverse by a reciprocal series.

The look-back is a key's own: a share of its rows, cut where weights fall under a threshold. A key is dealt into blocks
of ``block_rows`` rows, so a key with very many rows is many tasks; what a block passes on is as long as the look-back,
never its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import fractional_weights, sequenced


def lookbacks(rows: DataFrame, longest: int, ratio: float = 0.2, least: int = 10) -> DataFrame:
    """(symbol, lookback): ``ratio`` of the key's rows, ``least`` at least, ``longest`` at most."""
    share = F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * F.lit(ratio)))
    return rows.groupBy("symbol").agg(F.least(F.lit(longest), share).cast("int").alias("lookback"))


def weights_for(raw: list[float]) -> Callable[[int], np.ndarray]:
    """The weights up to a look-back, the first one replaced so that all sum to zero."""
    made: dict[int, np.ndarray] = {}

    def get(lookback: int) -> np.ndarray:
        if lookback not in made:
            head = -math.fsum(raw[1 : lookback + 1]) if lookback else raw[0]
            made[lookback] = np.array([head, *raw[1 : lookback + 1]])
        return made[lookback]

    return get


def convolve(x: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` values of the convolution of two finite sequences."""
    width = 1 << max(len(x) + len(w) - 2, 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(x, width) * np.fft.rfft(w, width), width)[:size]
    return np.pad(out, (0, max(0, size - len(out))))


def reciprocal(w: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` coefficients of 1 / w as a power series: each Newton step doubles the right ones."""
    g = np.array([1.0 / w[0]])
    while len(g) < size:
        n = min(size, 2 * len(g))
        rest = -convolve(w[:n], g, n)
        rest[0] += 2.0
        g = convolve(g, rest, n)
    return g


def frac_diff(bars: DataFrame, d: float, threshold: float = 1e-4, ratio: float = 0.2, price: str = "close", pad: bool = False, block_rows: int = 1 << 16) -> DataFrame:
    """(symbol, ts_ns, seq, lookback, ffd): each row's fractional difference over its key's whole look-back.

    Blocks hold the ``lookback`` rows before them, so convolutions of neighbouring blocks don't meet. Rows without a
    full window are dropped, or null with ``pad``; a key with too few rows gives none.
    """
    raw = fractional_weights(d, threshold, None, False)
    weights, size = weights_for(raw), max(block_rows, len(raw))
    rows = sequenced(bars).select("symbol", "ts_ns", F.col("seq").cast("long").alias("seq"), F.col(price).cast("double").alias("_x"))
    rows = rows.join(lookbacks(bars, len(raw) - 1, ratio), "symbol").withColumn("_home", F.expr(f"(seq - 1) div {size}"))
    reach = F.expr(f"(seq - 1) % {size} >= {size} - lookback")
    spread = rows.withColumn("_at", F.explode(F.when(reach, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        back = int(pdf["lookback"].iloc[0])
        w, x = weights(back), pdf["_x"].to_numpy(dtype=float)
        # The weights sum to zero, so a level changes nothing but the rounding.
        y = convolve(x - x.mean() if back else x, w, len(x))
        pdf = pdf.assign(ffd=np.where(pdf["seq"].to_numpy() > back, y, np.nan))
        own = pdf[pdf["_home"] == pdf["_at"]]
        return own[["symbol", "ts_ns", "seq", "lookback", "ffd"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"symbol {kinds['symbol']}, ts_ns {kinds['ts_ns']}, seq long, lookback int, ffd double"
    out = spread.groupBy("symbol", "_at").applyInPandas(run, schema)
    full = F.col("seq") > F.col("lookback")
    return out.withColumn("ffd", F.when(full, F.col("ffd"))) if pad else out.filter(full)


def inverse_frac_diff(differences: DataFrame, anchors: DataFrame, d: float, threshold: float = 1e-4, block_rows: int = 1 << 16) -> DataFrame:
    """(symbol, ts_ns, value): the series that has these ``differences`` (symbol, ts_ns, ffd) after its ``anchors``.

    ``anchors`` (symbol, lookback, anchor: at least the ``lookback`` values before the first difference, oldest first).
    A block's values are its differences, less what the look-back before it contributes, convolved with 1 / w. So
    each block first answers to nothing before it and sends its last values; these compose in order, one row of
    ``lookback`` numbers a block, since all blocks of a length have the same answer to a look-back; then every block
    runs with its true look-back.
    """
    weights, series = weights_for(fractional_weights(d, threshold, None, False)), {}

    def answer(back: int, n: int) -> np.ndarray:
        if len(series.get(back, ())) < n:
            series[back] = reciprocal(weights(back), 1 << max(n - 1, 1).bit_length())
        return series[back][:n]

    def owed(before: np.ndarray, n: int) -> np.ndarray:
        """What a look-back takes off the first differences after it."""
        back = len(before)
        return np.zeros(0) if not back else -convolve(before, weights(back), 2 * back)[back:][:n]

    def last(before: np.ndarray, values: np.ndarray) -> np.ndarray:
        back = len(before)
        return np.concatenate([before, values[max(0, len(values) - back) :]])[-back:] if back else before

    rows = sequenced(differences).select("symbol", "ts_ns", "seq", "ffd").join(anchors.select("symbol", "lookback"), "symbol")
    rows = rows.withColumn("_blk", F.expr(f"(seq - 1) div {block_rows}"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = f"symbol {kinds['symbol']}, _blk long"

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("seq")["ffd"].to_numpy(dtype=float)
        back = int(pdf["lookback"].iloc[0])
        values = convolve(x, answer(back, len(x)), len(x))
        return pdf[["symbol", "_blk"]].iloc[:1].assign(_n=len(x), _tail=[last(np.zeros(back), values).tolist()])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = pdf.sort_values("_blk"), []
        back = int(pdf["lookback"].iloc[0])
        before = np.array(pdf["anchor"].iloc[0], dtype=float)[len(pdf["anchor"].iloc[0]) - back :]
        for n, tail in zip(pdf["_n"], pdf["_tail"]):
            starts.append(before.tolist())
            echo = convolve(owed(before, n), answer(back, n), n) if back else np.zeros(n)
            before = last(before, echo) + np.array(tail, dtype=float)
        return pdf[["symbol", "_blk"]].assign(_start=starts)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, before = pdf["ffd"].to_numpy(dtype=float).copy(), np.array(pdf["_start"].iloc[0], dtype=float)
        off = owed(before, len(x))
        x[: len(off)] += off
        return pdf[["symbol", "ts_ns"]].assign(value=convolve(x, answer(len(before), len(x)), len(x)))

    tails = rows.groupBy("symbol", "_blk").applyInPandas(alone, f"{head}, _n long, _tail array<double>")
    starts = tails.join(anchors.select("symbol", "lookback", "anchor"), "symbol").groupBy("symbol").applyInPandas(compose, f"{head}, _start array<double>")
    return rows.join(starts, ["symbol", "_blk"]).groupBy("symbol", "_blk").applyInPandas(finish, f"symbol {kinds['symbol']}, ts_ns {kinds['ts_ns']}, value double")
