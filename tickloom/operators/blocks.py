"""Ordered computations over a key without putting a whole key in one task.

A plain ``Window.partitionBy(symbol)`` sends every row of a symbol to one task. The
helpers here cut each symbol into blocks first, so a symbol that holds a third of the
table is spread over as many tasks as it has blocks:

* ``index_rows``  global row position from per-block counts;
* ``rolling``     bounded frames, each block carries the rows its frames reach into;
* ``running``     unbounded frames, each block adds what earlier blocks contributed;
* ``linear_scan`` states that each row changes linearly: one map per block, composed;
* ``relay``       other path-dependent kernels, blocks exchange their exit state.

Blocks derive from row values (time, quantity, position), never from task placement, so
a recomputed task yields the same rows. Where values may pile up, ``Rows`` bounds blocks by
rows instead: ``row_blocks`` cuts each key at the quantiles of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import cut_lineage

BLOCK_ROWS = 65_536
DAY_NS = 86_400_000_000_000


def time_block(ts_ns: str | Column, span_ns: int = 7 * DAY_NS) -> Column:
    """Block number of a nanosecond timestamp; floors for negative values too."""
    col = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.floor((col - F.pmod(col, F.lit(span_ns))) / F.lit(span_ns)).cast("long")


@dataclass(frozen=True)
class Rows:
    """In place of a block column: cut each key along the order into blocks of at most ``limit`` rows (``BLOCK_ROWS``)."""

    limit: int | None = None


#: Quantiles read from one sketch, the ranks they stand at, and the size of the sketch (a rank is off by some 0.1 %).
PARTS = 256
SKETCH = 2048


def _axis(df: DataFrame, name: str) -> Column:
    """A long or double that rises with the column; of strings, only the first seven bytes count."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return col.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.substring(F.encode(col, "UTF-8"), 1, 7), 7, F.lit(bytes(1)))
        return F.conv(F.hex(head), 16, 10).cast("long")
    return col.cast("long")


def _cuts(staged: DataFrame, group: Sequence[str], axes: Sequence[str], limit: int) -> DataFrame:
    """For each group of over ``limit`` rows: where to cut (``_s``) the first axis that varies in it, and its hot values (``_h``)."""
    ranks = f"array({', '.join(f'{i / PARTS}D' for i in range(1, PARTS))})"
    kinds = {a: "bigint" if isinstance(staged.schema[a].dataType, T.LongType) else "double" for a in axes}
    sketches = []
    for a in axes:
        usable = F.when(~F.isnan(a), F.col(a)) if kinds[a] == "double" else F.col(a)
        sketches += [F.min(a).alias(f"_lo{a}"), F.max(a).alias(f"_hi{a}"), F.count(a).alias(f"_n{a}"), F.count(usable).alias(f"_k{a}"),
                     F.call_function(f"kll_sketch_agg_{kinds[a]}", usable, F.lit(SKETCH)).alias(f"_q{a}")]
    big = staged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *sketches).filter(F.col("_n") > limit)
    step = F.greatest(F.lit(1), F.floor(F.lit(PARTS) / F.ceil(2.0 * F.col("_n") / limit))).cast("int")
    seen, read = F.lit(False), {}
    for a in axes:
        varies = (F.col(f"_k{a}") > 0) & ((F.col(f"_lo{a}") < F.col(f"_hi{a}")) | (F.col(f"_n{a}") < F.col("_n")))
        read[f"_s{a}"] = F.when(~seen & varies, F.expr(f"kll_sketch_get_quantile_{kinds[a]}(_q{a}, {ranks})"))
        seen = seen | varies

    def thinned(a: str) -> Column:
        return F.transform(F.sequence(step, F.lit(PARTS - 1), step), lambda i: F.element_at(f"_s{a}", i))

    def repeated(a: str) -> Column:
        return F.array_distinct(F.filter(f"_s{a}", lambda v, i: (i > 0) & (F.get(f"_s{a}", i - 1) == v)))

    cut = big.filter(seen).withColumns(read).withColumns({f"_s{a}": thinned(a) for a in axes})
    cut = cut.withColumns({f"_h{a}": repeated(a) for a in axes}).withColumns({f"_s{a}": F.array_distinct(f"_s{a}") for a in axes})
    return cut.select(*group, *[f"_{k}{a}" for a in axes for k in "sh"])


def row_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Add ``_blk``, which rises along ``order`` within each key and holds at most ``limit`` rows of it.

    A mergeable quantile sketch per key, built map-side, gives the cuts; only keys of over ``limit`` rows
    get any, so their table has a few numbers per ``limit`` rows and Spark picks the join by its measured
    size. A value that fills several quantiles becomes a block of its own. Blocks still too large are cut
    again, a block of one value by the next column of ``order``, until all fit. Cuts are written to the
    checkpoint folder, so a recomputed task meets the same ones. What is left over ``limit`` are rows alike in
    all of ``order`` (strings: in their first seven bytes). Runs one small job per level: one where nothing is
    over the limit, mostly two otherwise.
    """
    limit = BLOCK_ROWS if limit is None else limit
    axes = [f"_o{i}" for i in range(len(order))]
    staged = df.withColumns({a: _axis(df, c) for a, c in zip(axes, order)})
    # zero, but not a literal, which the optimiser would drop from the partitioning
    staged = staged.withColumn("_blk", F.pmod(F.xxhash64(axes[0]), F.lit(1)).cast("long"))
    group = [*keys, "_blk"]
    halves = F.array(*[F.lit(PARTS >> i) for i in range(1, PARTS.bit_length())])

    def part(a: str) -> Column:
        below = F.aggregate(halves, F.lit(0), lambda at, h: F.when(F.get(f"_s{a}", at + h - 1) <= F.col(a), at + h).otherwise(at))
        return 2 * below - F.coalesce(F.array_contains(f"_h{a}", F.col(a)), F.lit(False)).cast("int")

    while True:
        cuts = cut_lineage(_cuts(staged, group, axes, limit))
        if cuts.isEmpty():
            return staged.drop(*axes)
        cuts = cuts.withColumnsRenamed({c: f"_g{c}" for c in group})
        # null keys are keys too
        joined = staged.join(cuts, [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in group], "left")
        staged = joined.withColumn("_blk", F.col("_blk") * (2 * PARTS) + sum((part(a) for a in axes), F.lit(0))).select(*staged.columns)


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column | Rows,
    out: str = "seq",
) -> DataFrame:
    """Add the 1-based position of each row within its key.

    ``block`` must not decrease along ``order``. Only block counts meet in one place;
    rows are numbered inside their block and shifted by the rows before it.
    """
    blocked = _placed(df, keys, block, order)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _per_block(
        blocked, keys, [F.count(F.lit(1)).alias("_n")],
        {"_off": F.coalesce(F.sum("_n").over(before), F.lit(0))},
    ).drop("_n")
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        blocked.join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.row_number().over(inside) + F.col("_off")).cast("long"))
        .drop("_blk", "_off")
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable | Sequence[Callable],
    back: int = 0,
    ahead: int = 0,
    seq: str = "seq",
    block_rows: int = BLOCK_ROWS,
    where: Column | None = None,
) -> DataFrame:
    """Add frame columns that reach at most ``back`` rows behind and ``ahead`` rows on.

    ``build(frame)`` gets a factory ``frame(lo, hi)`` for row frames and returns the new
    columns. A list of builders runs in turn on the same shuffle; ``back`` and ``ahead``
    then cover their sum. Rows near a block edge are copied to the neighbour that needs them, so each
    row is shuffled once plus the edge share (back + ahead) / block_rows. ``where`` is
    applied to the result, after the frames.
    """
    size = max(block_rows, back, ahead, 1)
    at = F.col(seq) - 1
    home = F.expr(f"({seq} - 1) div {size}")
    pos = at % F.lit(size)
    targets = F.array(home)
    if back:
        targets = F.concat(targets, F.when(pos >= size - back, F.array(home + 1)).otherwise(F.array().cast("array<bigint>")))
    if ahead:
        targets = F.concat(targets, F.when(pos < ahead, F.array(home - 1)).otherwise(F.array().cast("array<bigint>")))
    spread = df.withColumn("_home", home).withColumn("_at", F.explode(targets))

    def frame(lo: int, hi: int):
        return Window.partitionBy(*keys, "_at").orderBy(seq).rowsBetween(lo, hi)

    for step in [build] if callable(build) else build:
        spread = spread.withColumns(step(frame))
    out = spread.filter(F.col("_at") == F.col("_home"))
    if where is not None:
        out = out.filter(where)
    return out.drop("_at", "_home")


def _placed(df: DataFrame, keys: Sequence[str], block: Column | Rows, order: Sequence[str | Column]) -> DataFrame:
    """Rows with their block number, shuffled once by (key, block)."""
    staged = row_blocks(df, keys, order, block.limit) if isinstance(block, Rows) else df.withColumn("_blk", block)
    return staged.repartition(*[F.col(k) for k in keys], F.col("_blk"))


def _per_block(placed: DataFrame, keys: Sequence[str], partials: list[Column], carries: dict[str, Column]) -> DataFrame:
    """One row per block over the same shuffle as the rows.

    The row fingerprint makes this branch need every column, so both branches have one
    identical exchange and Spark runs it once; without it nested scans would recompute
    their input twice per level.
    """
    plain = [f.name for f in placed.schema if not f.dataType.simpleString().startswith("map")]
    mark = F.max(F.xxhash64(*plain)).alias("_mark")
    totals = placed.groupBy(*keys, "_blk").agg(mark, *partials)
    return totals.withColumns(carries).filter(F.col("_mark").isNotNull()).drop("_mark")


def _shift(kind: str, carry: Column, local: Column) -> Column:
    """A block-local running value moved by what earlier blocks contributed."""
    if kind.startswith("product"):
        return local * F.coalesce(carry, F.lit(1.0))
    return local + F.coalesce(carry, F.lit(0.0))


@dataclass(frozen=True)
class Running:
    """One unbounded-preceding column.

    ``kind`` is sum, max, min, count, product, last or first; or sum_min, sum_max or
    product_max, which also give the extreme of the running value so far as
    ``<name>_ext`` in the same pass (product_max needs positive factors).
    """

    kind: str
    value: Column
    inclusive: bool = True


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "product": F.product}
_NESTED = {"sum_min": (F.sum, F.min), "sum_max": (F.sum, F.max), "product_max": (F.product, F.max)}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | Rows,
    columns: dict[str, Running],
) -> DataFrame:
    """Add running columns over everything before (and at) each row.

    Block totals are carried across blocks in a window over one row per block, joined
    back on (key, block) and finished inside the block. Totals, join and row window use
    the same partitioning, so rows are shuffled once. ``last``/``first``
    skip nulls.
    """
    staged = _placed(df.withColumns({f"_v_{n}": c.value for n, c in columns.items()}), keys, block, order)
    pos = F.struct(*order)
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nested = {f"_l_{n}": _NESTED[c.kind][0](f"_v_{n}").over(inside) for n, c in columns.items() if c.kind in _NESTED}
    if nested:
        staged = staged.withColumns(nested)
    partials, carries = [], {}
    ahead = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for name, c in columns.items():
        v = F.col(f"_v_{name}")
        if c.kind == "last":
            partials.append(F.max_by(v, F.when(v.isNotNull(), pos)).alias(f"_p_{name}"))
            carries[f"_c_{name}"] = F.last(f"_p_{name}", ignorenulls=True).over(ahead)
        elif c.kind == "first":
            partials.append(F.min_by(v, F.when(v.isNotNull(), pos)).alias(f"_p_{name}"))
            carries[f"_c_{name}"] = F.first(f"_p_{name}", ignorenulls=True).over(ahead)
        elif c.kind in _NESTED:
            fold, extreme = _NESTED[c.kind]
            partials += [fold(v).alias(f"_p_{name}"), extreme(f"_l_{name}").alias(f"_q_{name}")]
            carries[f"_c_{name}"] = fold(f"_p_{name}").over(ahead)
        elif c.kind == "count":
            partials.append(F.count(v).alias(f"_p_{name}"))
            carries[f"_c_{name}"] = F.sum(f"_p_{name}").over(ahead)
        else:
            partials.append(_FOLD[c.kind](v).alias(f"_p_{name}"))
            carries[f"_c_{name}"] = _FOLD[c.kind](f"_p_{name}").over(ahead)
    carried = _per_block(staged, keys, partials, carries)
    for name, c in columns.items():
        if c.kind in _NESTED:
            shifted = _shift(c.kind, F.col(f"_c_{name}"), F.col(f"_q_{name}"))
            carried = carried.withColumn(f"_d_{name}", _NESTED[c.kind][1](shifted).over(ahead)).drop(f"_q_{name}")
    carried = carried.drop(*[f"_p_{n}" for n in columns])
    base = Window.partitionBy(*keys, "_blk").orderBy(*order)
    upto = inside
    below = base.rowsBetween(Window.unboundedPreceding, -1)
    finals: dict[str, Column] = {}
    for name, c in columns.items():
        w = upto if c.inclusive else below
        v, carry = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if c.kind == "last":
            finals[name] = F.coalesce(F.last(v, ignorenulls=True).over(w), carry)
        elif c.kind == "first":
            finals[name] = F.coalesce(carry, F.first(v, ignorenulls=True).over(w))
        elif c.kind in _NESTED:
            extreme, pick = _NESTED[c.kind][1], F.greatest if c.kind.endswith("max") else F.least
            finals[name] = _shift(c.kind, carry, F.col(f"_l_{name}"))
            local = _shift(c.kind, carry, extreme(f"_l_{name}").over(upto))
            finals[f"{name}_ext"] = F.coalesce(pick(local, F.col(f"_d_{name}")), local)
        elif c.kind == "count":
            finals[name] = F.coalesce(carry, F.lit(0)) + F.count(v).over(w)
        else:
            here = _FOLD[c.kind](v).over(w)
            if c.kind == "sum":
                both = here + carry
            elif c.kind == "product":
                both = here * carry
            elif c.kind == "max":
                both = F.greatest(here, carry)
            else:
                both = F.least(here, carry)
            finals[name] = F.coalesce(both, here, carry)
    drop = [f"_{k}_{n}" for n in columns for k in "vcld"]
    return staged.join(carried, [*keys, "_blk"]).withColumns(finals).drop("_blk", *drop)


def relay(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    kernel: Callable[[pd.DataFrame, list[float] | None], tuple[pd.DataFrame, list[float]]],
    out_schema: str,
    tolerance: float = 0.0,
) -> DataFrame:
    """Run a path-dependent kernel block by block, in parallel, to the exact result.

    ``kernel(rows, state)`` takes one block in order and the state at its start (``None``
    at the start of a key) and returns its output rows and the state at its end, a list
    of floats. Every block first runs from the initial state. Then each block whose true
    start state differs from the assumed one runs again, until none differs. Kernels that
    reset or forget settle after two or three rounds however many blocks a key has; block
    k is right after k rounds in any case. Between rounds only one small row per block is
    kept, in the shared checkpoint folder.
    """
    staged = cut_lineage(df.withColumn("_blk", block))
    group = [*keys, "_blk"]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema if f.name in group)
    by_order = list(order)

    def start_of(pdf: pd.DataFrame) -> list[float] | None:
        value = pdf["_start"].iloc[0]
        return None if value is None else [float(x) for x in value]

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        start = start_of(pdf)
        _, end = kernel(pdf.sort_values(by_order, kind="stable").drop(columns=["_start"]), start)
        head = pdf[group].iloc[:1].copy()
        head["_start"] = [start]
        head["_end"] = [[float(x) for x in end]]
        return head

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _ = kernel(pdf.sort_values(by_order, kind="stable").drop(columns=["_start"]), start_of(pdf))
        return rows

    probe_schema = f"{key_schema}, _start array<double>, _end array<double>"
    prior = Window.partitionBy(*keys).orderBy("_blk")
    first = staged.withColumn("_start", F.lit(None).cast("array<double>"))
    states = cut_lineage(first.groupBy(*group).applyInPandas(probe, probe_schema))
    while True:
        due = states.withColumn("_want", F.lag("_end").over(prior))
        moved = F.when(F.col("_want").isNull() | F.col("_start").isNull(),
                       F.col("_want").isNotNull() | F.col("_start").isNotNull()).otherwise(
            (F.size("_want") != F.size("_start"))
            | F.exists(F.arrays_zip("_want", "_start"),
                       lambda p: ~p["_want"].eqNullSafe(p["_start"]) & ~(
                           F.abs(p["_want"] - p["_start"]) <= F.lit(tolerance) * F.greatest(F.abs(p["_want"]), F.lit(1.0)))))
        stale = due.filter(moved).select(*group, F.col("_want").alias("_start"))
        if stale.isEmpty():
            break
        redone = staged.join(stale, group).groupBy(*group).applyInPandas(probe, probe_schema)
        kept = states.join(stale.select(*group), group, "left_anti")
        states = cut_lineage(kept.unionByName(redone))
    settled = states.select(*group, "_start")
    return staged.join(settled, group).groupBy(*group).applyInPandas(emit, out_schema)


def linear_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    advance: Callable[[pd.DataFrame, np.ndarray, bool], np.ndarray],
    start: Callable[[pd.DataFrame], np.ndarray],
    emit: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    out_schema: str,
    projective: bool = False,
) -> DataFrame:
    """Run a kernel whose state each row changes by an affine map, in three passes and no loop.

    ``advance(rows, states, forced)`` moves the columns of ``states`` over a block; unforced, it
    leaves out what doesn't depend on the state. Its images of the unit vectors and of zero are the
    block's map. The maps of a key, one small row per block, are composed in order, and ``emit(rows,
    state)`` then runs on every block with its true start. ``start(rows)`` gives a key's first state;
    ``projective`` states count up to a factor.
    """
    staged = df.withColumn("_blk", block)
    group = [*keys, "_blk"]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema if f.name in group)
    by_order = list(order)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by_order, kind="stable")
        first = np.asarray(start(pdf), dtype=float)
        size = len(first)
        moved = advance(pdf, np.eye(size), False)
        shift = np.zeros(size) if projective else advance(pdf, np.zeros((size, 1)), True)[:, 0]
        head = pdf[group].iloc[:1].copy()
        head["_map"], head["_shift"], head["_first"] = [moved.ravel().tolist()], [shift.tolist()], [first.tolist()]
        return head

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        state, starts = np.array(pdf["_first"].iloc[0], dtype=float), []
        for m, b in zip(pdf["_map"], pdf["_shift"]):
            starts.append(state.tolist())
            state = np.array(m, dtype=float).reshape(len(state), -1) @ state + np.array(b, dtype=float)
            if projective:
                state = state / np.abs(state).max()
        return pdf[group].assign(_start=starts)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by_order, kind="stable")
        return emit(pdf.drop(columns=["_start"]), np.array(pdf["_start"].iloc[0], dtype=float))

    maps = staged.groupBy(*group).applyInPandas(summarise, f"{key_schema}, _map array<double>, _shift array<double>, _first array<double>")
    starts = maps.groupBy(*keys).applyInPandas(compose, f"{key_schema}, _start array<double>")
    return staged.join(starts, group).groupBy(*group).applyInPandas(finish, out_schema)
