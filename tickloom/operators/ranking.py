"""Population ranking: fitness, Pareto fronts, crowding, novelty, cohorts.

Objectives are maximised unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import blocks, stats
from tickloom.operators.blocks import Running
from tickloom.session import cut_lineage


def fitness(dsr: Column, mdd: Column, regret: Column, novelty: Column, psi: float = 2.0, w_regret: float = 0.3, w_novelty: float = 0.2) -> Column:
    """dsr·exp(-ψ·max(mdd,0)) - ω1·max(regret,0) + ω2·novelty."""
    zero = F.lit(0.0)
    return dsr * F.exp(-psi * F.greatest(mdd, zero)) - w_regret * F.greatest(regret, zero) + w_novelty * novelty


def _undominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Mask of rows of ``x`` that no row of ``by`` dominates; sliced to bound memory."""
    keep = np.ones(len(x), dtype=bool)
    for lo in range(0, len(by), 1024):
        b = by[lo:lo + 1024]
        live = np.flatnonzero(keep)
        for at in range(0, len(live), 1024):
            idx = live[at:at + 1024]
            ge = (b[None] >= x[idx][:, None]).all(axis=2)
            gt = (b[None] > x[idx][:, None]).any(axis=2)
            keep[idx] &= ~(ge & gt).any(axis=1)
    return keep


def pareto_front(population: DataFrame, objectives: Sequence[str], id_col: str = "id", block: int = 4096) -> DataFrame:
    """Rows that no other row dominates.

    Each partition first drops what its own rows dominate, batch by batch, which leaves a
    small share. The survivors are cut into blocks and every pair of blocks is compared in
    its own task of at most block² comparisons; a row stays when no block dominates it.
    """
    cols = list(objectives)
    slim = population.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)

    def local(batches):
        kept: pd.DataFrame | None = None
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf])
            x = kept[cols].to_numpy()
            kept = kept[_undominated(x, x)]
            if len(kept) > 4 * block:
                yield kept
                kept = None
        if kept is not None:
            yield kept

    survivors = cut_lineage(slim.mapInPandas(local, schema))
    n_blocks = max(1, -(-survivors.count() // block))
    placed = survivors.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    left = placed.withColumn("_o", others)
    right = placed.withColumnRenamed("_b", "_o").withColumn("_b", others)

    def judge(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        x = mine[cols].to_numpy()
        lost = ~_undominated(x, theirs[cols].to_numpy()) if len(theirs) else np.zeros(len(mine), dtype=bool)
        return mine.loc[lost, [id_col]]

    id_type = slim.schema[id_col].dataType.simpleString()
    beaten = left.groupBy("_b", "_o").cogroup(right.groupBy("_b", "_o")).applyInPandas(judge, f"`{id_col}` {id_type}")
    return population.join(survivors.select(id_col), id_col, "left_semi").join(beaten.distinct(), id_col, "left_anti")


def pareto_ranks(population: DataFrame, objectives: Sequence[str], id_col: str = "id") -> DataFrame:
    """1-based front number of every row, by peeling fronts.

    Each round is a distributed skyline; the rest is kept in the shared checkpoint folder.
    """
    slim = population.select(id_col, *objectives)
    rest, rank, ranked = cut_lineage(slim), 1, None
    while not rest.isEmpty():
        front = cut_lineage(pareto_front(rest, objectives, id_col).select(id_col).withColumn("rank", F.lit(rank).cast("long")))
        ranked = front if ranked is None else ranked.unionByName(front)
        rest = cut_lineage(rest.join(front, id_col, "left_anti"))
        rank += 1
    if ranked is None:
        return slim.withColumn("rank", F.lit(1).cast("long"))
    return population.join(ranked, id_col)


def crowding(ranked: DataFrame, objectives: Sequence[str], id_col: str = "id") -> DataFrame:
    """Crowding distance inside each front: infinite at the ends, neighbour gap over range else.

    Equal values stand in the order of their ids, so only the first and the last of them have a gap: a value
    with its count and these two ids is one row, and the values are put in order instead of the rows. Each
    block of values looks to its neighbours through their edge values.
    """
    long = ranked.select("rank", id_col, F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), F.col(o).cast("double").alias("v")) for o in objectives])).alias("_x"))
    key = ["rank", "objective"]
    values = cut_lineage(long.select("rank", id_col, "_x.*").groupBy(*key, "v").agg(
        F.min(id_col).alias("_first"), F.max(id_col).alias("_last"), F.count(F.lit(1)).alias("_n")))
    placed = cut_lineage(blocks.row_blocks(values, key, ["v"]))
    over = Window.partitionBy(*key).orderBy("_blk")
    whole = Window.partitionBy(*key)
    edges = placed.groupBy(*key, "_blk").agg(F.min(F.struct("v")).alias("_low"), F.max(F.struct("v")).alias("_high")).select(
        *key, "_blk", F.lag("_high").over(over).alias("_before"), F.lead("_low").over(over).alias("_after"),
        (F.max("_high.v").over(whole) - F.min("_low.v").over(whole)).alias("_width"))
    inside = Window.partitionBy(*key, "_blk").orderBy("v")
    near = placed.withColumns({"_a": F.lag(F.struct("v")).over(inside), "_z": F.lead(F.struct("v")).over(inside)}).join(edges, [*key, "_blk"])
    before, after = F.coalesce("_a", "_before"), F.coalesce("_z", "_after")

    def gap(lower: Column, upper: Column, end: Column) -> Column:
        return F.when(end, float("inf")).when(F.col("_width") <= 1e-8, 0.0).otherwise(F.try_divide(upper - lower, "_width"))

    first, last = before.isNull(), after.isNull()
    alone = F.array(F.struct(F.col("_first").alias(id_col), gap(before["v"], after["v"], first | last).alias("_part")))
    pair = F.array(F.struct(F.col("_first").alias(id_col), gap(before["v"], F.col("v"), first).alias("_part")),
                   F.struct(F.col("_last").alias(id_col), gap(F.col("v"), after["v"], last).alias("_part")))
    parts = near.select("rank", F.explode_outer(F.when(F.col("_n") == 1, alone).otherwise(pair)).alias("_x")).select("rank", "_x.*")
    return ranked.select("rank", id_col, F.lit(0.0).alias("_part")).unionByName(parts).groupBy("rank", id_col).agg(F.sum("_part").alias("crowding"))


def rank_population(population: DataFrame, id_col: str = "id") -> DataFrame:
    """Front and crowding of (dsr, mdd, regret, novelty) with the null defaults 0, 1, 0, 0."""
    filled = population.select(
        id_col, F.coalesce("dsr", F.lit(0.0)).alias("o1"), (-F.coalesce("mdd", F.lit(1.0))).alias("o2"),
        (-F.coalesce("regret", F.lit(0.0))).alias("o3"), F.coalesce("novelty", F.lit(0.0)).alias("o4"))
    objectives = ["o1", "o2", "o3", "o4"]
    ranked = cut_lineage(pareto_ranks(filled, objectives, id_col))
    return ranked.join(crowding(ranked, objectives, id_col), ["rank", id_col]).select(id_col, "rank", "crowding")


def _distance_sum(points: DataFrame, elites: DataFrame, col: str, scale: float, out: str, id_col: str) -> DataFrame:
    """Σ |x - e| over all elites, by running count and sum along the axis instead of a cross join."""
    both = points.select(id_col, F.col(col).alias("_x"), F.lit(1).alias("_k"), F.lit(0.0).alias("_e"), F.lit(0).alias("_one")).unionByName(
        elites.select(F.lit(None).cast(points.schema[id_col].dataType).alias(id_col), F.col(col).alias("_x"), F.lit(0).alias("_k"),
                      F.col(col).alias("_e"), F.lit(1).alias("_one"))).withColumn("_all", F.lit("a"))
    run = blocks.running(both, ["_all"], ["_x", "_k"], blocks.Rows(), {
        "_s": Running("sum", F.col("_e")), "_n": Running("sum", F.col("_one"))})
    j = run.filter("_k = 1").withColumns({"_ts": elites.agg(F.sum(col)).scalar(), "_tn": elites.agg(F.count(F.lit(1))).scalar()})
    x = F.col("_x")
    value = x * F.col("_n") - F.col("_s") + (F.col("_ts") - F.col("_s")) - x * (F.col("_tn") - F.col("_n"))
    return j.select(id_col, (value / scale / F.col("_tn")).alias(out))


def novelty_pick(aspirants: DataFrame, elites: DataFrame, scales: dict[str, float], id_col: str = "id") -> DataFrame:
    """The aspirant with the largest mean scaled distance to the elites; the lowest id on ties."""
    dist = None
    for i, (col, scale) in enumerate(scales.items()):
        d = _distance_sum(aspirants, elites, col, scale, f"_d{i}", id_col)
        dist = d if dist is None else dist.join(d, id_col)
    total = sum((F.col(f"_d{i}") for i in range(len(scales))), F.lit(0.0))
    return dist.select(id_col, total.alias("novelty")).orderBy(F.desc(F.round("novelty", 9)), id_col).limit(1)


def tolerant_front(candidates: DataFrame, returns: DataFrame, universe: Sequence[str], tau: float = 1.0,
                   eps_regret: float = 1e-4, eps_novelty: float = 1e-4) -> DataFrame:
    """Candidates not dominated when Sharpe differences within τ standard errors do not count.

    ``candidates`` has id, feasible, dsr and minimised objectives m0 (Sharpe), m1, m2; the
    standard error uses the return correlation of the pair.
    """
    pair = stats.both_ways(stats.pair_sums(returns, universe), {"s1": "s2", "s2": "s1", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((F.sqrt(F.greatest(vx, F.lit(0.0))) < 1e-12) | (F.sqrt(F.greatest(vy, F.lit(0.0))) < 1e-12), 0.0).otherwise(F.try_divide(cov, F.sqrt(vx * vy)))
    p = pair.filter("s1 <> s2").select("s1", "s2", "n", F.least(F.greatest(rho, F.lit(-0.9999)), F.lit(0.9999)).alias("rho"))
    side = lambda k: candidates.select(F.col("id").alias(f"s{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("feasible", "dsr", "m0", "m1", "m2")])
    j = p.join(side(1), "s1").join(side(2), "s2")
    var = (2.0 * (1.0 - F.col("rho")) + 0.5 * (F.pow("dsr_1", F.lit(2)) + F.pow("dsr_2", F.lit(2)) - 2.0 * F.col("rho") * F.col("rho") * F.col("dsr_1") * F.col("dsr_2"))) / n
    tol = tau * F.sqrt(F.greatest(var, F.lit(0.0)))
    a0, b0, a1, b1, a2, b2 = (F.col(c) for c in ("m0_1", "m0_2", "m1_1", "m1_2", "m2_1", "m2_2"))
    strict = (a1 < b1 - eps_regret) | (a2 < b2 - eps_novelty)
    within = (a1 <= b1 + 1e-9) & (a2 <= b2 + 1e-9) & (strict | (a0 < b0)) & (a0 <= b0 + tol) & (strict | (a0 < b0 - tol))
    beats = F.when(F.col("feasible_1") & ~F.col("feasible_2"), True).when(F.col("feasible_1") & F.col("feasible_2"), within).otherwise(False)
    lost = j.filter(beats).select(F.col("s2").alias("id")).distinct()
    return candidates.join(lost, "id", "left_anti")


def cohort_split(ranked: DataFrame, alpha: float = 0.2, id_col: str = "id") -> DataFrame:
    """Viable candidates as ALPHA or ASPIRANT.

    Front 1 is ALPHA; when it is short of ceil(α·n), the best scores (lowest) of front 2
    fill it up. If no candidate has a front (``rank`` null throughout), the highest ``dsr`` are ALPHA.
    Where that leaves no ASPIRANT, every candidate is in both cohorts. Ties go to the smaller id;
    without viable candidates there are no rows.
    """
    viable = ranked.filter(F.col("feasible") & (F.col("dsr") >= 0.5) & ~F.isnan("dsr")).withColumn("_all", F.lit("a"))
    fronts = ranked.agg(F.count("rank")).scalar() > 0
    room = viable.agg(F.greatest(F.lit(1), F.ceil(F.lit(alpha) * F.count(F.lit(1)))) - F.count(F.when(F.col("rank") == 1, 1))).scalar()
    spare = viable.filter((F.col("rank") == 2) | ~fronts).withColumn("_o", F.when(fronts, F.col("score")).otherwise(-F.col("dsr")))
    filled = blocks.index_rows(spare, ["_all"], ["_o", id_col], blocks.Rows(), out="_r")
    chosen = filled.filter(F.col("_r") <= room).select(id_col, F.lit(True).alias("_in"))
    first = F.coalesce(F.col("rank") == 1, F.lit(False))
    j = viable.join(chosen, id_col, "left").select(id_col, "rank", (first | F.coalesce("_in", F.lit(False))).alias("_top"))
    alone = j.agg(F.count(F.when(~F.col("_top"), 1))).scalar() == 0
    cohorts = F.when(alone, F.array(F.lit("ALPHA"), F.lit("ASPIRANT"))).otherwise(F.array(F.when(F.col("_top"), "ALPHA").otherwise("ASPIRANT")))
    return j.select(id_col, "rank", F.explode(cohorts).alias("cohort"))


def phenotype_distance(a: Column, b: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    """Root mean square difference of gene arrays scaled to their bounds and clipped to [0, 1]."""
    lows, spans = F.array(*[F.lit(float(lo)) for lo, _ in bounds]), F.array(*[F.lit(float(hi - lo)) for lo, hi in bounds])

    def scaled(x: Column) -> Column:
        shifted = F.zip_with(x, lows, lambda v, lo: v - lo)
        return F.zip_with(shifted, spans, lambda v, s: F.least(F.greatest(v / s, F.lit(0.0)), F.lit(1.0)))

    sq = F.zip_with(scaled(a), scaled(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / len(bounds))


def subspace_novelty(series: DataFrame, elites: DataFrame, energy: float = 0.99, max_rank: int = 50, viable: DataFrame | None = None) -> DataFrame:
    """1 - energy of each standardised series in the elites' leading right-singular basis.

    Both inputs are long (id, pos, value) with positions 0..T-1. Series outside ``viable`` (id), if
    given, and constant ones score 0; without elites every viable one scores 1. The basis is at most
    max_rank × T numbers; the elite rows stay distributed in the SVD.
    """
    from pyspark.mllib.linalg import Vectors as OldVectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    def standard(df: DataFrame) -> DataFrame:
        mu = df.groupBy("id").agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("_t"))
        dev = df.join(mu, "id").withColumn("_d", F.col("value") - F.col("_m"))
        norm = dev.groupBy("id").agg(F.sqrt(F.sum(F.col("_d") * F.col("_d"))).alias("_n"))
        return dev.join(norm, "id").filter("_n >= 1e-12").select("id", "pos", (F.col("_d") / F.col("_n")).alias("z"))

    rows = standard(elites).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda e: e["z"]).alias("v"))
    matrix = RowMatrix(rows.select("v").rdd.map(lambda r: OldVectors.dense(r[0])))
    ids = series.select("id").distinct()
    passed = F.lit(True)
    if viable is not None:
        ids = ids.join(viable.select("id").distinct().withColumn("_ok", F.lit(True)), "id", "left")
        passed = F.coalesce("_ok", F.lit(False))
    if rows.isEmpty():
        return ids.select("id", F.when(passed, 1.0).otherwise(0.0).alias("novelty"))
    limit = min(matrix.numRows(), matrix.numCols())
    svd = matrix.computeSVD(int(limit), computeU=False)
    share = np.cumsum(svd.s.toArray() ** 2) / np.sum(svd.s.toArray() ** 2)
    rank = min(int(np.searchsorted(share, energy)) + 1, max_rank, len(share))
    basis = svd.V.toArray()[:, :rank]
    cells = elites.sparkSession.createDataFrame(
        [(int(p), int(k), float(basis[p, k])) for p in range(basis.shape[0]) for k in range(rank)], "pos long, k long, w double")
    dots = standard(series).join(F.broadcast(cells), "pos").groupBy("id", "k").agg(F.sum(F.col("z") * F.col("w")).alias("c"))
    seen = dots.groupBy("id").agg(F.sum(F.col("c") * F.col("c")).alias("e"))
    score = F.least(F.greatest(1.0 - F.col("e"), F.lit(0.0)), F.lit(1.0))
    return ids.join(seen, "id", "left").select("id", F.when(passed, F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("novelty"))
