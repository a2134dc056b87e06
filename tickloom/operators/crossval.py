"""Combinatorial purged cross-validation over a sample table (sample_id, start, end)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import blocks


@dataclass(frozen=True)
class Folds:
    groups: int = 6
    test_groups: int = 2
    embargo_pct: float = 0.01
    embargo_bars: float | None = None
    max_splits: int | None = None
    min_train_ratio: float = 0.2
    forward: bool = False

    def test_sets(self) -> list[tuple[int, ...]]:
        """Test groups of every split; a cap keeps evenly strided splits."""
        if self.forward:
            sets = [tuple(range(s, s + self.test_groups)) for s in range(1, self.groups - self.test_groups + 1)]
        else:
            sets = list(combinations(range(self.groups), self.test_groups))
        if self.max_splits is not None and len(sets) > self.max_splits:
            top, m = len(sets) - 1, self.max_splits
            at = [round(i * top / (m - 1)) if m > 1 else 0 for i in range(m)]
            sets = [sets[i] for i in at]
        return sets


def assign_groups(samples: DataFrame, order: str, k: int, block: Column) -> DataFrame:
    """Contiguous groups 0..k-1; the first n mod k groups hold one sample more.

    The closed form over the row position replaces ``ntile``, which would sort every
    sample in one task.
    """
    keyed = samples.withColumn("_all", F.lit(0))
    seq = blocks.index_rows(keyed, ["_all"], [order], block)
    total = samples.agg(F.count(F.lit(1))).scalar()
    big = F.expr(f"(_n % {k}) * (_n div {k} + 1)")
    group = F.when(F.expr("seq - 1") < big, F.expr(f"(seq - 1) div (_n div {k} + 1)")).otherwise(
        F.expr(f"(_n % {k}) + (seq - 1 - (_n % {k}) * (_n div {k} + 1)) div (_n div {k})"))
    return seq.withColumn("_n", total).withColumn("grp", group.cast("long")).drop("_all", "_n")


def roles(grouped: DataFrame, folds: Folds) -> DataFrame:
    """Role of every sample in every split: test, train, purged, embargoed or unused.

    Input has sample_id, start, end, seq and grp. A split carries its few test intervals
    as an array (bounded by the number of groups), so purge and embargo are array tests on
    each (sample, split) row and the samples are not shuffled.
    """
    spark = grouped.sparkSession
    sets = folds.test_sets()
    spans = grouped.groupBy("grp").agg(
        F.min_by("start", "seq").alias("t0"), F.max_by("end", "seq").alias("t1"))
    length = grouped.agg((F.max_by("end", "seq") - F.min_by("start", "seq")).cast("double")).scalar()
    tests = spark.createDataFrame(
        [(i, g, min(s)) for i, s in enumerate(sets) for g in s], "split_id long, grp long, first_grp long")
    intervals = tests.join(spans, "grp").groupBy("split_id").agg(
        F.collect_list(F.struct("grp", "t0", "t1")).alias("iv"), F.first("first_grp").alias("first_grp"))
    embargo = F.lit(float(folds.embargo_bars)) if folds.embargo_bars is not None else length * folds.embargo_pct
    # one row per split: its size is bounded by the fold settings, not by the samples
    side = intervals.withColumn("emb", embargo)
    pairs = grouped.withColumn("split_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(sets) - 1).cast("long"))))
    joined = pairs.join(F.broadcast(side), "split_id")
    in_test = F.exists("iv", lambda t: t["grp"] == F.col("grp"))
    overlaps = F.exists("iv", lambda t: (F.col("start") <= t["t1"]) & (F.col("end") >= t["t0"]))
    held = F.exists("iv", lambda t: (F.col("start") > t["t1"]) & (F.col("start") <= t["t1"] + F.col("emb")))
    role = F.when(in_test, "test")
    if folds.forward:
        role = role.when(F.col("grp") > F.col("first_grp"), "unused")
    role = role.when(overlaps, "purged").when(held, "embargoed").otherwise("train")
    return joined.withColumn("role", role).select("split_id", "sample_id", "grp", "role")


def split_report(assigned: DataFrame, folds: Folds) -> DataFrame:
    """Samples per role and split, and whether the train share stays above the minimum."""
    n = F.count(F.lit(1))
    train = F.count(F.when(F.col("role") == "train", 1))
    return assigned.groupBy("split_id").agg(
        *[F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("train", "test", "purged", "embargoed")],
        (train / n >= folds.min_train_ratio).alias("enough_train"))


def path_predictions(predictions: DataFrame, folds: Folds) -> DataFrame:
    """Path id of each fold prediction (split_id, grp, sample_id, pred).

    A group's k-th split, in split order, belongs to path k; the mapping depends on the
    fold settings only and is broadcast.
    """
    if folds.forward:
        raise ValueError("paths need the full combinatorial splits")
    seen: dict[int, int] = {}
    rows = []
    for i, s in enumerate(folds.test_sets()):
        for g in s:
            rows.append((i, g, seen.get(g, 0)))
            seen[g] = seen.get(g, 0) + 1
    if len(seen) < folds.groups:
        raise ValueError("a group is in no test set")
    usable = min(seen.values())
    table = predictions.sparkSession.createDataFrame([r for r in rows if r[2] < usable], "split_id long, grp long, path_id long")
    return predictions.join(F.broadcast(table), ["split_id", "grp"])


def path_sharpes(paths: DataFrame, periods: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """Annualised Sharpe ratio (sample deviation) of pred·ret per path."""
    x = F.col("pred") * F.col("ret") - risk_free / periods
    sd = F.stddev_samp(x)
    return paths.groupBy("path_id").agg(F.when(sd > 1e-12, F.avg(x) / sd * periods ** 0.5).otherwise(0.0).alias("sharpe"))


def sharpe_distribution(sharpes: DataFrame) -> DataFrame:
    return sharpes.agg(
        F.count(F.lit(1)).alias("paths"), F.avg("sharpe").alias("mean_sharpe"),
        F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("var_sharpe"))
