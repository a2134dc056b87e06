"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import WORD, deal, field, keep, row_key, text_of


def source_targets(rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, source_rows, target.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all sizes; no target
    exceeds ``most`` times its source's size, and what is cut off is shared by weight among the rest. That is one
    level L for which min(cap, L * weight) adds up to the total; with the caps sorted by cap / weight, it follows
    from running sums. The table has one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", turn).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    levels = (
        caps.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("open", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("try", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("nth", F.row_number().over(order))
        .withColumn("level", F.min(F.when(F.col("try") <= F.col("cap") / F.col("w"), F.struct("nth", "try"))).over(everything)["try"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    return levels.select("source", "source_size", "source_rows", target.alias("target"))


def settle(items: list[list], random) -> list | None:
    """Round the chances of ``items`` ([..., size, copies, chance]) in order; at most one stays open and is returned.

    The open item meets the next one. Words move from one to the other until one of the two chances is 0 or 1,
    each way with the probability that leaves both expectations as they are; the expected words of the pair never
    change. With the items sorted by falling size, the one that stays open is a small one.
    """
    held = None
    for item in items:
        if not 0 < item[-1] < 1:
            continue
        if held is None:
            held = item
            continue
        (s, p), (t, q) = (held[-3], held[-1]), (item[-3], item[-1])
        up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
        if random.random() * (up + down) < down:
            p, q, full = p + up / s, q - up / t, s * (1 - p) <= t * q
            p, q = (1.0, q) if full else (p, 0.0)
        else:
            p, q, full = p - down / s, q + down / t, s * p <= t * (1 - q)
            p, q = (0.0, q) if full else (p, 1.0)
        held[-1], item[-1] = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        still = [x for x in (held, item) if 0 < x[-1] < 1]
        held = still[0] if still else None
    return held


def mix_rows(rows: DataFrame, weights: Sequence[int], share: float, most: float, leaf_rows: int, fan_in: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size, k1, k2) with source_size, target and the number of copies."""
    rows = keep(rows)
    sources = keep(source_targets(rows, weights, share, most).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    sources = sources.withColumnRenamed("source", "s")
    leaves = F.expr(f"(source_rows + {leaf_rows - 1}) div {leaf_rows}")
    chance = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    spread = (
        rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k1"), leaves))
        .withColumn("copies", F.floor(chance).cast("int"))
        .withColumn("chance", chance - F.floor(chance))
    )
    names = ["doc_id", "k1", "k2", "source_no", "leaf", "source_size", "target", "size", "copies", "chance"]
    kinds = [field(rows, "doc_id", T.LongType()), *[T.LongType()] * 2, T.IntegerType(), *[T.LongType()] * 2, T.DoubleType(), T.LongType(), T.IntegerType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def round_group(level: int, last: bool):
        def go(key, got):
            import random

            import pyarrow as pa

            chosen = random.Random(f"{seed}:{level}:{key[0].as_py()}:{key[1].as_py()}")
            items = [list(r.values()) for r in got.to_pylist()]
            items.sort(key=lambda r: (-r[7], r[0] is not None, r[0], r[1], r[2]))
            for r in items:  # without words there is nothing to move
                if r[7] == 0:
                    r[9] = float(chosen.random() < r[9])
            held = settle(items, chosen)
            if held and last:
                held[9] = float(chosen.random() < held[9])
            for r in items:
                if r[9] in (0.0, 1.0):
                    r[8], r[9] = r[8] + int(r[9]), None
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*items), got.schema)], schema=got.schema)

        return go

    count = sources.agg(F.max(leaves)).first()[0]
    level, left, done = 0, spread.select(*names), []
    while count is not None:
        level, last = level + 1, count == 1
        after = keep(left.groupBy("source_no", "leaf").applyInArrow(round_group(level, last), schema))
        done.append(after.filter("chance is null"))
        if last:
            break
        count = -(-count // fan_in)
        left = after.filter("chance is not null").withColumn("leaf", F.expr(f"leaf div {fan_in}"))
    out = done[0] if done else left
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, leaf_rows: int = 1000, fan_in: int = 64, seed: int = 17) -> DataFrame:
    """How many copies of each document the mix holds: doc_id, size, source_size, target, copies, taken.

    A document's chance is its source's target over its source's size; the whole part is that many copies, the
    rest is rounded. Documents of a source are dealt by hash into leaves of about ``leaf_rows`` rows; a leaf rounds
    all but one, and the rest meet ``fan_in`` leaves at a time until one per source is left, which is drawn. So the
    words taken from a source differ from its target by less than one, usually small, document. Draws depend on
    ``seed`` and the rows alone. ``most`` may be at most a whole number of copies.

    Null text has size 0, null source is a source; repeated rows are rounded each; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), *row_key(docs))
    mixed = mix_rows(rows, weights, share, most, leaf_rows, fan_in, seed)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, leaf_rows: int = 1000, fan_in: int = 64, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it."""
    rows = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), *row_key(docs))
    mixed = mix_rows(rows, weights, share, most, leaf_rows, fan_in, seed)
    return deal(docs, mixed.select("k1", "k2", "copies"))
