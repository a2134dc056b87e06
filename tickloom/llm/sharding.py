"""Contiguous, balanced shards from prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import keep, text_of


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Deal all rows, in the order of doc_id, into ``n_shards`` runs of near-equal bytes.

    Rows are range-partitioned by (doc_id, crc, size); one total per partition gives each partition its global
    offset, a running sum inside the partition does the rest. A row goes to the shard that holds the middle of
    its bytes, so a cut is at most half a row off its target. Sizes are UTF-8 bytes plus 1; null text counts as
    empty, null doc_ids come first, equal rows follow one another in any order, an empty table gives no rows.

    Returns doc_id, size, text_crc32, shard (int), slot (long, gapless from 0 in each shard).
    """
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # The partition number must be the same for every reader, so the narrow table is written.
    ranged = keep(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("part", F.spark_partition_id()))
    # One row per partition: small enough for one task and for a broadcast, whatever the number of rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (twice_middle * {n_shards}) div (2 * total)) as int)"))
    )
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))



def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write the rows of each shard, in slot order inside a file, to the folder ``shard=k`` of ``path``.

    Rows meet their shard by doc_id and the checksum and size of the text; equal rows share one shard.
    """
    text = text_of()
    keys = [F.col("doc_id"), F.crc32(text.cast("binary")), (F.octet_length(text) + F.lit(1)).cast("long")]
    placed = assign_shards(docs, n_shards).groupBy("doc_id", "text_crc32", "size").agg(F.min(F.struct("shard", "slot")).alias("place"))
    placed = placed.select(F.struct(F.col("doc_id"), F.col("text_crc32"), F.col("size")).alias("_key"), "place.shard", "place.slot")
    keyed = docs.withColumn("_key", F.struct(*[k.alias(n) for k, n in zip(keys, ("doc_id", "text_crc32", "size"))]))
    out = keyed.join(placed, keyed["_key"].eqNullSafe(placed["_key"])).drop("_key")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
