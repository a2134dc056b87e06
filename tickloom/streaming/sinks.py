"""Stream sinks: idempotent keyed tables and the late-row side output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tickloom.session import cut_lineage
from tickloom.sources.bars import upsert


def upsert_sink(path: str, keys: list[str], buckets: int = 16, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps one row per key; a replayed batch changes nothing.

    The last write wins: of the rows of one key a later batch beats an earlier one, and inside a
    batch the largest by ``order``, then by the whole row, so that a replay picks the same one.
    Rows are stored by key bucket and only buckets a batch touches are rewritten; a table needs
    about one bucket per million keys.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        rank = F.struct(*[F.col(c) for c in [*(order or []), *rest]] or [F.lit(0)])
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), rank).alias("_row"))
        last = last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        inc = last.withColumns({"batch_seq": F.lit(batch_id).cast("long"), "bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets))})
        try:
            old = spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            merged = inc
        else:
            old = old.join(inc.select("bucket").distinct(), "bucket", "left_semi").select(*inc.columns)
            merged = upsert(old, inc, keys)
        cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def slice_sink(path: str, row_group: int = 4 << 20) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for rows that a stream hands out once: each batch has its own folder, which it
    overwrites when it runs again. Small row groups bound what a reader decodes of wide rows at a time."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("parquet.block.size", row_group).parquet(f"{path}/batch={batch_id}")

    return write


def late_split_sink(on_time: Callable[[DataFrame, int], None], late_path: str, lateness_s: float, skew_s: float = 60.0) -> Callable[[DataFrame, int], None]:
    """Pass rows in time on; append rows too old or from the future to ``late_path``.

    Rows carry ts_ns and arrival_ns. A batch that runs again overwrites its own slice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        age = (F.col("arrival_ns") - F.col("ts_ns")) / 1e9
        marked = batch.withColumn("late_reason", F.when(age > lateness_s, "LATE").when(age < -skew_s, "FUTURE"))
        marked.filter("late_reason IS NOT NULL").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        on_time(marked.filter("late_reason IS NULL").drop("late_reason"), batch_id)

    return write


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all available input and stop."""
    (stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
