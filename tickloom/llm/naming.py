"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import ascii_lower, deal, keep, row_key, text_of


def name_values(rows: DataFrame) -> DataFrame:
    """Replace the binary column ``value`` by ``name``: equal values get one whole number, different values two.

    Rows are sorted over all partitions by (hash, value): range partitions are cut by (hash, row), so a value with
    very many rows spreads over several, and only the 16 bytes of a cut reach the driver. A partition numbers its
    runs of equal values. A value that may go on in the next partition, one with the first or last hash of its
    partition, is compared by content with the same few of the other partitions, and the smallest name wins. Equal
    names thus mean equal values, also where two hashes collide.
    """
    others = [f for f in rows.schema.fields if f.name != "value"]
    schema = T.StructType([*others, T.StructField("name", T.LongType()), T.StructField("edge", T.BinaryType())])
    ordered = rows.withColumn("_hash", F.xxhash64("value")).repartitionByRange("_hash", "row").sortWithinPartitions("_hash", "value", "row")

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        first, name, before, hash_before = TaskContext.get().partitionId() << 36, -1, None, None
        first_hash, waiting = None, None

        def out(batch, names, edges):
            columns = [batch.column(f.name) for f in others] + [pa.array(names, pa.int64()), edges]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in others] + ["name", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            value, hashes = batch.column("value"), batch.column("_hash").to_numpy()
            change = np.ones(len(value), bool)
            change[1:] = pa.compute.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)
            change[0] = before is None or value[0].as_py() != before
            names = first + name + np.cumsum(change)
            name, before = int(names[-1] - first), value[-1].as_py()
            if first_hash is None:
                first_hash = hashes[0]
            # What shares the last hash so far may be an edge; it waits for the next batch.
            if waiting is not None:
                old, old_names, old_change, old_hashes = waiting
                yield out(old, old_names, mark(old, old_change, old_hashes, {first_hash} | ({hashes[0]} if hashes[0] == old_hashes[-1] else set())))
            waiting = (batch, names, change, hashes)
        if waiting is not None:
            old, old_names, old_change, old_hashes = waiting
            yield out(old, old_names, mark(old, old_change, old_hashes, {first_hash, old_hashes[-1]}))

    def mark(batch, change, hashes, edge_hashes):
        import numpy as np
        import pyarrow as pa

        # One row of each run is enough.
        wanted = change & np.isin(hashes, list(edge_hashes))
        return pa.compute.if_else(pa.array(wanted), batch.column("value"), pa.scalar(None, batch.column("value").type)).cast(pa.binary())

    named = keep(ordered.mapInArrow(number, schema))
    edges = named.filter("edge is not null").select("edge", "name").distinct()
    # At most a few rows per partition, whatever the number of rows: a bounded broadcast.
    same = edges.withColumn("to", F.min("name").over(Window.partitionBy("edge"))).filter("to != name").select("name", "to")
    return named.drop("edge").join(F.broadcast(same), "name", "left").withColumn("name", F.coalesce("to", "name")).drop("to")


def identify(docs: DataFrame, extra: list, block: int = 4096) -> DataFrame:
    """One row per document: row, doc_id, text_sha256, what ``extra`` names, and its identity (level, name).

    A text (A-Z lower-cased) is cut into blocks of ``block`` bytes, and each block gets a name. Adjacent names are
    paired and the pairs named, level by level, until one name stands for the document. Only the first level
    shuffles text, once; the levels above see whole numbers of the documents that are longer than a block.
    """
    lowered = ascii_lower(text_of())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lowered.alias("t"), *extra)
    rows = rows.withColumn("sha", F.sha2("t", 256)).withColumn("b", F.col("t").cast("binary")).drop("t")
    n = F.greatest(F.lit(1), F.expr(f"cast((length(b) + {block - 1}) div {block} as int)"))
    rows = rows.withColumn("n", n).withColumn("parts", F.expr(f"transform(sequence(0, n - 1), i -> substring(b, i * {block} + 1, {block}))"))
    names = [c for c in rows.columns if c not in ("row", "n", "b", "parts")]
    blocks = rows.drop("b").select("row", "n", F.posexplode("parts").alias("pos", "value"), F.struct(*names).alias("doc"))
    # What belongs to the document travels with its first block.
    blocks = blocks.withColumn("doc", F.when(F.col("pos") == 0, F.col("doc")))
    level, named = 0, name_values(blocks)
    longest = named.agg(F.max("n")).first()[0]
    done = []
    while longest is not None:
        done.append(named.filter("n = 1").select("row", "doc", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        pairs = named.filter("n > 1").groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.expr("cast((max(n) + 1) div 2 as int)").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("r"),
            F.first("doc", ignorenulls=True).alias("doc"),
        )
        pair = F.concat_ws(":", F.col("l"), F.coalesce(F.col("r"), F.lit(-1))).cast("binary")
        named = name_values(pairs.select("row", "n", "pos", pair.alias("value"), "doc"))
        longest, level = -(-longest // 2), level + 1
    if not done:
        done.append(named.select("row", "doc", F.lit(0).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row", "level", "name", "doc.*")


def grouped(docs: DataFrame, extra: list, block: int) -> DataFrame:
    identified = keep(identify(docs, extra, block))
    groups = keep(identified.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")))
    # Both sides are stored tables, so a group with very many rows is a skewed partition that Spark can split.
    joined = identified.join(groups, ["level", "name"])
    return joined.withColumn("keep_id", F.col("top.doc_id")).withColumn("kept", F.col("row") == F.col("top.row"))


def exact_groups(docs: DataFrame, block: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id of
    a group stays; null doc_ids rank lowest, and of rows with one doc_id and one text a single one stays. An empty
    table gives no rows; other columns are not read. The input must give the same rows when a task is repeated.
    """
    return grouped(docs, [], block).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, block: int = 4096) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns."""
    found = grouped(docs, row_key(docs), block)
    return deal(docs, found.filter("kept").select("k1", "k2", F.lit(1).alias("copies")))
