"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session that names none gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-tickloom-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    It cuts the lineage like ``checkpoint()``, but the last stage runs once, the files are columnar, and later
    readers skip columns that they don't need. A lost executor costs no recompute.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def back(df: DataFrame, docs: DataFrame, name: str = "doc") -> DataFrame:
    """The columns of ``docs`` from the struct that :func:`whole_row` made."""
    return df.select(*[F.col(name).getField(c).alias(c) for c in docs.columns])


def field(docs: DataFrame, name: str, otherwise: T.DataType) -> T.DataType:
    """The type of a column of ``docs``."""
    return next((f.dataType for f in docs.schema.fields if f.name == name), otherwise)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as this Python worker."""
    import sys
    import types

    holder = sys.modules.setdefault("_tickloom_worker", types.ModuleType("_tickloom_worker"))
    return holder.__dict__.setdefault(name, {})


def row_key(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns: rows that agree in both are taken as the same row, repeated."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def deal(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``copies`` (k1, k2, copies: the sum for a row and its repeats) says.

    Texts are shuffled once, by their row's key. Of n equal rows with c copies, each gives c div n or one more.
    """
    keyed = docs.select(whole_row(docs).alias("doc"), *row_key(docs))
    totals = copies.groupBy("k1", "k2").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    same = Window.partitionBy("k1", "k2")
    joined = keyed.join(totals, ["k1", "k2"]).withColumn("n", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("k1")))
    own = F.expr("cast(copies div n + if(nth <= copies % n, 1, 0) as int)")
    dealt = joined.withColumn("own", own).filter("own > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("own"))))
    return back(dealt, docs)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``links`` (a, b) reaches. Only ids with a link are returned.

    Rounds of large-star and small-star, each a stored table of at most as many links as before, until nothing
    changes; their number grows with the logarithm of a component's width.
    """
    now = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen = state
        files = 1 + state.n // 100_000  # few links need few files
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large.filter("u != v").coalesce(files))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(low.withColumnRenamed("m", "v")).distinct().coalesce(files))
    ends = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = ends.select(F.col("component").alias("id"), "component").distinct()
    return keep(ends.unionByName(roots))
