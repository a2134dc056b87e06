"""A dataset manifest: a content-addressed Merkle DAG, and proofs by descent from its root."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, keep, shared_dir

#: Children of a node; a task builds three levels at once, so it holds at most FAN ** 3 digests of one run.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """``leaves`` (tree, size, rank, leaf, and what the caller added), ``records`` (height, digest, children),
    ``trees`` (tree, size, depth, subroot, rank), ``root`` (None for an empty table)."""

    leaves: DataFrame
    records: DataFrame
    trees: DataFrame
    root: str | None


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The digest of a row of documents whose text is ``text``."""
    return F.sha2(F.concat(*[encoded(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def depth_of(size: str) -> str:
    """SQL for the number of levels above ``size`` leaves."""
    powers = ", ".join(f"{FAN**k}L" for k in range(21))
    return f"size(filter(array({powers}), p -> p < {size}))"


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in their ``tree`` by ``order``, from 0, and that tree's ``size``.

    Rows are range-partitioned and sorted once; each partition's stretch of a tree gets its offset from a sum over
    partitions. A tie number splits rows that are equal in ``order``, so no key has to fit one partition.
    """
    keys = ["tree", *order]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys)
    # Written once, so the positions are the same for every reader.
    placed = keep(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    same = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "tree", (before - F.col("_from")).alias("_shift"), F.sum("_n").over(same).alias("size"))
    return placed.join(runs, ["_part", "tree"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def grow(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (tree, size, rank, digest): the records (height, digest, children) and the roots (tree, digest).

    A round takes runs of FAN ** 3 nodes and builds up to three levels over each in one row. A tree leaves the
    rounds with one node, so their number is a third of the deepest tree's depth.
    """
    roots, records, height = nodes.filter("size = 1").select("tree", "digest"), None, 0
    level = nodes.filter("size > 1").select("tree", F.col("size").alias("width"), F.col("rank").alias("at"), "digest")
    runs = lambda of: f"transform(sequence(1, size({of}), {FAN}), i -> slice({of}, i, {FAN}))"
    hashed = lambda of: f"transform({of}, x -> sha2(array_join(x, ''), 256))"
    listed = lambda h, of, names: f"transform(arrays_zip({names}, {of}), x -> struct({h} as height, x.{names} as digest, x.{of} as children))"
    while True:
        width = FAN**3
        rows = level.groupBy("tree", "width", F.expr(f"at div {width}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("nodes"))
        rows = rows.withColumn("d0", F.expr("transform(nodes, x -> x.digest)")).drop("nodes")
        for k in (1, 2, 3):
            # Levels above a tree's single node are not built: their lists stay empty.
            rows = rows.withColumn(f"c{k}", F.expr(f"if(width > {FAN ** (k - 1)}, {runs(f'd{k - 1}')}, slice(array(array('')), 1, 0))"))
            rows = rows.withColumn(f"d{k}", F.expr(hashed(f"c{k}")))
        made = F.expr(f"concat({listed(height + 1, 'c1', 'd1')}, {listed(height + 2, 'c2', 'd2')}, {listed(height + 3, 'c3', 'd3')})")
        top = F.expr("case when size(d3) > 0 then d3[0] when size(d2) > 0 then d2[0] else d1[0] end")
        built = keep(rows.select("tree", "width", "at", top.alias("digest"), made.alias("made")))
        own = built.select(F.explode("made").alias("x")).select("x.*")
        records = own if records is None else records.unionByName(own)
        roots = roots.unionByName(built.filter(f"width <= {width}").select("tree", "digest"))
        level = built.filter(f"width > {width}").select("tree", F.expr(f"(width + {width - 1}) div {width}").alias("width"), "at", "digest")
        height += 3
        if level.isEmpty():
            return records, roots


def store(records: DataFrame) -> DataFrame:
    """The records, one for each digest, as a stored table with a folder per height."""
    path = f"{shared_dir(records.sparkSession)}/records-{uuid.uuid4().hex}"
    unique = records.groupBy("height", "digest").agg(F.first("children").alias("children"))
    unique.write.option("compression", "zstd").partitionBy("height").parquet(path)
    return records.sparkSession.read.schema(unique.schema).parquet(path)


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of ``leaves`` (tree, leaf, more): per tree by ``order``, then the trees by name."""
    ranked = keep(numbered(leaves, order))
    records, roots = grow(ranked.select("tree", "size", "rank", F.col("leaf").alias("digest")))
    roots = roots.join(ranked.select("tree", "size").distinct(), "tree")
    trees = keep(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("size").alias("leaves")), ["name"]))
    above, root = grow(trees.select("tree", "size", "rank", "digest"))
    first = root.first()
    named = trees.select(F.col("name").alias("tree"), F.col("leaves").alias("size"), F.expr(depth_of("leaves")).alias("depth"), F.col("digest").alias("subroot"), "rank", F.col("size").alias("of"))
    return Manifest(ranked, store(records.unionByName(above)), named, first and first["digest"])


def descend(starts: DataFrame, requests: DataFrame, records: DataFrame) -> DataFrame:
    """``requests`` (tree, rank, more) with ``digest`` (what was reached), ``path`` and what the start of their tree added.

    ``starts`` (tree, depth, digest, path, more) holds a root per tree. Requests go down by the digits of their rank
    in base FAN: at each height the different prefixes are looked up by digest, the digit's child is entered, and its
    siblings join the path as one segment (left, right), so that a node is opened once for all requests under it.
    """
    deepest = starts.agg(F.max("depth")).first()[0] or 0
    more = [c for c in starts.columns if c not in ("tree", "depth", "digest", "path")]
    prefixes = {0: requests}
    for h in range(1, deepest):
        prefixes[h] = keep(prefixes[h - 1].select("tree", F.expr(f"rank div {FAN}").alias("rank")).distinct())
    at_start = lambda h: starts.filter(F.col("depth") == h).withColumn("rank", F.lit(0).cast("long")).drop("depth")
    state = at_start(deepest)
    for h in range(deepest, 0, -1):
        opened = state.join(records.filter(F.col("height") == h).drop("height"), "digest").drop("digest").withColumnRenamed("rank", "parent")
        asked = prefixes[h - 1].withColumn("parent", F.expr(f"rank div {FAN}")).withColumn("digit", F.expr(f"cast(rank % {FAN} as int)"))
        left, right = F.expr("array_join(slice(children, 1, digit), '')"), F.expr(f"array_join(slice(children, digit + 2, {FAN}), '')")
        state = asked.join(opened, ["tree", "parent"]).withColumn("path", F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right")))))
        state = state.withColumn("digest", F.expr("children[digit]")).drop("children", "digit", "parent")
        # Trees that are no deeper than this height join in; single leaves at the very end.
        joining = at_start(h - 1)
        if h == 1:
            joining = requests.join(joining.drop("rank"), "tree")
        state = state.unionByName(joining.select(*state.columns))
    return state if deepest else requests.join(starts.drop("depth"), "tree").select(*requests.columns, "digest", "path", *more)


def proofs(made: Manifest) -> DataFrame:
    """The manifest's leaves with ``subroot`` and ``path``: segments (left, right) of sibling digests, leaf to root."""
    none = F.expr("slice(array(struct('' as left, '' as right)), 1, 0)")
    top = made.trees.agg(F.max("of").alias("of")).select(F.lit("").alias("tree"), F.expr(depth_of("of")).alias("depth"), F.lit(made.root).cast("string").alias("digest"), none.alias("path"))
    asked = made.trees.select(F.lit("").alias("tree"), "rank", F.col("tree").alias("name"), "depth")
    found = keep(descend(top, asked, made.records))
    starts = found.select(F.col("name").alias("tree"), "depth", "digest", "path", F.col("digest").alias("subroot"))
    return descend(starts, made.leaves.drop("size"), made.records).withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the sibling segments of ``path`` lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of a row's five fields; per lang, leaves ascend by doc_id and runs of eight become their
    parent until one node, the subroot, remains; the subroots by lang give the root in the same way. The proof is
    the digest of all siblings from leaf to root. Texts of rows whose crc32(doc_id) three divides are lower-cased
    (A-Z) before the fold, so their root differs if that changes the text.

    Null langs come first as a tree of their own, null doc_ids first in their tree and never altered; rows that
    share a doc_id are ordered by leaf, repeated rows have equal leaves at neighbouring ranks; null and empty texts
    differ; an empty table gives no rows. Other columns are not read.
    """
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        "doc_id",
        leaf_digest(F.col("text")).alias("leaf"),
        F.when(altered, leaf_digest(ascii_lower(F.col("text")))).alias("changed"),
    )
    made = build(rows, ["doc_id", "leaf"])
    root = F.lit(made.root).cast("string")
    found = proofs(made)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
