"""Near duplicates by bottom-k sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import components, deal, field, keep, row_key, text_of

#: Retained hashes per set: those of the inverted lists, and those that decide between members of a crowd.
RETAINED, WIDE = 32, 512
#: Members of a crowd in one of the two blocks that a task compares, and forests of possible links it writes at first.
BLOCK, FORESTS = 512, 4


def least_shared(k: int, percent: int) -> int:
    """How many of the least ``k`` hashes of a union two sets of enough similarity share: six deviations below the mean."""
    p = percent / 100
    return max(1, int(k * p - 6 * (k * p * (1 - p)) ** 0.5))


def shingle_hashes(text: str, words_each: int):
    """The sorted distinct 64-bit hashes of the shingles of a text (A-Z lower-cased)."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < words_each:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    distinct = dict.fromkeys(words)
    distinct = dict(zip(distinct, map(xxhash.xxh3_64_intdigest, distinct)))
    ids = np.fromiter(map(distinct.__getitem__, words), np.uint64, len(words))
    m = len(words) - words_each + 1
    mixed = np.zeros(m, np.uint64)
    for k in range(words_each):
        mixed = (mixed ^ ids[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def sketch(docs: DataFrame, extra: list, words_each: int) -> DataFrame:
    """One row per document: doc_id, mark, what ``extra`` names, n, same (a fingerprint of the whole set), retained (long[])."""
    rows = docs.select(text_of().alias("text"), F.struct("doc_id", F.xxhash64("text").alias("mark"), *extra).alias("doc"))
    schema = T.StructType([rows.schema["doc"], T.StructField("n", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("retained", T.ArrayType(T.LongType()))])

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, same, kept = [], [], []
            for value in batch.column(0):
                hashes = shingle_hashes(value.as_py(), words_each)
                n.append(len(hashes))
                same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                kept.append(hashes[:RETAINED].view(np.int64))
            ends = np.cumsum([0] + [len(k) for k in kept])
            values = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc", "n", "same", "retained"])

    return rows.mapInArrow(run, schema).select("doc.*", "n", "same", "retained")


def alike(x, y, n_x: int, n_y: int, percent: int, k: int = RETAINED) -> bool:
    """Whether two sketches (sorted as unsigned) allow a similarity of ``percent``; exact when both hold whole sets."""
    import numpy as np

    if 100 * min(n_x, n_y) < percent * max(n_x, n_y):
        return False
    common = np.intersect1d(x, y, assume_unique=True)
    if n_x <= k and n_y <= k:
        return 100 * len(common) >= percent * (n_x + n_y - len(common))
    union = np.union1d(x, y)[:k]
    return int((common <= union[-1]).sum()) >= least_shared(k, percent)


def estimate(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch allows ``percent``."""
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("retained").alias(f"r_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            sets = [[v.values.to_numpy().view(np.uint64) for v in batch.column(c)] for c in ("r_a", "r_b")]
            mask = pa.array([alike(x, y, p, q, percent) for x, y, p, q in zip(*sets, n_a, n_b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(mask)

    return joined.mapInArrow(run, "a long, b long")


def rest_of_lists(index: DataFrame, lists: DataFrame, sets: DataFrame, found: DataFrame, rejected: DataFrame, percent: int, forests: int) -> DataFrame:
    """Pairs (a, b, sure) that share a list, lie in different components so far and are similar (sure) or may be.

    Only lists that still hold several components are read. Lists with one pivot have much the same members, so
    their union is one crowd, and a pair is met once. Members of a crowd's largest component have nothing to ask
    each other: the others (askers) are dealt into blocks and meet blocks of all members in tasks. A task counts
    what an asker has in common with its members, on whole sets where both have at most WIDE shingles, else on
    WIDE sketches, and merges components as it goes, so it writes a forest of sure links and ``forests`` forests of
    possible ones that are not ``rejected``, at most a few rows a member, and a row of nulls if possible ones are left.
    """
    labelled = keep(index.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    several = labelled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("value")
    crowds = keep(labelled.join(keep(several.join(lists, "value")), "value").select("pivot", "id", "component").distinct())
    sizes = crowds.groupBy("pivot", "component").agg(F.count("*").alias("n")).groupBy("pivot")
    sizes = sizes.agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"))
    blocks = lambda n: F.expr(f"cast(({n} + {BLOCK - 1}) div {BLOCK} as int)")
    sizes = keep(sizes.select("pivot", F.col("top.component").alias("largest"), blocks("members").alias("blocks"), blocks("(members - top.n)").alias("asking")))
    members = crowds.join(sizes, "pivot").join(sets.select("id", "n", "wide"), "id").withColumn("asks", F.col("component") != F.col("largest"))
    refused = rejected.select("a", "b").unionByName(rejected.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("refused"))
    dealt = lambda n: F.expr(f"cast(pmod(xxhash64(id, 5), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    askers = members.filter("asks").join(refused, "id", "left").withColumn("i", dealt("asking")).withColumn("j", each("blocks"))
    told = members.withColumn("j", dealt("blocks")).withColumn("i", each("asking")).withColumn("refused", F.lit(None).cast("array<bigint>"))
    columns = ["pivot", "i", "j", "id", "component", "n", "wide", "asks", "refused"]
    rows = askers.select(*columns, F.lit(True).alias("asker")).unionByName(told.select(*columns, F.lit(False).alias("asker")))

    def go(got):
        import numpy as np
        import pyarrow as pa

        asker = got.column("asker").to_numpy()
        own = got.filter(pa.array(~asker))
        ids, comp, n, asks = (own.column(c).to_numpy() for c in ("id", "component", "n", "asks"))
        hashes = [np.frombuffer(v.as_buffer(), np.uint64) for v in own.column("wide")]
        sizes = np.array([len(s) for s in hashes])
        names, number = np.unique(np.concatenate(hashes), return_inverse=True)
        holders = np.repeat(np.arange(len(hashes)), sizes)[np.argsort(number, kind="stable")]
        held = np.bincount(number)
        first = np.cumsum(held) - held
        asking = got.filter(pa.array(asker))
        # Components as the task finds them: each label's root, for the sure links and one for each forest.
        labels, label = np.unique(np.concatenate([comp, asking.column("component").to_numpy()]), return_inverse=True)
        roots = [np.arange(len(labels)) for _ in range(1 + forests)]
        mine, out, maybe, lost = label[len(ids) :], [], [], False
        columns = [asking.column(c) for c in ("id", "n", "wide", "refused")]
        for x, (own_id, own_n, own_set, refused) in enumerate(zip(*columns)):
            own_id, own_n, own_set = own_id.as_py(), own_n.as_py(), np.frombuffer(own_set.as_buffer(), np.uint64)
            at = np.searchsorted(names, own_set)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own_set)]
            # The holders of each of x's hashes, one after the other.
            spread = np.repeat(first[at] - (np.cumsum(held[at]) - held[at]), held[at]) + np.arange(held[at].sum())
            common = np.bincount(holders[spread], minlength=len(ids))
            root = roots[0][label[: len(ids)]]
            near = (root != roots[0][mine[x]]) & (~asks | (ids > own_id)) & (100 * np.minimum(n, own_n) >= percent * np.maximum(n, own_n))
            whole = (n <= WIDE) & (own_n <= WIDE)
            sure = near & whole & (100 * common >= percent * (n + own_n - common))
            for y in np.flatnonzero(sure)[np.unique(root[sure], return_index=True)[1]]:
                out.append((own_id, ids[y], True))
                roots[0][roots[0] == roots[0][label[y]]] = roots[0][mine[x]]
            left = near & ~whole & (common >= least_shared(WIDE, percent))
            if left.any() and refused.as_py():
                left &= ~np.isin(ids, refused.as_py())
            maybe += [(own_id, ids[y], mine[x], label[y]) for y in np.flatnonzero(left) if alike(own_set, hashes[y], own_n, n[y], percent, WIDE)]
            if len(maybe) > 4 * BLOCK * forests:
                maybe, lost = thin(maybe, roots, lost)
        maybe, lost = thin(maybe, roots, lost)
        out += [(a, b, False) for a, b, _, _ in maybe]
        a, b, sure = zip(*out) if out else ((), (), ())
        low, high = np.minimum(a, b).astype(np.int64).tolist(), np.maximum(a, b).astype(np.int64).tolist()
        more = [None] * lost  # one row without ids says that possible links were left out
        return pa.table({"a": pa.array(low + more, pa.int64()), "b": pa.array(high + more, pa.int64()), "sure": pa.array([*sure, *[False] * lost], pa.bool_())})

    def thin(pairs, roots, lost):
        """The pairs that lie in one of the forests over what the sure links left apart; whether others do not."""
        for r in roots[1:]:
            r[:] = roots[0]
        out = []
        for pair in pairs:
            if roots[0][pair[2]] == roots[0][pair[3]]:
                continue
            for r in roots[1:]:
                x, y = r[pair[2]], r[pair[3]]
                if x != y:
                    r[r == y] = x
                    out.append(pair)
                    break
            else:
                lost = True
        return out, lost

    return rows.groupBy("pivot", "i", "j").applyInArrow(go, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs as (a, b, ok): whether the intersection of their whole sets is ``percent`` of the union."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"h_{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("h_a"), batch.column("h_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return joined.mapInArrow(run, "a long, b long, ok boolean")


def whole_sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(id, n, hashes, wide: the least WIDE of them) of the wanted nodes (id, doc_id, mark, same), from one document's text."""
    wanted = wanted.select("id", "same", F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), text_of().alias("text"))
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("id", "same", "text")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), words_each).tobytes() for t in batch.column("text")]
            right = [hashlib.blake2b(h, digest_size=16).digest() == s for h, s in zip(hashes, batch.column("same").to_pylist())]
            columns = [batch.column("id"), pa.array([len(h) // 8 for h in hashes], pa.int64()), pa.array(hashes, pa.binary()), pa.array([h[: 8 * WIDE] for h in hashes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "hashes", "wide"]).filter(pa.array(right, pa.bool_()))

    # Rows that repeat a document give a node twice.
    return rows.mapInArrow(run, "id long, n long, hashes binary, wide binary").dropDuplicates(["id"])


def label(docs: DataFrame, extra: list, words_each: int, percent: int) -> DataFrame:
    """One row per document: doc_id, what ``extra`` names, n, root and component (its smallest doc_id); both null for empty sets."""
    rows = keep(sketch(docs, extra, words_each))
    # Documents with one set are one node, so thousands of copies count once below.
    nodes = rows.filter("n > 0").groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("who"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("retained").alias("retained"))
    nodes = keep(nodes.select("same", "who.doc_id", "who.mark", "copies", "n", "retained", F.monotonically_increasing_id().alias("id")))

    # Inverted lists of retained values. What only one set retains joins nothing, and a set with too few shared
    # values has no partner. Of the others, the rarest ones are enough: two sets that share m of r and s values
    # share one of the first r - m + 1 and s - m + 1, so the commonest values need no list.
    postings = nodes.select("id", "n", F.explode("retained").alias("value"))
    counts = keep(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = postings.join(counts, "value").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    need = F.least(F.lit(least_shared(RETAINED, percent)), F.ceil(F.col("n") * percent / 100)).cast("int")
    shared = shared.withColumn("keys", F.size("v") - need + 1).filter("keys > 0")
    index = keep(shared.select("id", F.explode(F.expr("slice(v, 1, keys)")).alias("x")).select("id", F.col("x.value").alias("value")))
    copies = nodes.select("id", "copies")
    lists = keep(index.join(copies, "id").groupBy("value").agg(F.count("*").alias("members"), F.max(F.struct("copies", "id")).alias("top")).filter("members > 1").select("value", F.col("top.id").alias("pivot")))
    index = keep(index.join(lists.select("value"), "value", "left_semi"))

    # First each member against the pivot of its list, a set with many copies if there is one.
    stars = index.join(lists, "value").filter("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    stars = keep(estimate(stars, nodes, percent))
    wanted = nodes.join(index.select("id").distinct(), "id", "left_semi")
    sets = keep(whole_sets(docs, wanted, words_each))
    tried = keep(confirm(stars, sets, percent))
    links, rejected, forests = tried.filter("ok").select("a", "b"), tried.filter("not ok").select("a", "b"), FORESTS
    found = components(links)
    # Then what the stars left apart, in lists that still hold several components. Sure links need no further look;
    # possible ones are confirmed. Where a task left some out, once more with many more forests.
    while True:
        more = keep(rest_of_lists(index, lists, sets, found, rejected, percent, forests))
        if more.isEmpty():
            break
        tried = keep(confirm(more.filter("not sure AND a IS NOT NULL").select("a", "b"), sets, percent))
        links = links.unionByName(more.filter("sure").select("a", "b")).unionByName(tried.filter("ok").select("a", "b"))
        found = components(links)
        if more.filter("a IS NULL").isEmpty():
            break
        rejected, forests = rejected.unionByName(tried.filter("not ok").select("a", "b")), 16 * forests

    owner = nodes.join(found, "id", "left").withColumn("root", F.coalesce("component", "id")).select("same", "root", "doc_id")
    least = owner.groupBy("root").agg(F.min("doc_id").alias("component"))
    owner = keep(owner.join(least, "root").select("same", "root", "component"))
    # Both are stored tables: a set with very many copies is a skewed partition that Spark can split.
    return rows.drop("retained", "mark").withColumn("same", F.when(F.col("n") > 0, F.col("same"))).join(owner, "same", "left")


def near_groups(docs: DataFrame, words_each: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is that of its distinct shingles of ``words_each`` words, A-Z lower-cased; a shorter text is
    one shingle, one without words has none and links with nothing. Documents link if the intersection of their
    sets is at least ``percent`` of the union, confirmed on the whole sets; component_id is the smallest doc_id
    reachable, kept whether it is the document's own. Null doc_ids count as largest: they take a linked document's
    id, else null; rows that repeat a doc_id have their text's component; an empty table gives no rows.
    """
    found = label(docs, [], words_each, percent)
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, and all rows without words."""
    found = keep(label(docs, row_key(docs), words_each, percent))
    first = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("x")).select("x.k1", "x.k2", F.lit(1).alias("copies"))
    return deal(docs, first.unionByName(found.filter("n = 0").select("k1", "k2", F.lit(1).alias("copies"))))
