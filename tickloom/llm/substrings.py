"""Repeated passages by suffix automata of reference shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import field, keep, text_of

#: Words of an anchor.
ANCHOR = 16
#: Contexts that one automaton may hold; anchors with more (hot ones) go by whole windows instead.
SHARD = 2048


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def statistics(self, words: list) -> list[int]:
        """For each word, how many words up to it occur together in what was added."""
        at, size, out = 0, 0, []
        for word in words:
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at = self.next[at][word]
                size += 1
            out.append(size)
        return out


def runs(hit, window: int) -> list[tuple[int, int]]:
    """Word spans [from, to) under the windows that start where ``hit`` is true."""
    out = []
    for k, x in enumerate(hit):
        if x:
            if out and k <= out[-1][1] - window + 1:
                out[-1][1] = k + window
            else:
                out.append([k, k + window])
    return [(a, b) for a, b in out]


def anchors_of(words: list[bytes], window: int):
    """Arrays (hash, first, last): for each run of windows with one anchor, its hash and the starts of its windows.

    A window's anchor is the one of its ANCHOR-word pieces with the smallest hash, the leftmost on ties. It depends
    on the window's words alone, so equal windows have equal anchors wherever they stand.
    """
    import numpy as np
    import xxhash

    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    names = dict.fromkeys(words)
    names = dict(zip(names, map(xxhash.xxh3_64_intdigest, names)))
    ids = np.fromiter(map(names.__getitem__, words), np.uint64, len(words))
    pieces = len(words) - ANCHOR + 1
    h = np.zeros(pieces, np.uint64)
    for k in range(ANCHOR):
        h = (h + ids[k : k + pieces]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    wide, reach, at = window - ANCHOR + 1, 1, np.arange(pieces)
    while reach < wide:
        step = min(reach, wide - reach)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        reach += step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]].view(np.int64), first.astype(np.int32), last.astype(np.int32)


def outline(docs: DataFrame, window: int) -> DataFrame:
    """One row per document: doc_id, rank (its place in the order), mark, n_words, sha, anchors."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("rank"), F.xxhash64("text").alias("mark"), text_of().alias("text"))
    anchor = T.StructType([T.StructField("h", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    schema = T.StructType([T.StructField("doc_id", field(docs, "doc_id", T.LongType())), *[T.StructField(n, T.LongType()) for n in ("rank", "mark", "n_words")], T.StructField("sha", T.StringType()), T.StructField("anchors", T.ArrayType(anchor))])

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, sha, found = [], [], []
            for value in batch.column("text"):
                words = value.as_py().encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(anchors_of(words, window))
            ends = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
            parts = [pa.array(np.concatenate([f[k] for f in found]), t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
            anchors = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["h", "first", "last"]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "rank", "mark")] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), anchors], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def contexts_of(suspects: DataFrame, window: int) -> DataFrame:
    """(h, rank, mark, first, words): the words under each suspect run of windows, by its anchor.

    Runs of hot anchors have no h; those that follow one another in a document are one row.
    """

    def stretches(places):
        out = []
        for p in sorted((p for p in places if p["hot"]), key=lambda p: p["first"]):
            if out and p["first"] <= out[-1][2] + 1:
                out[-1][2] = max(out[-1][2], p["last"])
            else:
                out.append([None, p["first"], p["last"]])
        return out + [(p["h"], p["first"], p["last"]) for p in places if not p["hot"]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(5)]
            for text, rank, mark, places in zip(*(batch.column(c) for c in ("text", "rank", "mark", "places"))):
                words, rank, mark = text.as_py().encode().split(), rank.as_py(), mark.as_py()
                for h, first, last in stretches(places.as_py()):
                    for column, v in zip(out, (h, rank, mark, first, b" ".join(words[first : last + window]))):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["h", "rank", "mark", "first", "words"])

    return suspects.mapInArrow(run, "h long, rank long, mark long, first int, words binary")


SPANS = "rank long, mark long, spans array<struct<lo: int, hi: int>>"


def span_columns(rows: list[tuple]) -> dict:
    """The columns of SPANS from (rank, mark, spans): one row for all spans of a document in a shard's context."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    rank, mark, spans = zip(*rows) if rows else ((), (), ())
    listed = [[{"lo": a, "hi": b} for a, b in x] for x in spans]
    return {"rank": pa.array(rank, pa.int64()), "mark": pa.array(mark, pa.int64()), "spans": pa.array(listed, kind)}


def stream_shards(contexts: DataFrame, window: int) -> DataFrame:
    """Spans of words that a smaller rank has too, from one automaton per anchor.

    The contexts of an anchor arrive by rising rank. Those of one rank are read against the automaton of all
    smaller ones and then added to it, unless it has them whole.
    """
    ordered = contexts.repartition("h").sortWithinPartitions("h", "rank")

    def run(batches):
        import pyarrow as pa

        shard, held, rank_now, waiting, whole = None, None, None, [], {}
        for batch in batches:
            out = []
            for h, rank, mark, first, text in zip(*(batch.column(c).to_pylist() for c in ("h", "rank", "mark", "first", "words"))):
                if h != shard:
                    shard, held, rank_now, waiting, whole = h, None, None, [], {}
                if rank != rank_now:
                    for own, words in waiting:
                        held = held or SuffixAutomaton()
                        held.add(words)
                        whole[own] = True
                    rank_now, waiting = rank, []
                words = text.split(b" ")
                if text in whole:
                    out.append((rank, mark, [(first, first + len(words))]))
                    continue
                size = held.statistics(words) if held else []
                hit = [s >= window for s in size[window - 1 :]]
                if any(hit):
                    out.append((rank, mark, [(first + a, first + b) for a, b in runs(hit, window)]))
                if not hit or not all(hit):
                    waiting.append((text, words))
            yield pa.RecordBatch.from_pydict(span_columns(out))

    return ordered.mapInArrow(run, SPANS)


def match_windows(stretches: DataFrame, groups: int, window: int) -> DataFrame:
    """The same spans for the stretches of hot anchors, dealt by document into ``groups``.

    A group lists its different windows, each with its smallest and largest rank; windows are told apart by 128 bits
    of their words. The smallest rank over all groups goes back to the groups that hold the window and a larger rank,
    and these mark their stretches. So what is shuffled and joined counts different windows of a group, not copies,
    and a document gives one row, however many hot anchors it has.
    """
    placed = stretches.withColumn("salt", F.expr(f"cast(pmod(xxhash64(rank, mark), {groups}) as int)"))

    def windows(table):
        import xxhash

        for rank, mark, first, text in zip(*(table.column(c).to_pylist() for c in ("rank", "mark", "first", "words"))):
            words = text.split(b" ")
            yield rank, mark, first, [xxhash.xxh3_128_digest(b" ".join(words[k : k + window])) for k in range(len(words) - window + 1)]

    def summarise(key, got):
        import pyarrow as pa

        least, most = {}, {}
        for rank, _, _, found in windows(got):
            for w in found:
                least[w] = min(rank, least.get(w, rank))
                most[w] = max(rank, most.get(w, rank))
        n = len(least)
        return pa.table({"salt": pa.array([key[0].as_py()] * n, pa.int32()), "w": pa.array(list(least), pa.binary()), "least": pa.array(list(least.values()), pa.int64()), "most": pa.array(list(most.values()), pa.int64())})

    own = keep(placed.groupBy("salt").applyInArrow(summarise, "salt int, w binary, least long, most long"))
    first = keep(own.groupBy("w").agg(F.min("least").alias("first_rank"), F.max("most").alias("last_rank")).filter("first_rank < last_rank").select("w", "first_rank"))
    told = own.join(first, "w").filter("first_rank < most").select("salt", "w", "first_rank")

    def mark_spans(got, told):
        import pyarrow as pa

        smallest = dict(zip(told.column("w").to_pylist(), told.column("first_rank").to_pylist()))
        out = {}
        for rank, mark, first, found in windows(got):
            hit = [smallest.get(w, rank) < rank for w in found]
            if any(hit):
                out.setdefault((rank, mark), []).extend((first + a, first + b) for a, b in runs(hit, window))
        return pa.table(span_columns([(*own, spans) for own, spans in out.items()]))

    return placed.groupBy("salt").cogroup(told.groupBy("salt")).applyInArrow(mark_spans, SPANS)


def cut(suspects: DataFrame, spans: DataFrame) -> DataFrame:
    """(rank, mark, n_removed, kept_sha) of the documents with spans."""
    listed = spans.groupBy("rank", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = suspects.select("rank", "mark", "text").join(listed, ["rank", "mark"])

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, sha = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, spans.values.field(0).to_numpy(), 1)
                np.add.at(edge, spans.values.field(1).to_numpy(), -1)
                stays = np.cumsum(edge[:-1]) == 0
                n.append(int(len(words) - stays.sum()))
                sha.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(stays)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["rank", "mark", "n_removed", "kept_sha"])

    return rows.mapInArrow(run, "rank long, mark long, n_removed long, kept_sha string")


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id. Documents
    with the same words as a smaller one go whole. For the others, every window has an anchor; only windows whose
    anchor is in two documents can repeat, and all windows of one anchor meet in one shard, so no document has to
    pass every shard. A shard's automaton holds at most SHARD contexts; under commoner anchors, groups of documents
    match whole windows.

    Null texts have no words; null doc_ids rank last, as one; rows with one doc_id never remove each other's words;
    an empty table gives no rows. Other columns are not read.
    """
    rows = keep(outline(docs, window))
    copies = keep(rows.filter(f"n_words >= {window}").groupBy("sha").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).filter("least < most").select("sha", "least"))
    rows = keep(rows.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("least") < F.col("rank"), F.lit(False))).drop("least"))

    places = rows.filter("not copy").select("rank", "mark", F.explode("anchors").alias("x")).select("rank", "mark", "x.*")
    common = places.groupBy("h").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    common = keep(common.select("h", (F.col("n") > SHARD).alias("hot"), "n"))
    groups = 1 + (common.filter("hot").agg(F.sum("n")).first()[0] or 0) // SHARD
    # A set, and one row a document: rows that repeat it would each bring all places to all repeats.
    listed = places.join(common.drop("n"), "h").groupBy("rank", "mark").agg(F.collect_set(F.struct("h", "hot", "first", "last")).alias("places"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("rank"), F.xxhash64("text").alias("mark"), text_of().alias("text"))
    suspects = keep(texts.join(listed, ["rank", "mark"]).dropDuplicates(["rank", "mark"]))
    contexts = keep(contexts_of(suspects, window))
    spans = stream_shards(contexts.filter("h is not null"), window).unionByName(match_windows(contexts.filter("h is null").drop("h"), groups, window))
    found = cut(suspects, keep(spans))

    none = F.sha2(F.lit(""), 256)
    joined = rows.join(keep(found), ["rank", "mark"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
