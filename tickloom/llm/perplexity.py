"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import field, keep, text_of

#: The model is one of UTF-8 bytes; its n-grams are exact numbers of up to 5 bytes.
ORDER = 5
#: Entries (n-grams and contexts) of one shard of the model, the bound of what is sent to all tasks at once.
SHARD_ENTRIES = 2_000_000
#: Trusted doc_ids that may be sent to all tasks; more of them are joined by a shuffle.
SENT_IDS = 2_000_000


def codes_of(pieces: list[tuple[bytes, bytes]]):
    """The n-gram of ORDER bytes that ends at each byte of the pieces (bytes before it, piece), one after the other."""
    import numpy as np

    whole = np.frombuffer(b"".join(lead + piece for lead, piece in pieces), np.uint8).astype(np.int64)
    codes = np.zeros(max(0, len(whole) - ORDER + 1), np.int64)
    for k in range(ORDER):
        codes = (codes << 8) | whole[k : k + len(codes)]
    # A lead is ORDER - 1 bytes long; what ends in a later lead is not an n-gram of the text.
    own = np.ones(len(codes), bool)
    ends = np.cumsum([len(piece) + ORDER - 1 for _, piece in pieces])[:-1] - (ORDER - 1)
    for k in range(ORDER - 1):
        own[ends + k] = False
    return codes[own]


def slices(texts: list[bytes], most: int = 1_000_000):
    """Lists of (number of the text, bytes before the piece, piece) with about ``most`` bytes; long texts are cut.

    A text starts as if after line feeds; a cut loses nothing, since a piece knows the bytes before it.
    """
    part, size, lead = [], 0, b"\n" * (ORDER - 1)
    for k, text in enumerate(texts):
        for lo in range(0, len(text), most):
            piece = text[lo : lo + most]
            if part and size + len(piece) > most:
                yield part
                part, size = [], 0
            part.append((k, (lead + text[max(0, lo - ORDER + 1) : lo])[-(ORDER - 1) :], piece))
            size += len(piece)
    if part:
        yield part


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts whose document is labelled as good."""
    ids = labels.filter("quality = 1").select("doc_id").distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    return docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id").select("text")


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(g, n): how often each n-gram of ORDER bytes occurs, counted in the tasks first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(0)]
            for part in slices(texts):
                g, n = np.unique(codes_of([p[1:] for p in part]), return_counts=True)
                g, inverse = np.unique(np.concatenate([held[0], g]), return_inverse=True)
                total = np.zeros(len(g), np.int64)
                np.add.at(total, inverse, np.concatenate([held[1], n]))
                held = (g, total)
                if len(g) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["g", "n"])
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["g", "n"])

    return texts.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> DataFrame:
    """The model (k, g, p, back): for k bytes long n-gram g its log2 probability and the log2 weight of shorter ones.

    ``p`` is null for a context that never ends an n-gram, ``back`` for an n-gram that never begins one. Counts of
    the highest order are those of the text; below, an n-gram counts the different bytes that come before it. Each
    order has three discounts, from its numbers of counts 1 to 4. All steps are joins and sums by n-gram.
    """
    level = keep(count_ngrams(texts))
    by_order = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        level = keep(level.groupBy(suffix.alias("g")).agg(F.count("*").alias("n")))
        by_order[k] = level
    out, lower = [], None
    for k in range(1, ORDER + 1):
        now = by_order[k]
        c1, c2, c3, c4 = (now.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first() or (0,) * 4)
        y = c1 / (c1 + 2 * c2) if c1 + 2 * c2 else 0.5
        clip = lambda v, top: min(max(v, 0.1), top)
        d1 = clip(1 - 2 * y * c2 / c1 if c1 else 0.5, 0.95)
        d2 = clip(2 - 3 * y * c3 / c2 if c2 else 1.0, 1.9)
        d3 = clip(3 - 4 * y * c4 / c3 if c3 else 1.5, 2.85)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        now = now.withColumn("ctx", F.expr("shiftright(g, 8)")).withColumn("off", off)
        stats = keep(now.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("spare")))
        joined = now.join(stats, "ctx")
        gamma = F.col("spare") / F.col("total")
        if k == 1:
            p = (F.col("n") - F.col("off")) / F.col("total") + gamma / 256
        else:
            joined = joined.join(lower.select(F.col("g").alias("tail"), F.col("q")), F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == F.col("tail"))
            p = (F.col("n") - F.col("off")) / F.col("total") + gamma * F.col("q")
        lower = keep(joined.select("g", p.alias("q")))
        out.append(lower.select(F.lit(k).alias("k"), "g", F.log2("q").alias("p"), F.lit(None).cast("double").alias("back")))
        out.append(stats.select(F.lit(k - 1).alias("k"), F.col("ctx").alias("g"), F.lit(None).cast("double").alias("p"), F.log2(F.col("spare") / F.col("total")).alias("back")))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return keep(every.groupBy("k", "g").agg(F.max("p").alias("p"), F.max("back").alias("back")))


class Shard:
    """Sorted keys and values of the n-grams of each length; looks up many bytes at once."""

    def __init__(self, tables: dict):
        self.tables = tables

    def find(self, k: int, codes):
        import numpy as np

        g, p, back = self.tables.get(k, (np.zeros(0, np.int64),) * 3)
        if not len(g):
            return np.full(len(codes), np.nan), np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(g, codes), len(g) - 1)
        there = g[at] == codes
        return np.where(there, p[at], np.nan), np.where(there, back[at], np.nan)

    def score(self, codes):
        """log2 probability of the last byte of each n-gram, given the ones before."""
        import numpy as np

        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            own = codes[open_] & ((1 << 8 * k) - 1)
            p, _ = self.find(k, own)
            hit = ~np.isnan(p)
            out[open_[hit]] += p[hit]
            open_, own = open_[~hit], own[~hit]
            if not len(open_):
                return out
            _, back = self.find(k - 1, own >> 8)
            out[open_] += np.where(np.isnan(back), 0.0, back)
        out[open_] -= 8.0
        return out


def score_part(docs: DataFrame, shard: dict, part: int, parts: int) -> DataFrame:
    """Each document's bits under the n-grams that belong to one shard of the model; text columns are dropped."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = Shard(shard)
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column("text")]
            bits = np.zeros(len(texts))
            for some in slices(texts):
                codes = codes_of([p[1:] for p in some])
                mine = np.ones(len(codes), bool) if parts == 1 else (((codes >> 8) & 0xFFFF) % parts) == part
                value = np.zeros(len(codes))
                value[mine] = -model.score(codes[mine])
                sizes = np.array([len(piece) for _, _, piece in some])
                np.add.at(bits, [k for k, _, _ in some], np.add.reduceat(value, np.cumsum(sizes) - sizes))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in others] + [pa.array([len(t) for t in texts], pa.int64()), pa.array(bits)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def shard_of(model: DataFrame, part: int, parts: int) -> dict:
    """One shard of the model as arrays: what bytes after certain two bytes need, and the short n-grams.

    All n-grams of three and more bytes with the same two bytes before the last share a shard, and so do contexts
    that end in them; n-grams of up to two bytes, at most 65,792, are in every shard.
    """
    import numpy as np

    # A row that is both an n-gram and a context is needed by two shards.
    rows = model.filter(f"k <= 2 or (p is not null and (shiftright(g, 8) & 65535) % {parts} = {part}) or (back is not null and (g & 65535) % {parts} = {part})") if parts > 1 else model
    got = rows.select("k", "g", "p", "back").toArrow().sort_by([("k", "ascending"), ("g", "ascending")])
    k = got.column("k").to_numpy()
    out = {}
    for order in range(ORDER + 1):
        own = got.slice(int(np.searchsorted(k, order)), int(np.searchsorted(k, order, "right") - np.searchsorted(k, order)))
        if own.num_rows:
            out[order] = tuple(own.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("g", np.int64), ("p", np.float64), ("back", np.float64)))
    return out


def score_documents(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, mark, n_bytes, bits, rows) for each different row, over all shards of the model."""
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("mark"), text_of().alias("text"))
    entries = model.count()
    parts = max(1, -(-entries // SHARD_ENTRIES))
    done = None
    for part in range(parts):
        scored = keep(score_part(rows, shard_of(model, part, parts), part, parts)) if parts > 1 else score_part(rows, shard_of(model, 0, 1), 0, 1)
        done = scored if done is None else done.unionByName(scored)
    if parts == 1:
        return done.withColumn("rows", F.lit(1))
    summed = done.groupBy("doc_id", "lang", "mark", "n_bytes").agg(F.sum("bits").alias("bits"), F.count("*").alias("times"))
    rows_each = F.expr(f"times div {parts}")
    return summed.select("doc_id", "lang", "mark", "n_bytes", (F.col("bits") / rows_each).alias("bits"), rows_each.alias("rows"), F.explode(F.array_repeat(F.lit(0), rows_each.cast("int"))).alias("_n")).drop("_n")


def limits_of(scored: DataFrame, tail: float = 1.0, least: int = 50) -> DataFrame:
    """Per language and length band, the highest bits per byte that passes.

    Bands double in length, for short texts vary more. The median and the 99.5 % quantile of the trusted documents
    come from counts of values rounded to 1/128 bit, which add up exactly in any order; the limit lies ``tail`` of
    their distances, at least 1/32 bit each, above the high quantile. Bands with under ``least`` trusted documents take the
    limit of all bands of the language, languages with too few that of all.
    """
    bins = scored.filter("trusted and n_bytes > 0").groupBy("lang", "band", F.floor(F.col("per_byte") * 128).alias("bin")).agg(F.count("*").alias("n"))
    bins = keep(bins)

    def of(keys: list[str]) -> DataFrame:
        group = Window.partitionBy(*keys) if keys else Window.partitionBy()
        merged = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
        mid, high = (F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / 128 for q in (0.5, 0.995))
        return ranked.groupBy(*keys).agg(F.max("total").alias("total"), (high + tail * F.greatest(high - mid, F.lit(1 / 32))).alias("limit"))

    bands = of(["lang", "band"]).filter(f"total >= {least}").select(F.col("lang").alias("b_lang"), F.col("band").alias("b_band"), F.col("limit").alias("b_limit"))
    langs = of(["lang"]).filter(f"total >= {least}").select(F.col("lang").alias("l_lang"), F.col("limit").alias("l_limit"))
    every = of([]).select("limit").scalar()
    groups = scored.select("lang", "band").distinct()
    joined = groups.join(bands, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("band") == F.col("b_band")), "left")
    joined = joined.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")), "left").withColumn("a_limit", every)
    return joined.select(F.col("lang").alias("t_lang"), F.col("band").alias("t_band"), F.coalesce("b_limit", "l_limit", "a_limit").alias("limit"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, bits_per_byte, perplexity (per byte), threshold, kept.

    The model learns from every text labelled as good; each whole text is scored against each shard of it. A
    document passes if its bits per byte are at most the threshold of its language and length. Null and empty texts
    have no bits and don't pass; null lang is a language; repeated rows are scored each; without trusted text all
    texts pass; an empty table gives no rows. Other columns are not read.
    """
    scored = score_documents(docs, train(trusted_text(docs, labels)))
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    scored = scored.withColumn("per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))).withColumn("band", F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))))
    scored = keep(keep(scored).join(good, "doc_id", "left").withColumn("trusted", F.coalesce("good", F.lit(False))))
    limits = keep(limits_of(scored))
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & (F.col("band") == F.col("t_band")), "left")
    passes = (F.col("n_bytes") > 0) & F.coalesce(F.col("per_byte") <= F.col("limit"), F.lit(True))
    return joined.select("doc_id", "n_bytes", F.col("per_byte").alias("bits_per_byte"), F.pow(F.lit(2.0), "per_byte").alias("perplexity"), F.col("limit").alias("threshold"), passes.alias("kept"))
