"""Quality rules with thresholds that follow the data of each language and source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import back, keep, text_of, whole_row

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = "#*$%&|<>"

#: Metric -> its whole-number value (SQL), the least spread that counts, and whether low values fail too.
#: Shares are in 1/1024, word lengths in 1/64 of a character.
METRICS = {
    "symbols": ("(1024 * n_symbols) div n_words", 128, False),
    "dup_lines": ("(1024 * n_dup_lines) div greatest(n_lines, 1)", 128, False),
    "repeats": ("(1024 * n_repeat_words) div n_words", 64, False),
    "word_length": ("(64 * word_chars) div n_words", 64, True),
}


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """How many words lie in a window of ``n`` words that the text holds twice or more.

    Windows get whole numbers by naming, so no two different windows meet; memory is a few numbers a word.
    """
    import numpy as np

    if len(words) <= n:
        return 0
    names = dict.fromkeys(words)
    if len(names) == len(words):
        return 0
    names = dict(zip(names, range(len(names))))
    ids, vocab = np.fromiter(map(names.__getitem__, words), np.int64, len(words)), len(names)
    code, m = ids, len(words) - n + 1
    bound = vocab
    for k in range(1, n):
        if bound > (1 << 62) // vocab:
            code = np.unique(code, return_inverse=True)[1]
            bound = len(words)
        code = code[:-1] * vocab + ids[k:]
        bound *= vocab
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The values of :data:`COUNTS` for a text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def measure(rows: DataFrame) -> DataFrame:
    """Replace the column ``text`` by :data:`COUNTS` (long); the other columns pass as they are."""
    at = rows.columns.index("text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [counts_of(x.as_py() or "") for x in batch.column(at)]
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([c for _, c in others] + columns, [n for n, _ in others] + COUNTS)

    return rows.mapInArrow(run, schema).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram sketches (lang, source, metric, low, n): values share a bin if their first six bits agree.

    A bin's lower end is within 1/32 of every value in it. Sketches of parts add up to that of the whole, in any
    order, so they merge exactly: by task, by group, by language and over all rows.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).alias("v")) for m, (sql, _, _) in METRICS.items()]))
    rows = measured.filter("n_words > 0").select("lang", "source", values.alias("x")).select("lang", "source", "x.*")
    low = F.expr("v - v % cast(shiftleft(1L, greatest(length(bin(v)) - 6, 0)) as bigint)")
    return rows.groupBy("lang", "source", "metric", low.alias("low")).agg(F.count("*").alias("n"))


def fences(bins: DataFrame, keys: list[str], tail: float = 3.0) -> DataFrame:
    """Per group of ``keys``: its number of rows and each metric's lowest and highest value that passes.

    A value fails beyond ``tail`` times the distance of the quartiles, which the sketch gives.
    """
    merged = bins.groupBy(*keys, "metric", "low").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(group.orderBy("low"))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.expr("4 * upto >= total"), F.col("low"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * total"), F.col("low"))).alias("q3"),
    )
    columns = [F.max("total").alias("rows")]
    for m, (_, least, both) in METRICS.items():
        own, spread = F.col("metric") == m, F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        columns.append(F.max(F.when(own, F.col("q3") + tail * spread)).alias(f"{m}_max"))
        if both:
            columns.append(F.max(F.when(own, F.col("q1") - tail * spread)).alias(f"{m}_min"))
    return quartiles.groupBy(*keys).agg(*columns)


def thresholds(measured: DataFrame, least_rows: int = 200, tail: float = 3.0) -> DataFrame:
    """One row per (lang, source). Groups under ``least_rows`` rows take their language's sketch, small languages that of all."""
    bins = keep(sketches(measured))
    group = fences(bins, ["lang", "source"], tail)
    names = [c for c in group.columns if c not in ("lang", "source", "rows")]
    lang = fences(bins, ["lang"], tail).select(F.col("lang").alias("l"), F.col("rows").alias("l_rows"), *[F.col(c).alias(f"l_{c}") for c in names])
    every = fences(bins.withColumn("all", F.lit(1)), ["all"], tail).select(F.struct(*names)).scalar()
    joined = group.join(lang, F.col("lang").eqNullSafe(F.col("l"))).withColumn("every", every)
    pick = [F.when(F.col("rows") >= least_rows, F.col(c)).when(F.col("l_rows") >= least_rows, F.col(f"l_{c}")).otherwise(F.col("every").getField(c)).alias(c) for c in names]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *pick)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: false if base_failed, else whether every metric is within the limits of the row's group."""
    fine = F.lit(True)
    for m, (sql, _, both) in METRICS.items():
        fine &= F.expr(sql) <= F.col(f"{m}_max")
        if both:
            fine &= F.expr(sql) >= F.col(f"{m}_min")
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return measured.join(limits, on, "left").withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(fine, F.lit(False))))


def score_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, :data:`COUNTS`, base_failed, kept.

    Null texts have no words and fail; null lang or source is a group of its own; repeated rows are judged each;
    an empty table gives no rows. Other columns are not read.
    """
    measured = keep(measure(docs.select("doc_id", "lang", "source", text_of().alias("text"))))
    return judge(measured, thresholds(measured)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The limits come from a first pass over narrow rows; the second pass measures each row beside its text, so no
    text is shuffled.
    """
    first = measure(docs.select("lang", "source", text_of().alias("text")))
    limits = keep(thresholds(keep(first)))
    rows = docs.select(whole_row(docs).alias("doc"), "lang", "source", text_of().alias("text"))
    return back(judge(measure(rows), limits).filter("kept"), docs)
