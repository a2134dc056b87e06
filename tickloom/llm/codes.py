"""Product codes of vectors: codebooks by integer k-means, distances from Walsh-Hadamard spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import keep

#: Rows whose distances to all entries are held at once.
CHUNK = 1024
LONGEST = 2**63 - 1


def whole_numbers(values):
    """floor(1024 * x) of finite doubles: int64, or Python integers where one does not fit well."""
    import math

    import numpy as np

    if len(values) == 0 or np.abs(values).max() < 2.0**50:
        return np.floor(values * 1024.0).astype(np.int64)
    out = np.empty(len(values), object)
    out[:] = [math.floor(v) * 1024 if abs(v) >= 2.0**53 else math.floor(v * 1024) for v in values.tolist()]
    return out


def sequency_order(width: int):
    """For ``width`` a power of two, the rows of the Hadamard matrix by rising number of sign changes."""
    bits = width.bit_length() - 1
    return [int(f"{s ^ (s >> 1):0{bits}b}"[::-1], 2) if bits else 0 for s in range(width)]


def spectrum(rows):
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order.

    Values stay integers: int64 where the squared distance of two such spectra fits, else Python integers.
    """
    import numpy as np

    n, w = rows.shape
    width = 1 << max(w - 1, 0).bit_length()
    most = int(np.abs(rows).max()) if rows.size else 0
    kind = np.int64 if rows.dtype != object and width * (2 * width * most) ** 2 < 2**62 else object
    at = np.zeros((n, width), kind)
    at[:, :w] = rows
    step = 1
    while step < width:
        pair = at.reshape(n, width // (2 * step), 2, step)
        at = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return at[:, sequency_order(width)]


def nearest(rows, entries):
    """For each spectrum of ``rows`` its nearest one of ``entries`` (ties: the lower index) and their squared distance.

    Squared differences add up in sequency order, times the width. After a quarter of the coefficients the leading
    entry's whole distance bounds the row's; entries go as soon as their sum exceeds it.
    """
    import numpy as np

    n, width = rows.shape
    if rows.dtype == object or entries.dtype == object:
        rows, entries = rows.astype(object), entries.astype(object)
    index, distance = np.zeros(n, np.int64), np.zeros(n, rows.dtype)
    lead = max(1, width // 4)
    for start in range(0, n, CHUNK):
        a = rows[start : start + CHUNK]
        total = np.zeros((len(a), len(entries)), rows.dtype)
        for s in range(lead):
            gap = a[:, s : s + 1] - entries[:, s]
            total += gap * gap
        first = total.argmin(1)
        rest = a[:, lead:] - entries[first, lead:]
        bound = total[np.arange(len(a)), first] + (rest * rest).sum(1)
        row, entry = np.nonzero((total <= bound[:, None]).astype(bool))
        left = total[row, entry]
        for s in range(lead, width):
            gap = a[row, s] - entries[entry, s]
            left = left + gap * gap
            if s % 4 == 3 or s == width - 1:
                stays = (left <= bound[row]).astype(bool)
                row, entry, left = row[stays], entry[stays], left[stays]
        # Pairs are ordered by row, then entry; the leading entry is always among them.
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(left, starts)
        best = np.flatnonzero((left == least[row]).astype(bool))
        best = best[np.diff(row[best], prepend=-1) > 0]
        index[start : start + len(a)] = entry[best]
        distance[start : start + len(a)] = least // width
    return index, distance


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds finite components only."""
    vector = F.col(column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col(column).isNotNull() & finite).withColumn(column, vector)


def parts_of(column, dims: int, parts: int):
    """A list column of doubles as integers (row, part, position); missing components at the end count as 0."""
    import numpy as np

    width = -(-dims // parts)
    sizes = np.diff(column.offsets.to_numpy())
    values = whole_numbers(column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()])
    out = np.zeros((len(column), parts * width), values.dtype)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out.reshape(len(column), parts, width)


def book_array(books: list, part: int):
    """One part's entries as an array of integers."""
    import numpy as np

    most = max((abs(v) for e in books[part] for v in e), default=0)
    out = np.zeros((len(books[part]), len(books[part][0])), np.int64 if most < 2**61 else object)
    out[:] = books[part]
    return out


def first_entries(kept: DataFrame, dims: int, parts: int, entries: int) -> list:
    """books[part][entry][position] of the vectors with the smallest vec_ids (null last, ties by components)."""
    import pyarrow as pa

    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    cut = parts_of(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), dims, parts)
    return [[[int(v) for v in e] for e in cut[:, p]] for p in range(parts)]


def sums_of_entries(kept: DataFrame, books: list, dims: int) -> DataFrame:
    """(part, entry, pos, n, high, low): per nearest entry the number of parts and their sum, high * 2**40 + low.

    Each task adds up its own rows first, so it sends one row per component of an entry, however many rows chose it.
    """
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        books = shared.value
        parts = len(books)
        spectra = [spectrum(book_array(books, p)) for p in range(parts)]
        width = len(books[0][0])
        counts = np.zeros((parts, len(books[0])), np.int64)
        sums = np.zeros((parts, len(books[0]), width), object)
        for batch in batches:
            cut = parts_of(batch.column("embedding"), dims, parts)
            if cut.dtype != object and len(cut) and int(np.abs(cut).max(initial=0)) * len(cut) >= 2**62:
                cut = cut.astype(object)
            for p in range(parts):
                index, _ = nearest(spectrum(cut[:, p]), spectra[p])
                counts[p] += np.bincount(index, minlength=len(spectra[p]))
                own = np.zeros((len(spectra[p]), width), cut.dtype)
                np.add.at(own, index, cut[:, p])
                sums[p] += own
        part, entry = np.nonzero(counts)
        values = [int(v) for v in sums[part, entry].ravel()]
        at = [np.repeat(c, width) for c in (part, entry)] + [np.tile(np.arange(width), len(part)), np.repeat(counts[part, entry], width)]
        columns = [pa.array(c, t) for c, t in zip(at, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        columns += [pa.array([Decimal(v >> 40) for v in values], pa.decimal128(38, 0)), pa.array([v & (2**40 - 1) for v in values], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "pos", "n", "high", "low"])

    return kept.select("embedding").mapInArrow(run, "part int, entry int, pos int, n long, high decimal(38,0), low long")


def train(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list, int]:
    """The codebooks books[part][entry][position] after ``rounds`` rounds, and the number of components.

    What comes back to the driver is a codebook: ``entries`` times the components, whatever the number of vectors.
    """
    dims = kept.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return [], 0
    books = first_entries(kept, dims, parts, entries)
    for _ in range(rounds):
        found = sums_of_entries(kept, books, dims).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
        for r in found.collect():
            books[r.part][r.entry][r.pos] = ((int(r.high) << 40) + r.low) // r.n
    return books, dims


def encode(kept: DataFrame, books: list, dims: int) -> DataFrame:
    """The rows of ``kept`` (struct ``row``, embedding) as row, code (two hex digits a part) and error."""
    schema = T.StructType([kept.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        books = shared.value
        spectra = [spectrum(book_array(books, p)) for p in range(len(books))]
        for batch in batches:
            cut = parts_of(batch.column("embedding"), dims, len(books))
            found = [nearest(spectrum(cut[:, p]), spectra[p]) for p in range(len(books))]
            codes = ["".join(f"{v:02x}" for v in each) for each in zip(*(i.tolist() for i, _ in found))]
            errors = [min(sum(map(int, each)), LONGEST) for each in zip(*(d.tolist() for _, d in found))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["row", "code", "error"])

    return kept.select("row", "embedding").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(1024 * x); vectors are cut into ``parts`` equal runs, each with a codebook of at most 256
    entries that starts with the smallest vec_ids. A round assigns parts to entries and replaces entries by the
    floored mean of their parts; a last assignment gives code and error (squared distances over all parts).

    Rows with a null vector or a null, NaN or infinite component go. Vectors of different lengths count as extended
    with zeros to the longest, and that to a multiple of ``parts``. Null vec_ids come last among the first entries,
    repeated rows count each time; null labels are one label; sums above 2**63 - 1 give that number; no usable
    vector gives no rows. Codebooks are collected and broadcast: at most 256 times the components of one vector.
    The table is read rounds + 3 times.
    """
    import hashlib

    kept = usable(vectors.select("vec_id", "label", "embedding"))
    books, dims = train(kept, parts, entries, rounds)
    if not books:
        none = kept.filter("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
    # Written, so that the sums over labels don't search the codebooks again.
    coded = keep(encode(kept.select(F.struct("vec_id", "label").alias("row"), "embedding"), books, dims).select("row.*", "code", "error"))
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = totals.withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
