"""Bounded-space online packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import field, keep, text_of, worker_state

#: Bytes of words and ids that a Python worker remembers, about, in each of two generations.
REMEMBERED = 128 << 20
#: Words that go through the tokenizer as one line, and the mark between them: one token of its own.
LINE, MARK = 1024, "\x01"


def word_tokens(locate: Callable[[], str]) -> Callable[[list[bytes]], bytes]:
    """A function from white-space separated words to their ids (little-endian unsigned 32 bits).

    The tokenizer ends every token at white space, so a text's ids are those of its words, joined. Words are
    tokenised once per worker: new words go through the tokenizer in lines, a mark between them whose id tells where
    each ends; a word that holds other white space, the mark or a special token goes alone. Memory is bounded by two
    generations of words.
    """
    import numpy as np
    from tokenizers import Tokenizer

    path = locate()
    state = worker_state("tokens").setdefault(path, {})
    if not state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        mark = tok.encode(MARK, add_special_tokens=False).ids
        state.update(tok=tok, mark=mark[0] if len(mark) == 1 else None, new={}, old={}, size=0)
    tok, mark = state["tok"], state["mark"]

    def alone(word: bytes) -> bytes:
        return np.asarray(tok.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(words: list[bytes], into: dict) -> None:
        plain = []
        for w in words:
            text = w.decode()
            if mark is None or text.split() != [text] or "<|" in text or MARK in text:
                into[w] = alone(w)
            else:
                plain.append((w, text))
        parts = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        lines = tok.encode_batch_fast([f" {MARK} ".join(text for _, text in part) for part in parts], add_special_tokens=False)
        for part, line in zip(parts, lines):
            ids = np.asarray(line.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == mark)).tolist()
            if len(ends) + 1 != len(part):
                into.update((w, alone(w)) for w, _ in part)
                continue
            ids, at = ids.tobytes(), 0
            for (w, _), end in zip(part, [*ends, len(ids)]):
                into[w] = ids[at:end]
                at = end + 4
        state["size"] += sum(len(w) + len(into[w]) + 150 for w in words)

    def ids_of(words: list[bytes]) -> bytes:
        new, old = state["new"], state["old"]
        try:
            return b"".join(map(new.__getitem__, words))
        except KeyError:
            pass
        missing = [w for w in set(words) if w not in new]
        unseen = []
        for w in missing:
            if w in old:
                new[w] = old[w]
                state["size"] += len(w) + len(old[w]) + 150
            else:
                unseen.append(w)
        learn(unseen, new)
        out = b"".join(map(new.__getitem__, words))
        if state["size"] > REMEMBERED:
            state.update(new={}, old=new, size=0)
        return out

    return ids_of


class Windows:
    """At most ``limit`` open sequences; best fit, and the fullest leaves when none fits."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.open, self.closed = length, limit, [], []

    def place(self, size: int, items: list) -> None:
        """``items``: what takes up ``size`` in total and stays together."""
        fits = [w for w in self.open if w[0] + size <= self.length]
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            if len(self.open) >= self.limit:
                fullest = max(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                self.closed.append(fullest)
            best = [0, []]
            self.open.append(best)
        best[0] += size
        best[1].extend(items)
        if best[0] == self.length:
            self.open.remove(best)
            self.closed.append(best)

    def fullest(self) -> list | None:
        return max(self.open, key=lambda w: w[0], default=None)


def pack(docs: DataFrame, locate: Callable[[], str], length: int = 2048, end_id: int = 1, open_windows: int = 64, slack: int = 16, fan_in: int = 32) -> DataFrame:
    """Pack the ids of all texts, each followed by ``end_id``, into sequences of at most ``length`` ids.

    Every partition keeps ``open_windows`` sequences open. Full sequences are cut off long documents; the rest
    goes where it fits best. When it fits nowhere and all windows are in use, the fullest one leaves: as it is if
    at most ``slack`` ids are free, else its free end takes a slice of the new piece, so each sequence that leaves
    is nearly full. The windows left at the end of each partition are merged, ``fan_in`` partitions at a time,
    until one task holds the last ones: ``open_windows`` pieces lists a partition, never the documents themselves.

    Null text counts as empty: one piece of one id. Texts of any length are cut; repeated rows are packed each for
    itself; an empty table gives no rows. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    id_type = field(docs, "doc_id", T.LongType())
    piece = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    schema = T.StructType([*piece.fields, T.StructField("part", T.LongType())])

    def rows_of(windows: list, first: int, part: int | None) -> list[tuple]:
        out = []
        for k, (_, items) in enumerate(windows):
            at = 0
            for doc_id, start, size, crc, total in items:
                out.append((doc_id, start, size, crc, total, first + k, at, part))
                at += size
        return out

    def table(rows: list[tuple]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        columns = list(zip(*rows)) if rows else [[] for _ in to]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, to)], schema=to)

    def scan(batches):
        import zlib

        from pyspark import TaskContext

        ids_of, part = word_tokens(locate), TaskContext.get().partitionId()
        end, windows, made = int(end_id).to_bytes(4, "little"), Windows(length, open_windows), part << 32

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py().encode().split()) + end
                total, at = len(ids) // 4, 0
                piece_of = lambda a, b: (doc_id, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), total)  # noqa: B023, E731
                while total - at >= length:
                    windows.closed.append([length, [piece_of(at, at + length)]])
                    at += length
                if at == total:
                    continue
                top = windows.fullest() if len(windows.open) >= windows.limit else None
                if top and all(w[0] + total - at > length for w in windows.open) and slack < (free := length - top[0]):
                    windows.open.remove(top)
                    windows.closed.append([length, top[1] + [piece_of(at, at + free)]])
                    at += free
                windows.place(total - at, [piece_of(at, total)])
            if windows.closed:
                yield table(rows_of(windows.closed, made, None))
                made += len(windows.closed)
                windows.closed = []
        yield table(rows_of(windows.open, made, part))

    def merger(level: int, last: bool):
        def merge(key, got):
            import pyarrow as pa

            group, held = key[0].as_py(), {}
            for r in got.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                held.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
            windows = Windows(length, open_windows)
            # Single pieces, largest first: best fit then closes small gaps.
            for item in sorted((x for items in held.values() for x in items), key=lambda x: -x[2]):
                windows.place(item[2], [item])
            first = (level << 56) + (group << 28)
            gone, stay = (windows.closed + windows.open, []) if last else (windows.closed, windows.open)
            return pa.Table.from_batches([table(rows_of(gone, first, None) + rows_of(stay, first + len(gone), group))])

        return merge

    found = keep(docs.select("doc_id", text_of().alias("text")).mapInArrow(scan, schema))
    done, left = [found.filter("part is null")], found.filter("part is not null")
    groups, level = left.agg(F.max("part") + 1).first()[0], 0
    while groups is not None:
        groups, level = -(-groups // fan_in), level + 1
        merged = keep(left.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("part").applyInArrow(merger(level, groups == 1), schema))
        done.append(merged.filter("part is null"))
        left = merged.filter("part is not null")
        if groups == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*[f.name for f in piece.fields])
