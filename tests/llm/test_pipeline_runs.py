"""The five stages and run() against brute force, on the smallest table, on awkward rows and on none."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from tickloom.llm import queries
from test_ops import odd  # noqa: F401 - the awkward rows


@pytest.fixture(scope="module")
def ids():
    tok = Tokenizer.from_file(queries.word_bpe())

    def of(text):
        return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")

    return of


def check_pieces(pieces, texts, copies, ids):
    """Each id of each copy lies in one piece, pieces hold what they say, sequences have no gap."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p.doc_id].append(p)
        per_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(per_doc) == {d for d, c in copies.items() if c}
    for d, found in per_doc.items():
        have = ids(texts[d])
        covered = Counter()
        for p in found:
            assert p.doc_tokens == len(have) and p.ids_crc32 == zlib.crc32(have[p.start : p.start + p.length].tobytes())
            covered.update(range(p.start, p.start + p.length))
        assert covered == dict.fromkeys(range(len(have)), copies[d]), d
    for parts in per_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_stages_and_run_against_brute_force(spark, sf, ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, columns, by_stage = docs.collect(), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in rows]
        after = stage(spark, spark.createDataFrame(rows, docs.schema), sf)
        found = after.collect()
        got = Counter(r.doc_id for r in found)
        if name == "quality rules":
            kept = brute.good([(r.lang, r.source, r.text) for r in rows])
            assert got == Counter(r.doc_id for r, k in zip(rows, kept) if k)
        elif name == "exact dedup":
            assert got == Counter(d for d, v in brute.exact(before).items() if v[2])
        elif name == "near dedup":
            assert got == Counter({c for _, c in brute.near(before, 5).values()})
        elif name == "mixing":
            assert not brute.mix_errors({r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in rows}, got)
        else:
            texts = dict(before)
            check_pieces(found, texts, Counter(d for d, _ in before), ids)
        if name != "packing":
            assert after.columns == columns
            rows, by_stage[name] = found, got
    # the whole run takes the same documents as often as the stages one by one
    check_pieces(corpus_pipeline.run(spark, sf).collect(), texts, by_stage["mixing"], ids)


def test_run_on_awkward_rows(spark, odd, ids, tmp_path):  # noqa: F811
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = odd.collect()
    texts = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(p.doc_id for p in pieces if p.start == 0)
    fit = {r.doc_id for r, k in zip(rows, brute.good([(r.lang, r.source, r.text) for r in rows])) if k}
    assert pieces and set(copies) <= fit and max(copies.values()) <= 2
    check_pieces(pieces, texts, copies, ids)


def test_run_without_rows(spark, odd, tmp_path):  # noqa: F811
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "ids_crc32" in found.columns
