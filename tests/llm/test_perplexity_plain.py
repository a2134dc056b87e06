"""Bits, thresholds and verdicts of the language model against a plain one."""

import pytest

import brute
from tickloom.llm import perplexity
from test_ops import odd  # noqa: F401 - the awkward rows


def check(docs, labels, least_rows=1):
    rows = [(r.doc_id, r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()]
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} - {None}
    bits = brute.kneser_ney([t for d, _, t in rows if d in good])
    want = []
    for d, lang, t in rows:
        n = len((t or "").encode())
        want.append((d, lang, n, bits(t) / n if n else None))
    limit = brute.bit_limits([(lang, n, per, d in good) for d, lang, n, per in want])
    found = perplexity.classify(docs, labels).collect()
    assert len(found) == len(want) >= least_rows
    key = lambda d, n: (d is not None, d or 0, n)
    for r, (d, lang, n, per) in zip(sorted(found, key=lambda r: key(r.doc_id, r.n_bytes)), sorted(want, key=lambda w: key(w[0], w[2]))):
        assert (r.doc_id, r.n_bytes) == (d, n)
        if per is None:
            assert r.bits_per_byte is None and not r.kept
            continue
        assert r.bits_per_byte == pytest.approx(per, abs=1e-9) and r.perplexity == pytest.approx(2**per)
        assert r.threshold == pytest.approx(limit(lang, n)) and r.kept == (per <= limit(lang, n))


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), 50)


@pytest.mark.parametrize("parts", [1, 3])
def test_awkward_rows(spark, odd, monkeypatch, parts):  # noqa: F811
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in (5, 6, 7, 9, 10, 13, 14, 40, 41, 99)] + [(5, 1), (None, 1)], "doc_id long, quality int")
    short = odd.filter("text is null or length(text) < 5000")
    if parts > 1:
        entries = perplexity.train(perplexity.trusted_text(short, labels)).count()
        monkeypatch.setattr(perplexity, "SHARD_ENTRIES", -(-entries // parts))
    check(short, labels)
