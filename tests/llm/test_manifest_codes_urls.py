"""Manifest proofs, vector codes and URL filters against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import codes, merkle, queries, urls

CLASH = "tree string, rank long, size long, digest string, path string, d0 string, row string, terms string, score long, code string, error long, part int, low string"
NONE = (None,) * len(CLASH.split(","))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The root and, for each leaf, its segments of siblings."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, place in enumerate(at):
            first = place // 8 * 8
            paths[k].append(("".join(level[first:place]), "".join(level[place + 1 : first + 8])))
            at[k] = place // 8
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = [plain_tree([m[2] for m in sorted(groups[x], key=lambda m: m[:3])]) for x in langs]
    root, above = plain_tree([b[0] for b in built])
    out = []
    for lang, (subroot, paths), over in zip(langs, built, above):
        for (_, _, leaf, r), path in zip(sorted(groups[lang], key=lambda m: m[:3]), paths):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = plain_leaf(*r[:4], lower(r[4])) if altered else leaf
            for left, right in path + over:
                node = h(left, node, right)
            out.append((r[0], leaf, subroot, root, h(*(a + b for a, b in path + over)), node, node == root))
    return sorted(map(str, out))


def check_manifest(df):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert sorted(str(tuple(r)) for r in merkle.verify_manifest(df).collect()) == plain_manifest(rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_manifest_of_documents(spark, sf):
    check_manifest(spark.read.parquet(f"{sf}/documents.parquet"))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 1], [513, 1, 7], [1] * 9 + [70]])
def test_manifest_of_sizes(spark, sizes):
    rows = [(1000 * g + i, f"Text {i}", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check_manifest(spark.createDataFrame(rows, DOCS).repartition(3))


def test_manifest_of_awkward_rows(spark):
    texts = [None, "", "A", "ä:1-", "long " * 200_000, "-", "X", "X"]
    rows = [(i, t, (None, "", "-", "é", "Z")[i % 5], (None, "s")[i % 2], (None, 5)[i % 2]) for i, t in enumerate(texts * 3)]
    rows += [rows[2]] * 70 + [(None, "A", "Z", None, None)] * 2 + [(2, "other", "-", None, None)]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], f"{DOCS}, {CLASH}")
    check_manifest(df)
    empty = merkle.verify_manifest(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == merkle.verify_manifest(df).dtypes


def test_equal_subtrees_are_stored_once(spark):
    df = spark.createDataFrame([("=a", h("x"))] * 128, "tree string, leaf string")
    made = merkle.build(df, ["leaf"])
    assert made.records.groupBy("height").count().count() == made.records.count() == 3
    assert merkle.proofs(made).select("path").distinct().count() > 1


def test_descent_answers_some_requests(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaves = docs.select(F.lit("=").alias("tree"), merkle.leaf_digest(F.col("text")).alias("leaf"), "doc_id")
    made = merkle.build(leaves, ["doc_id"])
    some = made._replace(leaves=made.leaves.filter("rank in (0, 7, 8, 199)"))
    found = merkle.proofs(some).select(merkle.folded(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert len(found) == 4 and {r.root for r in found} == {made.root}


def plain_codes(rows, parts=4, entries=256, rounds=4):
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not usable:
        return []
    longest = max(len(v) for _, v, _ in usable)
    w = -(-longest // parts)
    ints = [[[math.floor(1024 * x) for x in (list(v) + [0] * parts * w)[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in usable]
    order = sorted(range(len(usable)), key=lambda i: (usable[i][0] is None, usable[i][0] or 0, list(usable[i][1])))[:entries]
    books = [[list(ints[i][p]) for i in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(own)] for own in ints]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [x[p] for x, c in zip(ints, chosen) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    chosen, total = assign(), defaultdict(int)
    errors = [min(sum(d for d, _ in c), 2**63 - 1) for c in chosen]
    for (_, _, label), e in zip(usable, errors):
        total[label] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in c), e, min(total[r[2]], 2**63 - 1), sha) for r, c, e in zip(usable, chosen, errors)]


def check_codes(df, **how):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(str(tuple(r)) for r in codes.compress(df, **how).collect()) == sorted(map(str, plain_codes(rows, **how)))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_of_embeddings(spark, sf):
    check_codes(spark.read.parquet(f"{sf}/embeddings.parquet"), entries=40)


@pytest.mark.parametrize("dims", [4, 12, 20, 64])
def test_codes_of_ties_and_clusters(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.randrange(-2, 3) / 4 for _ in range(dims)], rng.randrange(3)) for i in range(120)]
    check_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=9)


def test_codes_of_awkward_rows(spark):
    rows = [
        (5, [0.1, -0.1, 0.2, 9.0], None), (5, [0.1, -0.1, 0.2, 9.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1), (3, None, 1), (4, [1.0, None, 1.0, 1.0], 1), (6, [math.nan, 1.0, 1.0, 1.0], 1),
        (7, [math.inf, 1.0, 1.0, 1.0], 1), (8, [], 2), (9, [0.5], 2), (10, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None), (11, [3e38, -3e38, 1e20, -1e-40], 3), (12, [3e38, -2e38, 1e20, 1e-40], 3),
    ]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], f"{VECTORS}, {CLASH}")
    check_codes(df)
    check_codes(df, entries=3)
    check_codes(df.filter("vec_id < 9"))
    for none in (df.limit(0), df.filter("vec_id in (3, 4, 6, 7)")):
        empty = codes.compress(none)
        assert empty.count() == 0 and empty.dtypes == codes.compress(df).dtypes


def test_spectra_keep_distances_and_order():
    rng = np.random.default_rng(1)
    for width in (1, 2, 8, 16):
        signs = codes.spectrum(np.eye(width, dtype=np.int64)).T
        changes = [(np.diff(r) != 0).sum() for r in signs]
        assert changes == list(range(width))
    x, e = rng.integers(-50, 50, (300, 13)), rng.integers(-50, 50, (40, 13))
    want = ((x[:, None] - e[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        index, distance = codes.nearest(codes.spectrum(x.astype(kind)), codes.spectrum(e.astype(kind)))
        assert (index == want.argmin(1)).all() and (distance == want.min(1)).all()


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = lower(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    rule, verdict = None, None
    for v, text in urls.RULES:
        own, start = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and len(text) > len(rule or ""):
            rule, verdict = text, v
    text, score = lower((url or "").split("?")[0].split("#")[0]), 0
    for term, weight in urls.VOCABULARY.items():
        at = [k for k in range(len(text)) if text.startswith(term, k)]
        score += weight * any(not "a" <= text[k - 1 : k] <= "z" and not "a" <= text[k + len(term) : k + len(term) + 1] <= "z" for k in at)
    return host, path, rule, verdict or ("block" if score >= urls.LIMIT else "allow")


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/", "https://a.example.org/es/1", "https://example.org/en/12#x", "http://notexample.org/es/", "http://org/x", "http://x.com/fr/",
    "http://x.com/de/?q", "http://com/de/1", "http://x.com/FR/", "http://x.net?/de/", "http://essex.net/", "http://sex.net/", "http://hot-sex.net/", "http://PORN1.net/", "http://x.net/?q=porn", "http://x.net/#porn",
    "free/cheap/pills", "http://a.net://b.org/fr/", "://x.org/", "http://x.org:80/", "http://é.com/fr/ä", "http://x.net/" + "a" * 100_000 + "/casino", "http://x.net/free_free", "xxx", "http://x.net/\n/bets-free", "http://x.com/fr/porn",
]


def test_urls(spark, sf):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.org/"), (5, URLS[5]), (5, URLS[5])]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], f"page_id long, url string, {CLASH}")
    for pages in (df, spark.read.parquet(f"{sf}/pages.parquet")):
        want = [(r.page_id, *plain_url(r.url)) for r in pages.collect()]
        found = urls.judge_urls(pages)
        assert sorted(str(tuple(r)) for r in found.select("page_id", "host", "path", "rule", "verdict").collect()) == sorted(map(str, want))
    assert urls.judge_urls(df.limit(0)).count() == 0
    only = urls.judge_urls(df, rules=(), vocabulary={}).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in only] == [(None, "allow")]


def test_listed_hosts_are_blocked(spark):
    bad = [f"http://{h}.example.net/en/2" for h in ("casino-win", "free-bets", "adult-x", "cheap-pills", "spam-farm", "ads-track", "www.hot-dating")]
    good = [f"http://{h}.example.net/en/2?ref=x" for h in ("freedom", "windows", "adulthood-care", "live", "thecasinos1x1st", "bettor", "trackside")]
    found = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")).collect()}
    assert [found[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_queries_have_sql():
    assert {"op11_manifest", "op12_codes", "op13_urls"} <= queries.SQL.keys() & queries.QUERIES.keys()
