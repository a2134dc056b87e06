"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import field, text_of

KINDS = ["email", "ip", "card", "phone"]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider nets, whose catch is decided by the classifier.
SPELLED = re.compile(r"([A-Za-z0-9._%+-]{1,64})\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?([A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,8})")
#: Every separator that SPELLED accepts between the two parts of an address.
SPELLED_AT = re.compile(r"\(at\)|\[at\]|\x20at(?=\x20)")
NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9][\x20().0-9-]*[0-9](?![0-9A-Za-z])")

#: Gazetteers of name endings, dialling prefixes, issuer prefixes and context words.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl")
DIALLING = ("1", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35")
FOR_WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "telefon", "telefono", "appel"),
}
AGAINST_WORDS = ("version", "isbn", "order", "invoice", "page", "chapter", "section", "token", "build", "release", "figure", "table")

LABELERS = ["strict_pattern", "loose_pattern", "check", "gazetteer", "context_for", "context_against"]
FEATURES = ["has_symbol", "separated", "many_digits", "checked", "listed", "word_for", "word_against", "alone"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, per kind leftmost and without overlap, in the order of KINDS.

    An address is found from its ``@``: the longest run of local characters before it, but not into the address
    before; so long runs without ``@`` cost nothing. Matches that fail a check are passed over whole.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            lo = at
            while lo > done and not LOCAL_END.match(text[lo - 1]):
                lo -= 1
            if lo < at:
                out.append(("email", lo, m.end()))
                done = m.end()
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def spelled_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of SPELLED, leftmost and without overlap, found from their separators."""
    done = 0
    for at in SPELLED_AT.finditer(text):
        end = at.start() - (text[at.start() - 1 : at.start()] == " ")
        lo, least = end, max(done, end - 64)
        while lo > least and not LOCAL_END.match(text[lo - 1]):
            lo -= 1
        m = SPELLED.match(text, lo) if lo < end else None
        if m:
            done = m.end()
            yield m.span()


def gaps_between(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether [a, b) overlaps none of the spans, by binary search in their union."""
    lows, highs = [], []
    for a, b in sorted(spans):
        if highs and a <= highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            lows.append(a)
            highs.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_right(highs, a)
        return k == len(lows) or lows[k] >= b

    return free


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, bool]]:
    """Base spans and those of the wider nets that don't overlap them: (kind, start, end, is base)."""
    yield from ((*s, True) for s in base)
    free = gaps_between([(a, b) for _, a, b in base])
    for span in spelled_spans(text):
        if free(*span):
            yield "email", *span, False
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if 7 <= n <= 19 and free(*m.span()):
            yield "card" if n >= 13 else "phone", *m.span(), False


def describe(text: str, kind: str, start: int, end: int, base: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of LABELERS (1 for, -1 against, 0 abstains) and FEATURES (0 or 1) of a candidate."""
    found = text[start:end]
    digits = "".join(c for c in found if c.isdigit())
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-3:]
    helped, hurt = any(w in FOR_WORDS[kind] for w in before), any(w in AGAINST_WORDS for w in before)
    if kind == "email":
        check = 1 if re.search(r"\w", found.split("@")[0]) else -1
        listed = found.lower().rsplit("dot", 1)[-1].rsplit(".", 1)[-1].strip(" )]") in ENDINGS
    elif kind == "ip":
        check, listed = 1, not found.startswith(("0.", "127.", "255."))
    elif kind == "card":
        check, listed = (1 if luhn(digits) else -1), digits.startswith(ISSUERS)
    else:
        check, listed = (1 if 9 <= len(digits) <= 15 else -1), found[0] == "+" and digits.startswith(DIALLING) or found[0] == "("
    separated = bool(re.search(r"[ ().-]", found.strip("()")))
    votes = (1 if base else -1, 1 if base or separated else -1, check, 1 if listed else -1, int(helped), -int(hurt))
    symbol = "@" in found or found[0] == "+" or found.count(".") == 3
    alone = (start == 0 or text[start - 1].isspace()) and (end == len(text) or text[end] in " \t\n\r.,;:!?")
    return votes, tuple(map(int, (symbol, separated, len(digits) >= 9, check > 0, listed, helped, hurt, alone)))


def fit_votes(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> list[float]:
    """EM for one kind: the probability that a candidate is personal data, for each pattern of votes.

    Each labeler has a chance to vote for, against or not at all, given either class; counts weigh the patterns.
    """
    import numpy as np

    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    post = np.clip((votes.sum(1) + 0.5) / (2 * votes.shape[1]) + 0.5, 0.05, 0.95)
    shown = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        yes, no = n * post, n * (1 - post)
        prior = (yes.sum() + 1) / (n.sum() + 2)
        p_yes = (np.einsum("i,ijk->jk", yes, shown) + 0.1) / (yes.sum() + 0.3)
        p_no = (np.einsum("i,ijk->jk", no, shown) + 0.1) / (no.sum() + 0.3)
        gap = np.einsum("ijk,jk->i", shown, np.log(p_yes) - np.log(p_no)) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
    return post.tolist()


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 30, ridge: float = 0.1) -> list[float]:
    """Logistic regression on features with soft labels: rows (features, label, weight); weights, intercept last."""
    import numpy as np

    x = np.array([(*f, 1) for f, _, _ in rows], float)
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    n /= n.sum() / 1000
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return w.tolist()


def learn(docs: DataFrame) -> dict[str, list[float]]:
    """Weights of the span classifier for each kind, from the votes on every candidate of every document.

    What comes to the driver are counts per pattern of votes and features, of which there are at most
    4 * 3**6 * 2**8 whatever the number of documents.
    """
    schema = f"kind string, votes array<int>, features array<int>, n long"

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        found = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for kind, a, b, base in candidates(text, base_spans(text)):
                    found[(kind, *describe(text, kind, a, b, base))] += 1
        kinds, votes, features = zip(*found) if found else ([], [], [])
        columns = [pa.array(list(kinds), pa.string()), pa.array([list(v) for v in votes], pa.list_(pa.int32())), pa.array([list(f) for f in features], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "votes", "features", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(count, schema).groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    rows = sorted((r.kind, tuple(r.votes), tuple(r.features), r.n) for r in counted.collect())
    out = {}
    for kind in KINDS:
        own = [r[1:] for r in rows if r[0] == kind]
        if own:
            post = fit_votes([(v, n) for v, _, n in own])
            out[kind] = fit_classifier([(f, p, n) for (_, f, n), p in zip(own, post)])
    return out


def find_pii(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans always stay; a wider candidate joins them if the classifier gives it at least ``accept``. ``spans``
    and the hashed base list are ``kind:start:end`` in code points, by kind as in KINDS, then start. Null and empty
    texts have no spans (the hash is that of the empty string); repeated rows are read each for itself; an empty
    table gives no rows. Other columns are not read.
    """
    weights = learn(docs)
    schema = T.StructType([T.StructField("doc_id", field(docs, "doc_id", T.LongType()))] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        import hashlib
        import math

        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                more = []
                for kind, a, b, is_base in candidates(text, base):
                    if not is_base and kind in weights:
                        _, f = describe(text, kind, a, b, False)
                        z = sum(w * x for w, x in zip(weights[kind], (*f, 1)))
                        if 1 / (1 + math.exp(-max(-30, min(30, z)))) >= accept:
                            more.append((kind, a, b))
                show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append((*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(show(base).encode()).hexdigest(), show(every)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), t) for c, t in zip(columns, kinds)], [f.name for f in schema.fields])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
