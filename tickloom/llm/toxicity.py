"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import field, keep, text_of

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
CLAUSE_END = frozenset(".!?;:,\n")

#: Word classes of the grammar in English, German, French and Spanish. Insults are learned.
THREATS = frozenset("kill hurt destroy beat shoot stab burn crush töten umbringen schlagen vernichten verletzen tuer frapper détruire brûler blesser matar golpear destruir quemar herir".split())
TARGETS = frozenset("you your yours he she they him her them his their u du dich dir ihr euch sie er tu toi te vous il elle ils eux usted ustedes ti él ella ellos".split())
NEGATIONS = frozenset("not no never nobody neither nor without dont isnt arent nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni sin".split())
REPORTS = frozenset("said says say told wrote claimed called calls quoted reported according sagte sagt schrieb nannte behauptete dit disait appelle écrit affirmé dijo dice escribió llamó afirmó".split())

PREFIXES = (4, 5, 6)
FEATURES = ["strongest", "plain", "targeted", "negated", "reported", "threats", "dense"]


def patterns(word: str) -> list[str]:
    """What a word may be known by: itself, or its first letters and any ending."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class Grammar:
    """Four transducers run one after the other over the tokens of a clause.

    The first writes word classes: an insult with its weight, a threat, a target, a negation, a verb of saying, or
    nothing. The second turns insults and threats up to three tokens after a negation into negated ones. The third
    turns those after a verb of saying into reported ones. The last raises what remains to targeted if the clause
    has a target; a threat counts only then. A clause without an insult or a threat is not read at all.
    """

    def __init__(self, insults: dict[str, float]):
        self.words = {p: w for p, w in insults.items() if p[-1] != "*"}
        self.stems = {p[:-1]: w for p, w in insults.items() if p[-1] == "*"}

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if len(word) > PREFIXES[0]:
            for n in PREFIXES:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def classify(self, clause: list[str]) -> list[tuple[str, float]]:
        out = []
        for w in clause:
            weight = self.weight(w)
            kind = "insult" if weight else "threat" if w in THREATS else "target" if w in TARGETS else "negation" if w in NEGATIONS else "report" if w in REPORTS else ""
            out.append((kind, weight or 1.0))
        return out

    @staticmethod
    def negate(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
        out, left = [], 0
        for kind, weight in tape:
            out.append(("negated", weight) if left and kind in ("insult", "threat") else (kind, weight))
            left = 3 if kind == "negation" else max(0, left - 1)
        return out

    @staticmethod
    def report(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
        out, said = [], False
        for kind, weight in tape:
            out.append(("reported", weight) if said and kind in ("insult", "threat") else (kind, weight))
            said |= kind == "report"
        return out

    @staticmethod
    def aim(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
        at_someone = any(kind == "target" for kind, _ in tape)
        return [("targeted", w) if k == "insult" and at_someone else ("", w) if k == "threat" and not at_someone else (k, w) for k, w in tape]

    def features(self, text: str) -> list[float]:
        """The values of FEATURES for a whole text."""
        import math

        tokens = TOKEN.findall(text.lower())
        known = {w for w in set(tokens) if w in THREATS or self.weight(w)}
        sums = dict.fromkeys(("insult", "targeted", "negated", "reported", "threat"), 0.0)
        strongest = 0.0
        if known:
            clause, wanted = [], False
            for t in [*tokens, "."]:
                if t not in CLAUSE_END:
                    clause.append(t)
                    wanted |= t in known
                    continue
                if wanted:
                    score = 0.0
                    for kind, weight in self.aim(self.report(self.negate(self.classify(clause)))):
                        if kind in sums:
                            sums[kind] += weight
                            score += weight if kind in ("insult", "targeted", "threat") else 0.0
                    strongest = max(strongest, score)
                clause, wanted = [], False
        hits = sums["insult"] + sums["targeted"] + sums["threat"]
        logs = [math.log1p(sums[k]) for k in ("insult", "targeted", "negated", "reported", "threat")]
        return [math.log1p(strongest), *logs, 100 * hits / (len(tokens) + 20)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, half) of at most ``most`` labelled rows that may be learned from, chosen by a hash of doc_id.

    A doc_id with several labels counts as toxic if one of them says so. The bound on the ids bounds the broadcast.
    """
    known = labels.filter(~held_out(F.col("doc_id"))).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("id"), "toxic")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return rows.select("text", F.col("toxic").cast("long").alias("toxic"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).alias("half"))


def learn_insults(sample: DataFrame, least_docs: int = 5, least_gain: float = 20.0, most: int = 4096) -> dict[str, float]:
    """Weighted word and stem patterns that mark toxic texts: log odds of a text with the pattern being toxic.

    A pattern needs ``least_docs`` toxic texts and a log-likelihood ratio of ``least_gain``; the ``most`` best are taken.
    """

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        found = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = {w for w in TOKEN.findall(text.as_py().lower()) if len(w) > 2}
                found[toxic > 0].update({p for w in words for p in patterns(w)})
        keys = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())] + [pa.array([c[k] for k in keys], pa.int64()) for c in found], ["pattern", "clean", "toxic"])

    sizes = {bool(r.toxic): r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return {}
    # Patterns of toxic texts first: the many words of clean texts alone need no shuffle.
    in_toxic = sample.filter("toxic > 0").mapInArrow(count, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("toxic").alias("a")).filter(F.col("a") >= least_docs)
    wanted = {r.pattern: r.a for r in in_toxic.collect()}  # at most the words of the bounded sample

    def count_clean(batches):
        from collections import Counter

        import pyarrow as pa

        found = Counter()
        for batch in batches:
            for text in batch.column("text"):
                words = {w for w in TOKEN.findall(text.as_py().lower()) if len(w) > 2}
                found.update({p for w in words for p in patterns(w) if p in wanted})
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    clean = {r.pattern: r.n for r in sample.filter("toxic = 0").mapInArrow(count_clean, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}

    def gain(a: int, b: int) -> float:
        import math

        total, share, out = pos + neg, (a + b) / (pos + neg), 0.0
        for seen, size in ((a, pos), (b, neg)):
            for k, expected in ((seen, size * share), (size - seen, size * (1 - share))):
                out += k * math.log(k / expected) if k and expected else 0.0
        return 2 * out if total else 0.0

    import math

    scored = []
    for p, a in wanted.items():
        b = clean.get(p, 0)
        weight = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
        if weight > 1.5 and gain(a, b) >= least_gain:
            scored.append((gain(a, b), p, weight))
    return {p: w for _, p, w in sorted(scored, reverse=True)[:most]}


def fit_scores(rows: list[tuple[list[float], int]], ridge: float = 1.0, steps: int = 40) -> list[float]:
    """Logistic regression on FEATURES, intercept last. Without two classes it gives their smoothed share."""
    import numpy as np

    y = np.array([t for _, t in rows], float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return [0.0] * len(FEATURES) + [float(np.log(share / (1 - share)))]
    x = np.array([[*f, 1.0] for f, _ in rows])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3), and FEATURES.

    At most ``most_labelled`` labelled rows are learned from, none of them held out. The weights of the clause
    features come from each half under the insult patterns of the other half, so that they don't trust patterns
    learned from the same texts; the patterns of all rows then score every whole text. Null texts count as
    empty and score as texts without a hit; a null doc_id is not held out; repeated rows are scored each; an empty
    table gives no rows, and without usable labels all scores are alike.
    """
    sample = keep(labelled(docs, labels, most_labelled))
    insults = learn_insults(sample)
    schema = T.StructType([T.StructField("doc_id", field(docs, "doc_id", T.LongType())), T.StructField("score", T.DoubleType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES])

    def measured(part: DataFrame, patterns: dict[str, float]) -> list[tuple[list[float], int]]:
        def measure(batches):
            import pyarrow as pa

            grammar = Grammar(patterns)
            for batch in batches:
                rows = [grammar.features(t.as_py()) for t in batch.column("text")]
                columns = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", *FEATURES])

        found = part.select("text", "toxic").mapInArrow(measure, "toxic long, " + ", ".join(f"{f} double" for f in FEATURES))
        return [([r[f] for f in FEATURES], int(r.toxic > 0)) for r in found.collect()]  # one row per row of the bounded sample

    halves = [sample.filter(f"half = {k}") for k in (0, 1)]
    weights = fit_scores(measured(halves[1], learn_insults(halves[0])) + measured(halves[0], learn_insults(halves[1])))

    def score(batches):
        import math

        import pyarrow as pa

        grammar = Grammar(insults)
        for batch in batches:
            rows = [grammar.features(t.as_py()) for t in batch.column("text")]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, [*f, 1.0])))))) for f in rows]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), *columns], ["doc_id", "score", *FEATURES])

    scored = docs.select("doc_id", text_of().alias("text")).mapInArrow(score, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"), *FEATURES)
