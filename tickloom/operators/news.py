"""Article de-duplication, novelty, classification, price reaction and news state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import blocks
from tickloom.session import cut_lineage

# Elasticity per event type and forecast horizons in seconds.
ELASTICITY = {"M_AND_A": 3.5, "EARNINGS": 2.5, "MACRO_FED": 2.0, "REGULATORY_LEGAL": 1.2, "ANALYST_ACTION": 0.8, "GENERAL_MARKET": 0.4}
HORIZONS = [0.0, 300.0, 900.0, 3600.0, 14400.0, 86400.0, 259200.0]


def with_hash(articles: DataFrame) -> DataFrame:
    return articles.withColumn("article_hash", text.article_hash(F.col("source"), F.col("headline"), F.col("summary")))


def first_per_hash(articles: DataFrame) -> DataFrame:
    """The earliest article of every content hash; copies combine map-side."""
    rest = [c for c in articles.columns if c != "article_hash"]
    first = articles.groupBy("article_hash").agg(F.min_by(F.struct(*rest), F.struct("available_ns", "article_id")).alias("_a"))
    return first.select("article_hash", *[F.col(f"_a.{c}").alias(c) for c in rest])


def novelty(articles: DataFrame, horizon_s: float = 7200.0, history: int = 2000) -> DataFrame:
    """exp(-2·max Jaccard) against the headlines seen shortly before; exact copies 0.1, no words 1.0.

    The history holds at most ``history`` distinct articles, so an article is compared
    with a bounded number of others. Distinct articles are numbered by arrival and cut
    into blocks of that length with one history of overlap; each block is compared in one
    bounded task.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("headline"), F.lit("([a-z0-9]+)"), F.lit(1)))
    # the texts are read once; below only words and numbers move
    hashed = cut_lineage(with_hash(articles.withColumn("words", words)).select("article_id", "available_ns", "article_hash", "words"))
    # without words an article is always new and never joins the history
    fresh = hashed.groupBy("article_hash").agg(F.min(F.struct("available_ns", "article_id", F.size("words").alias("n"))).alias("_f")).filter(
        "_f.n > 0").select(F.lit("a").alias("_all"), "_f.article_id", "_f.available_ns")
    seq = blocks.index_rows(cut_lineage(fresh), ["_all"], ["available_ns", "article_id"], blocks.Rows())
    seq = cut_lineage(seq.select("article_id", "available_ns", "seq", F.expr(f"(seq - 1) div {history}").alias("_home")))
    horizon = int(horizon_s * 1e9)
    # only the rows that the next block's first article still reaches go there too
    opening = seq.groupBy((F.col("_home") - 1).alias("_home")).agg(F.min("available_ns").alias("_next"))
    reaches = F.col("_next") - F.col("available_ns") < horizon
    placed = seq.join(opening, "_home", "left").withColumn("_at", F.when(reaches, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    spread = hashed.select("article_id", "words").join(placed.drop("_next"), "article_id").withColumn("_at", F.explode("_at"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seqs, at = pdf["seq"].to_numpy(), pdf["available_ns"].to_numpy()
        sizes = np.array([len(w) for w in pdf["words"]])
        mine = (pdf["_home"] == pdf["_at"]).to_numpy()
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ids, known = pd.factorize(np.concatenate(pdf["words"].to_numpy()))
        named = np.zeros(len(known), dtype=bool)
        out = np.zeros(len(pdf))
        for k in np.flatnonzero(mine):
            lo = max(np.searchsorted(seqs, seqs[k] - history), np.searchsorted(at, at[k] - horizon, side="right"))
            if lo < k:
                own = ids[starts[k]:ends[k]]
                named[own] = True
                shared = np.add.reduceat(named[ids[starts[lo]:starts[k]]], starts[lo:k] - starts[lo], dtype=np.int64)
                named[own] = False
                out[k] = (shared / (sizes[k] + sizes[lo:k] - shared)).max()
        return pd.DataFrame({"article_id": pdf["article_id"], "jaccard": out})[mine]

    scored = spread.groupBy("_at").applyInPandas(best, "article_id long, jaccard double")
    value = F.least(F.greatest(F.exp(-2.0 * F.col("jaccard")), F.lit(0.1)), F.lit(1.0))
    joined = hashed.select("article_id", F.size("words").alias("_n")).join(scored, "article_id", "left")
    return joined.select("article_id", F.when(F.col("_n") == 0, 1.0).when(F.col("jaccard").isNull(), 0.1).otherwise(value).alias("novelty"))


def classify(articles: DataFrame, proxy: bool = True) -> DataFrame:
    """One row per (article, ticker): polarity, event type, urgency, novelty, centrality, shock."""
    # each text is folded once: columns with several uses stay columns
    staged = articles.withColumns({
        "_h": F.upper("headline"), "_s": F.upper("summary"), "_rule": text.event_rule(F.col("headline"), F.col("summary"), F.col("source"))})
    kind, urgency = text.rule_columns(F.col("_rule"))
    scored = staged.withColumns({"polarity": text.polarity(F.concat_ws(". ", "headline", "summary")), "event_type": kind, "urgency": urgency})
    scored = scored.withColumn("_c", text.centrality_of(F.col("_h"), F.col("_s"), F.col("tickers"), F.col("event_type"), proxy))
    out = scored.drop("headline", "summary", "tickers", "_h", "_s", "_rule").join(novelty(articles), "article_id")
    # outer: a plain explode filters by its array first and so evaluates all rules on the texts once more
    out = out.withColumn("_x", F.explode_outer("_c")).filter(F.col("_x").isNotNull()).withColumns({
        "ticker": F.col("_x.ticker"), "centrality": F.col("_x.centrality")})
    shock = F.col("polarity") * F.col("urgency") * F.col("novelty") * F.col("centrality")
    return out.withColumn("shock", F.least(F.greatest(shock, F.lit(-1.0)), F.lit(1.0))).drop("_c", "_x")


def elasticity(kind: Column) -> Column:
    out = F.lit(0.4)
    for name, g in ELASTICITY.items():
        out = F.when(kind == name, g).otherwise(out)
    return out


def predict(classified: DataFrame, market: DataFrame | None = None, barrier: float = 2.0, lam: float = 1.5,
            default_price: float = 100.0, default_vol: float = 0.02) -> DataFrame:
    """Expected move, target, probability, barriers, signal and confidence per classified row.

    ``market`` has ticker, price and volatility; missing tickers use the defaults.
    """
    if market is None:
        joined = classified.withColumns({"price": F.lit(default_price), "volatility": F.lit(default_vol)})
    else:
        joined = classified.join(market, "ticker", "left").withColumns({
            "price": F.coalesce("price", F.lit(default_price)), "volatility": F.coalesce("volatility", F.lit(default_vol))})
    p, v, s = F.col("price"), F.col("volatility"), F.col("shock")
    g = elasticity(F.col("event_type"))
    z = F.least(F.greatest(-(lam * s * g) / F.greatest(v, F.lit(1e-5)), F.lit(-50.0)), F.lit(50.0))
    up = F.col("prob_up")
    return joined.withColumns({
        "expected_delta": p * g * s * v, "prob_up": 1.0 / (1.0 + F.exp(z)),
        "barrier_upper": p * F.exp(barrier * v), "barrier_lower": p * F.exp(-barrier * v),
    }).withColumns({
        "target_price": p + F.col("expected_delta"),
        "signal": F.when(up >= 0.65, "BUY").when(up <= 0.35, "SELL").otherwise("NEUTRAL"),
        "confidence": F.least(F.greatest(2.0 * F.abs(up - 0.5), F.lit(0.0)), F.lit(1.0)),
    })


def trajectory(predictions: DataFrame, horizons: Sequence[float] = HORIZONS) -> DataFrame:
    """Predicted price at each horizon after the event."""
    rows = predictions.withColumn("horizon_s", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    return rows.withColumn("path_price", F.col("price") + F.col("expected_delta") * text.decay(F.col("horizon_s"), F.col("urgency")))


def forward_priors(predictions: DataFrame, order: Sequence[str]) -> DataFrame:
    """2·(prob_up - 0.5) of each ticker's last prediction."""
    return predictions.groupBy("ticker").agg(F.max_by(2.0 * (F.col("prob_up") - 0.5), F.struct(*order)).alias("prior"))


def projection_matrix(n_src: int, dim: int = 16) -> np.ndarray:
    """Gaussian projection with the fixed seed 42."""
    return np.random.default_rng(42).normal(0, 1.0 / np.sqrt(dim), size=(n_src, dim))


def project(events: DataFrame, n_src: int, dim: int = 16) -> DataFrame:
    """Unit-length projection of the embedding followed by the five scalar features."""
    dense = F.col("embedding").cast("array<double>")
    if n_src <= dim:
        flat = F.concat(dense, F.array_repeat(F.lit(0.0), dim - n_src))
    else:
        m = projection_matrix(n_src, dim)
        cols = [F.array(*[F.lit(float(x)) for x in m[:, j]]) for j in range(dim)]
        flat = F.array(*[F.aggregate(F.zip_with(dense, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in cols])
    staged = events.withColumn("_p", flat)
    norm = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 1e-8, F.transform("_p", lambda x: x / F.col("_n"))).otherwise(F.col("_p"))
    scalars = F.array(*[F.col(c).cast("double") for c in ("polarity", "subjectivity", "novelty", "urgency", "centrality")])
    return staged.withColumn("_n", norm).withColumn("features", F.concat(unit, scalars)).drop("_p", "_n")


def active_state(events: DataFrame, step_ns: int, features: str = "features", horizon_ns: int = 604_800_000_000_000) -> DataFrame:
    """Decayed feature sums and event counts per asset on a regular as-of grid.

    Each (event, asset) row is sent to the grid times within the horizon after it, so no
    range join is needed; vector components are summed map-side first.
    """
    first = F.expr(f"(ts_ns + {step_ns - 1}L) div {step_ns}")
    last = F.expr(f"(ts_ns + {horizon_ns}L) div {step_ns}")
    at = events.withColumn("asof_ns", F.explode(F.transform(F.sequence(first, last), lambda k: k * F.lit(step_ns))))
    lag = (F.col("asof_ns") - F.col("ts_ns")) / 1e9
    w = at.withColumn("_w", F.col("centrality") * text.decay(lag, F.col("urgency")))
    parts = w.select("asset_id", "asof_ns", "_w", F.posexplode(features).alias("pos", "x"))
    return parts.groupBy("asset_id", "asof_ns", "pos").agg(F.sum(F.col("_w") * F.col("x")).alias("value"), F.count(F.lit(1)).alias("n_events"))


def state_vectors(state: DataFrame) -> DataFrame:
    """Long state to one ordered vector per asset and as-of time."""
    return state.groupBy("asset_id", "asof_ns").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("state"),
        F.max("n_events").alias("n_events"))


def ingest_edges(events: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ticker weights exploded to edges, and the asset table with unknown tickers added."""
    edges = events.select("event_id", F.explode("ticker_weights").alias("t", "centrality")).select(
        "event_id", F.upper("t").alias("ticker"), "centrality")
    new = edges.select("ticker").distinct().join(assets, "ticker", "left_anti").select(
        "ticker", F.col("ticker").alias("name"), F.lit("UNKNOWN").alias("sector"), F.lit(True).alias("is_active"))
    return edges, assets.unionByName(new)
