"""Registered queries: news ingest, scoring, prediction and state."""

from __future__ import annotations

from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import news
from tickloom.plans.catalog_series import rounded
from tickloom.sources import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


# Lead-in added to each document's first line, so that the fixed lexicon and names occur.
PHRASES = [
    "Apple beats earnings", "Fed signals rate cut", "NVDA loss narrowed sharply", "Tesla failed to deliver growth", "Market wrap",
    "Microsoft won't miss guidance", "Probe into Amazon fraud", "Broker upgrade for JPM", "Meta acquisition deal", "Weak demand is not negative",
]


def articles(spark, d):
    """Documents as articles: lead-in plus first line is the headline, the rest the summary."""
    docs = fx.table(spark, d, "documents")
    lead = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    line = F.substring_index(F.col("text"), "\n", 1)
    return docs.select(
        F.col("doc_id").alias("article_id"), F.concat(lead, F.lit(" "), line).alias("headline"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("summary"),
        "source", (F.col("doc_id") * 60_000_000_000).alias("available_ns"),
    ).withColumn("tickers", text.tickers(F.concat_ws(" ", "headline")))


ART = f"""art AS (SELECT doc_id AS article_id, ([{', '.join("'" + p.replace("'", "''") + "'" for p in PHRASES)}])[1 + doc_id % {len(PHRASES)}] || ' ' || split_part(text, chr(10), 1) AS headline,
  substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary, source, doc_id * 60000000000 AS available_ns FROM documents)"""


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The rule of html.unescape: a text is cut at its ampersands; each piece starts with a number, with the longest known name, or stays.
ENT = f"""ent(name, value) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(v)})' for n, v in html5.items())}),
odd(c, v) AS (VALUES {', '.join(f'({c}, {ord(v)})' for c, v in _invalid_charrefs.items())}),
clean AS (SELECT page_id, row_number() OVER () AS r, string_split(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&') AS ps FROM pages),
pieces AS (SELECT page_id, r, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM clean),
refs AS (SELECT *, CASE WHEN i > 1 THEN regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)') ELSE '' END AS s FROM pieces),
digits AS (SELECT *, s[1] = '#' AS numeric, s[2] IN ('x', 'X') AS hex, ltrim(regexp_replace(s, '[#xX;]', '', 'g'), '0') AS dg FROM refs),
coded AS (SELECT *, CASE WHEN NOT numeric THEN NULL WHEN dg = '' THEN 0 WHEN length(dg) > 8 THEN 1114112 WHEN hex THEN ('0x' || dg)::BIGINT ELSE dg::BIGINT END AS c FROM digits),
known AS (SELECT r, i, max(k) AS n, arg_max(value, k) AS value FROM (SELECT r, i, s, unnest(range(2, length(s) + 1)) AS k FROM refs WHERE length(s) > 1) q JOIN ent ON ent.name = left(q.s, k) GROUP BY 1, 2),
plain AS (SELECT page_id, r, string_agg(CASE WHEN i = 1 THEN p
    WHEN numeric THEN CASE WHEN odd.v IS NOT NULL THEN chr(odd.v::INT) WHEN coded.c BETWEEN 55296 AND 57343 OR coded.c > 1114111 THEN chr(65533)
      WHEN coded.c IN ({', '.join(str(c) for c in sorted(_invalid_codepoints))}) THEN '' ELSE chr(coded.c::INT) END || substr(p, length(s) + 1)
    WHEN n IS NOT NULL THEN value || substr(p, n + 1) ELSE '&' || p END, '' ORDER BY i) AS t
  FROM coded LEFT JOIN known USING (r, i) LEFT JOIN odd ON odd.c = coded.c GROUP BY 1, 2)"""
WIDE = r"[\s\x0B\x{a0}\x{1c}-\x{1f}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("html_clean", f"WITH {ENT} SELECT page_id, trim(regexp_replace(t, '{WIDE}', ' ', 'g')) AS body FROM plain")
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("body"))


TICK = "[" + ", ".join(f"CASE WHEN contains(upper(headline), '{c}') THEN '{t}' END" for c, t in text.COMPANIES.items()) + "]"
KNOWN = "[" + ", ".join(f"'{t}'" for t in sorted(set(text.COMPANIES.values()))) + "]"


@query("ticker_extract", f"""WITH {ART} SELECT article_id, array_to_string(list_sort(list_distinct(list_concat(list_filter({TICK}, lambda x: x IS NOT NULL),
  list_intersect(regexp_extract_all(headline, '\\b([A-Z]{{1,5}})\\b', 1), {KNOWN})))), ',') AS tickers FROM art""")
def _(spark, d):
    return articles(spark, d).select("article_id", F.array_join("tickers", ",").alias("tickers"))


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
HASH = f"sha256(lower(trim(source, {WS})) || '|' || lower(trim(headline, {WS})) || '|' || lower(trim(summary, {WS})))"


@query("article_dedup", f"""WITH {ART}, h AS (SELECT article_id % 700 AS k, {HASH} AS article_hash, article_id, available_ns FROM art)
SELECT article_hash, min(article_id) AS article_id, count(*) AS copies FROM h GROUP BY 1""")
def _(spark, d):
    a = news.with_hash(articles(spark, d))
    copies = a.groupBy("article_hash").agg(F.count(F.lit(1)).alias("copies"))
    return news.first_per_hash(a).join(copies, "article_hash").select("article_hash", "article_id", "copies")


POL = f"""tk AS (SELECT article_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(lower(headline || '. ' || summary), 'n''t\\b', ' not', 'g'), '''s\\b', '', 'g'), '[a-z0-9]+')) AS w,
    generate_subscripts(regexp_extract_all(regexp_replace(regexp_replace(lower(headline || '. ' || summary), 'n''t\\b', ' not', 'g'), '''s\\b', '', 'g'), '[a-z0-9]+'), 1) AS i FROM art),
fl AS (SELECT article_id, i, w IN {_in(text.POSITIVE)} AS p, w IN {_in(text.NEGATIVE)} AS n, w IN {_in(text.NEGATION)} AS ng, w IN {_in(text.INVERSION)} AS iv FROM tk),
cx AS (SELECT *, max(ng::INT) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS neg,
  max(iv::INT) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS ib, max(iv::INT) OVER (PARTITION BY article_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ia FROM fl),
sc AS (SELECT article_id, sum(CASE WHEN p AND coalesce(neg, 0) = 0 THEN 1.0 WHEN NOT p AND n AND (coalesce(neg, 0) + coalesce(ib, 0) + coalesce(ia, 0)) > 0 THEN 0.8 ELSE 0.0 END)::DOUBLE AS np,
  sum(CASE WHEN p AND neg = 1 THEN 1.0 WHEN NOT p AND n AND (coalesce(neg, 0) + coalesce(ib, 0) + coalesce(ia, 0)) = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS nn FROM cx GROUP BY 1),
pol AS (SELECT article_id, CASE WHEN np + nn = 0 THEN 0 ELSE (np - nn) / (np + nn + 1e-6) END AS polarity FROM sc)"""


@query("lexicon_polarity", f"WITH {ART}, {POL} SELECT article_id, round(polarity, 6) AS polarity FROM pol")
def _(spark, d):
    return articles(spark, d).select("article_id", F.round(text.polarity(F.concat_ws(". ", "headline", "summary")), 6).alias("polarity"))


@query("headline_polarity", f"""WITH {ART}, w AS (SELECT article_id, unnest(regexp_split_to_array(lower(headline), '\\s+')) AS w FROM art),
c AS (SELECT article_id, trim(w, '.,!?;:"''()[]{{}}') AS w FROM w),
s AS (SELECT article_id, count(*) FILTER (w IN {_in(text.POSITIVE)}) AS p, count(*) FILTER (w IN {_in(text.NEGATIVE)}) AS n FROM c GROUP BY 1)
SELECT article_id, round(CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END, 6) AS polarity FROM s""")
def _(spark, d):
    return articles(spark, d).select("article_id", F.round(text.headline_polarity(F.col("headline")), 6).alias("polarity"))


def _event_case(what: int) -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains(b, {chr(39)}{w}{chr(39)})' for w in words)} THEN {repr(name) if what == 0 else u}"
        for name, u, words in text.EVENT_RULES)
    return f"CASE {arms} ELSE {repr('GENERAL_MARKET') if what == 0 else 0.3} END"


EVT = f"""evt AS (SELECT article_id, {_event_case(0)} AS event_type, {_event_case(1)}::DOUBLE AS urgency FROM (SELECT article_id, lower(headline || ' ' || summary) AS b FROM art))"""


@query("event_type", f"WITH {ART}, {EVT} SELECT * FROM evt")
def _(spark, d):
    kind, u = text.event_type(F.col("headline"), F.col("summary"), F.col("source"))
    return articles(spark, d).select("article_id", kind.alias("event_type"), u.alias("urgency"))


NOV = f"""hs AS (SELECT article_id, available_ns, {HASH} AS hash, list_distinct(regexp_extract_all(lower(headline), '[a-z0-9]+')) AS ws FROM art),
fr AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY hash ORDER BY available_ns, article_id) = 1),
jc AS (SELECT a.article_id, max(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))) AS j FROM fr a
  JOIN fr b ON b.available_ns < a.available_ns AND a.available_ns - b.available_ns < 7200000000000 GROUP BY 1),
nov AS (SELECT h.article_id, CASE WHEN f.article_id IS NULL THEN 0.1 WHEN len(h.ws) = 0 THEN 1.0 ELSE least(1, greatest(0.1, exp(-2 * coalesce(j, 0)))) END AS novelty
  FROM hs h LEFT JOIN fr f USING (article_id) LEFT JOIN jc USING (article_id))"""


@query("news_novelty", f"WITH {ART}, {NOV} SELECT article_id, round(novelty, 6) AS novelty FROM nov")
def _(spark, d):
    return rounded(news.novelty(articles(spark, d)), 6, "novelty")


_alias: dict[str, list[str]] = {}
for _c, _t in text.COMPANIES.items():
    _alias.setdefault(_t, []).append(_c)
_any = lambda col, names: "(" + " OR ".join(f"contains({col}, '{n}')" for n in names) + ")"
CEN = "up AS (SELECT *, upper(headline) AS h, upper(summary) AS s FROM art), cn AS (" + " UNION ALL ".join(
    f"SELECT article_id, '{t}' AS ticker, CASE WHEN contains(h, '{t}') OR {_any('h', n)} THEN 1.0 WHEN contains(s, '{t}') OR {_any('s', n)} THEN 0.5 ELSE 0.3 END::DOUBLE AS centrality "
    f"FROM up WHERE {_any('h', n)} OR {_any('s', n)} OR regexp_matches(headline, '\\b{t.replace('.', chr(92) + '.')}\\b')" for t, n in sorted(_alias.items())) + f"""),
cen AS (SELECT * FROM cn UNION ALL SELECT article_id, 'SPY', CASE WHEN event_type = 'MACRO_FED' THEN 0.8 ELSE 0.5 END FROM evt ANTI JOIN cn USING (article_id)
  UNION ALL SELECT article_id, 'QQQ', 0.8 FROM evt ANTI JOIN cn USING (article_id) WHERE event_type = 'MACRO_FED')"""


@query("entity_centrality", f"WITH {ART}, {EVT}, {CEN} SELECT article_id, ticker, centrality FROM cen")
def _(spark, d):
    kind, _u = text.event_type(F.col("headline"), F.col("summary"), F.col("source"))
    a = articles(spark, d).withColumn("k", kind)
    c = text.centrality(F.col("headline"), F.col("summary"), F.col("tickers"), F.col("k"))
    return a.select("article_id", F.explode_outer(c).alias("x")).filter(F.col("x").isNotNull()).select("article_id", "x.ticker", "x.centrality")


CLS = f"{ART}, {POL}, {EVT}, {NOV}, {CEN}, cls AS (SELECT article_id, ticker, event_type, urgency, polarity, novelty, centrality, polarity * urgency * novelty * centrality AS shock FROM cen JOIN pol USING (article_id) JOIN evt USING (article_id) JOIN nov USING (article_id))"


@query("classified_news", f"WITH {CLS} SELECT article_id, ticker, event_type, round(shock, 6) AS shock FROM cls")
def _(spark, d):
    return rounded(news.classify(articles(spark, d)).select("article_id", "ticker", "event_type", "shock"), 6, "shock")


GAMMA = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in news.ELASTICITY.items()) + " END::DOUBLE"
PRE = f"""{CLS}, mk AS (SELECT ticker, 50.0::DOUBLE + 10 * length(ticker) AS price, 0.01::DOUBLE * length(ticker) AS vol FROM (SELECT DISTINCT ticker FROM cen WHERE ticker <> 'QQQ')),
pr AS (SELECT c.*, coalesce(price, 100.0) AS price, coalesce(vol, 0.02) AS vol, {GAMMA} AS g FROM cls c LEFT JOIN mk USING (ticker)),
pre AS (SELECT *, price * g * shock * vol AS expected_delta, 1 / (1 + exp(least(50, greatest(-50, -(1.5 * shock * g) / greatest(vol, 1e-5))))) AS prob_up FROM pr)"""


def predictions(spark, d):
    c = news.classify(articles(spark, d))
    names = sorted(set(text.COMPANIES.values())) + ["SPY"]
    rows = ", ".join(f"('{t}', {50.0 + 10 * len(t)}D, {0.01 * len(t)!r}D)" for t in names)
    market = spark.sql(f"SELECT * FROM VALUES {rows} AS m(ticker, price, volatility)")
    return news.predict(c, market)


@query("price_reaction", f"""WITH {PRE} SELECT article_id, ticker, round(expected_delta, 6) AS expected_delta, round(prob_up, 6) AS prob_up, round(price * exp(2 * vol), 6) AS barrier_upper,
  CASE WHEN prob_up >= 0.65 THEN 'BUY' WHEN prob_up <= 0.35 THEN 'SELL' ELSE 'NEUTRAL' END AS signal, round(2 * abs(prob_up - 0.5), 6) AS confidence FROM pre""")
def _(spark, d):
    p = predictions(spark, d).select("article_id", "ticker", "expected_delta", "prob_up", "barrier_upper", "signal", "confidence")
    return rounded(p, 6, "expected_delta", "prob_up", "barrier_upper", "confidence")


def _decay_sql(s, u, fast="3600.0", slow="86400.0"):
    v = f"(0.5 * exp(-({s}) / greatest({fast}::DOUBLE * (1 - least(greatest({u}, 0), 0.999)), 1e-6)) + 0.5 / (1 + ({s}) / {slow}::DOUBLE))"
    return f"CASE WHEN ({s}) < 0 OR ({s}) > 604800 OR {v} < 1e-4 THEN 0 ELSE {v} END"


@query("reaction_trajectory", f"""WITH {PRE}, h AS (SELECT *, unnest([0.0, 300.0, 900.0, 3600.0, 14400.0, 86400.0, 259200.0])::DOUBLE AS horizon_s FROM pre)
SELECT article_id, ticker, horizon_s, round(price + expected_delta * {_decay_sql('horizon_s', 'urgency')}, 6) AS path_price FROM h""")
def _(spark, d):
    return rounded(news.trajectory(predictions(spark, d)).select("article_id", "ticker", "horizon_s", "path_price"), 6, "path_price")


@query("forward_priors", f"WITH {PRE} SELECT ticker, round(arg_max(2 * (prob_up - 0.5), article_id), 6) AS prior FROM pre GROUP BY 1")
def _(spark, d):
    return rounded(news.forward_priors(predictions(spark, d), ["article_id"]), 6, "prior")


@query("decay_kernel", f"SELECT event_id, round({_decay_sql('value * 2000.0', '(event_id % 10) / 10.0')}, 8) AS weight FROM events")
def _(spark, d):
    t = fx.ticks(spark, d)
    return t.select("event_id", F.round(text.decay(F.col("price") * 2000.0, (F.col("event_id") % 10) / 10.0), 8).alias("weight"))


def news_events(spark, d):
    """Embeddings as scored events of an asset, one every 50 minutes."""
    v = F.col("vec_id")
    return fx.table(spark, d, "embeddings").select(
        v.alias("event_id"), F.concat(F.lit("A"), (F.col("label") % 4).cast("string")).alias("asset_id"), (v * 3_000_000_000_000).alias("ts_ns"), "embedding",
        ((v % 21 - 10) / 10.0).alias("polarity"), ((v % 5) / 5.0).alias("subjectivity"), ((v % 3) / 3.0).alias("novelty"),
        ((v % 10) / 10.0).alias("urgency"), ((v % 4 + 1) / 4.0).alias("centrality"))


STATE = """ne AS (SELECT vec_id AS v, 'A' || (label % 4) AS asset_id, vec_id * 3000000000000 AS ts_ns, (vec_id % 10) / 10.0 AS u, (vec_id % 4 + 1) / 4.0 AS c,
  list_concat(list_transform(embedding, lambda x: x::DOUBLE), [(vec_id % 21 - 10) / 10.0, (vec_id % 5) / 5.0, (vec_id % 3) / 3.0, (vec_id % 10) / 10.0, (vec_id % 4 + 1) / 4.0]) AS f FROM embeddings),
gr AS (SELECT unnest(range(min(ts_ns) // 86400000000000, (max(ts_ns) + 604800000000000) // 86400000000000 + 1)) * 86400000000000 AS asof_ns FROM ne), jn AS (SELECT asset_id, asof_ns, (asof_ns - ts_ns) / 1e9::DOUBLE AS s, u, c, f FROM ne JOIN gr ON asof_ns BETWEEN ts_ns AND ts_ns + 604800000000000),
wt AS (SELECT asset_id, asof_ns, c * (""" + _decay_sql("s", "u") + """) AS w, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos FROM jn)"""


@query("active_news_state", f"WITH {STATE} SELECT asset_id, asof_ns, pos::INT AS pos, round(sum(w * x), 6) AS value, count(*) AS n_events FROM wt GROUP BY 1, 2, 3")
def _(spark, d):
    e = news_events(spark, d).withColumn("features", F.concat(
        F.col("embedding").cast("array<double>"), F.array("polarity", "subjectivity", "novelty", "urgency", "centrality")))
    return rounded(news.active_state(e, 86_400_000_000_000), 6, "value")


@query("projected_features")
def _(spark, d):
    p = news.project(news_events(spark, d), 64)
    return p.select("event_id", F.posexplode("features").alias("pos", "x")).select("event_id", "pos", F.round("x", 6).alias("x"))


@query("news_edges", "SELECT doc_id AS event_id, upper(source) AS ticker, 0.5::DOUBLE AS centrality FROM documents UNION ALL SELECT doc_id, upper(lang), 1.0 FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    e = docs.select(F.col("doc_id").alias("event_id"), F.create_map(F.col("source"), F.lit(0.5), F.col("lang"), F.lit(1.0)).alias("ticker_weights"))
    return news.ingest_edges(e, _assets(docs))[0]


def _assets(docs):
    return docs.filter("doc_id % 2 = 0").select(F.upper("source").alias("ticker")).distinct().select(
        "ticker", F.col("ticker").alias("name"), F.lit("NEWS").alias("sector"), F.lit(True).alias("is_active"))


@query("news_assets", """WITH a AS (SELECT DISTINCT upper(source) AS ticker FROM documents WHERE doc_id % 2 = 0), t AS (SELECT upper(source) AS ticker FROM documents UNION SELECT upper(lang) FROM documents)
SELECT ticker, 'NEWS' AS sector FROM a UNION ALL SELECT ticker, 'UNKNOWN' FROM t ANTI JOIN a USING (ticker)""")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    e = docs.select(F.col("doc_id").alias("event_id"), F.create_map(F.col("source"), F.lit(0.5), F.col("lang"), F.lit(1.0)).alias("ticker_weights"))
    return news.ingest_edges(e, _assets(docs))[1].select("ticker", "sector")
