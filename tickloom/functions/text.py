"""Text columns: HTML clean-up, tickers, lexicon polarity, event rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexicons, rule patterns and names that scores must agree on.
POSITIVE = """
beat beats beating surged surging surge record profit profitable profitability boom booming growth growing
gain gained gains exceed exceeded exceeds exceeding outperform outperformed outperforming rally rallied
rallying top topped topping boost boosted boosting dividend upgrade upgraded upgrades upgrading expansion
expanding accretive efficiency optimism bullish soared soaring soar acceleration accelerated accelerating
achieve achieved achieving meet met meeting deliver delivered delivering approval approved approving success
successful positive strong higher
""".split()
NEGATIVE = """
miss missed misses missing slump slumped slumping loss losses drop dropped dropping plunge plunged plunging
fall falling fell decline declined declining declines plummet plummeted plummeting deficit debt default
lawsuit sued fraud probe investigate investigation fine penalty penalties subpoena warning cut cuts cutting
down lowered lowering slash slashed slashing downgrade downgraded downgrades weakness bearish recession
inflation irregularities delinquency contraction shortfall fail failed failing failure failures weak lower
negative
""".split()
NEGATION = "not no never neither nor none unable failed fail barely hardly without little cannot cant wont".split()
INVERSION = "narrowed narrowing slowed slowing decreased decreasing diminished curbed eased easing".split()
EVENT_RULES = [
    ("MACRO_FED", 0.85, ["fed", "federal reserve", "fomc", "rate cut", "rate hike", "cpi", "inflation", "payroll", "gdp"]),
    ("M_AND_A", 0.85, ["acquire", "acquires", "acquisition", "merger", "buyout", "takeover", "deal"]),
    ("REGULATORY_LEGAL", 0.70, ["sec", "doj", "investigation", "probe", "lawsuit", "antitrust", "fraud", "subpoena"]),
    ("ANALYST_ACTION", 0.60, ["upgrade", "upgrades", "upgraded", "downgrade", "downgrades", "downgraded", "price target"]),
    ("EARNINGS", 0.90, ["earnings", "revenue", "profit", "net income", "gross margin", "guidance", "eps", "deliveries", "quarterly"]),
]
COMPANIES = {
    "APPLE": "AAPL", "MICROSOFT": "MSFT", "NVIDIA": "NVDA", "AMAZON": "AMZN", "ALPHABET": "GOOGL", "GOOGLE": "GOOGL",
    "TESLA": "TSLA", "META": "META", "JPMORGAN": "JPM", "BERKSHIRE": "BRK.B", "BROADCOM": "AVGO", "ELI LILLY": "LLY",
}

SPACES = r"[\s \u001c-\u001f\u0085 -     　]+"


def unescape(text: Column) -> Column:
    """Character references, named and numeric, decoded once."""

    def decode(values: pd.Series) -> pd.Series:
        import html

        return values.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, "string")(text)


def clean_html(text: Column) -> Column:
    """Tags to spaces, entities decoded once, white space collapsed."""
    out = unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, SPACES, " "))


def article_hash(source: Column, headline: Column, summary: Column) -> Column:
    bare = lambda c: F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")))
    return F.sha2(F.concat_ws("|", bare(source), bare(headline), bare(summary)), 256)


def tickers(text: Column) -> Column:
    """Known tickers named by company (substring) or as an upper-case word, sorted."""
    known = F.array(*[F.lit(t) for t in sorted(set(COMPANIES.values()))])
    upper = F.upper(text)
    named = F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(c)), F.lit(t)) for c, t in COMPANIES.items()]))
    words = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(named, F.array_intersect(words, known))))


def polarity(text: Column) -> Column:
    """Lexicon polarity with negation two words back and inversion two words around."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(text), r"n't\b", " not"), r"'s\b", "")
    tokens = F.regexp_extract_all(norm, F.lit("([a-z0-9]+)"), F.lit(1))
    # bit 1 positive, 2 negative, 4 negation, 8 inversion
    code = lambda w: (
        F.when(w.isin(POSITIVE), 1).when(w.isin(NEGATIVE), 2).otherwise(0)
        + F.when(w.isin(NEGATION), 4).otherwise(0) + F.when(w.isin(INVERSION), 8).otherwise(0))
    # most words are in no list, which one look-up tells
    listed = sorted({*POSITIVE, *NEGATIVE, *NEGATION, *INVERSION})
    codes = F.transform(tokens, lambda w: F.when(w.isin(listed), code(w)).otherwise(0))

    def scores(c: Column) -> Column:
        at = lambda i, k: F.coalesce(F.get(c, i + k), F.lit(0))

        def one(w: Column, i: Column) -> Column:
            before = at(i, -1).bitwiseOR(at(i, -2))
            around = before.bitwiseOR(at(i, 1)).bitwiseOR(at(i, 2))
            negated = before.bitwiseAND(4) > 0
            softened = negated | (around.bitwiseAND(8) > 0)
            return (F.when(w.bitwiseAND(1) > 0, F.when(negated, -1.0).otherwise(1.0))
                    .when(w.bitwiseAND(2) > 0, F.when(softened, 0.8).otherwise(-1.0)).otherwise(0.0))

        return F.filter(F.transform(c, one), lambda s: s != 0.0)

    # a one-element array binds the codes and the scores once each
    hits = F.transform(F.array(codes), scores)[0]
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
    summed = F.aggregate(hits, zero, lambda a, s: F.struct(
        (a["p"] + F.greatest(s, F.lit(0.0))).alias("p"), (a["n"] + F.greatest(-s, F.lit(0.0))).alias("n")),
        lambda a: F.when(a["p"] + a["n"] == 0.0, 0.0).otherwise((a["p"] - a["n"]) / (a["p"] + a["n"] + 1e-6)))
    return F.least(F.greatest(F.coalesce(summed, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))


def headline_polarity(text: Column) -> Column:
    """White-space words without edge punctuation: (p - n) / (p + n)."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(
        w, r"""^[.,!?;:"'()\[\]{}]+|[.,!?;:"'()\[\]{}]+$""", ""))
    p = F.size(F.filter(words, lambda w: w.isin(POSITIVE)))
    n = F.size(F.filter(words, lambda w: w.isin(NEGATIVE)))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def event_rule(headline: Column, summary: Column, source: Column) -> Column:
    """Number of the first matching substring rule: 0 for filings, then ``EVENT_RULES``, last none."""
    filed = F.contains(F.lower(headline), F.lit("8-k")) | (source == "sec_edgar")

    def first(both: Column) -> Column:
        rule = F.when(filed, 0)
        for i, (_, _, words) in enumerate(EVENT_RULES, 1):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(both, F.lit(w))
            rule = rule.when(hit, i)
        return rule.otherwise(len(EVENT_RULES) + 1)

    # a one-element array binds the folded text once
    return F.transform(F.array(F.lower(F.concat_ws(" ", headline, summary))), first)[0]


def rule_columns(rule: Column) -> tuple[Column, Column]:
    """Event type and urgency of a rule number."""
    kinds = F.array(*[F.lit(k) for k in ("REGULATORY_LEGAL", *[r[0] for r in EVENT_RULES], "GENERAL_MARKET")])
    urgencies = F.array(*[F.lit(u) for u in (0.95, *[r[1] for r in EVENT_RULES], 0.30)])
    return F.get(kinds, rule), F.get(urgencies, rule)


def event_type(headline: Column, summary: Column, source: Column) -> tuple[Column, Column]:
    """First matching substring rule: event type and urgency."""
    return rule_columns(event_rule(headline, summary, source))


def centrality(headline: Column, summary: Column, tagged: Column, kind: Column, proxy: bool = True) -> Column:
    """Array of (ticker, centrality) of named companies and all tags: headline 1.0, summary 0.5, else 0.3; macro proxies if none."""
    return centrality_of(F.upper(headline), F.upper(summary), tagged, kind, proxy)


def centrality_of(h: Column, s: Column, tagged: Column, kind: Column, proxy: bool = True) -> Column:
    """``centrality`` of texts already in upper case."""
    aliases: dict[str, list[str]] = {}
    for company, ticker in COMPANIES.items():
        aliases.setdefault(ticker, []).append(company)
    entries = []
    for ticker, names in sorted(aliases.items()):
        named_h, named_s = F.lit(False), F.lit(False)
        for n in names:
            named_h, named_s = named_h | F.contains(h, F.lit(n)), named_s | F.contains(s, F.lit(n))
        candidate = named_h | named_s | F.array_contains(tagged, ticker)
        value = F.when(named_h | F.contains(h, F.lit(ticker)), 1.0).when(named_s | F.contains(s, F.lit(ticker)), 0.5).otherwise(0.3)
        entries.append(F.when(candidate, F.struct(F.lit(ticker).alias("ticker"), value.alias("centrality"))))
    def other(ticker: Column) -> Column:
        value = F.when(F.contains(h, ticker), 1.0).when(F.contains(s, ticker), 0.5).otherwise(0.3)
        return F.struct(ticker.alias("ticker"), value.alias("centrality"))

    unknown = F.array_except(F.coalesce(tagged, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in sorted(aliases)]))
    found = F.concat(F.array_compact(F.array(*entries)), F.transform(unknown, other))
    pair = lambda t, v: F.struct(F.lit(t).alias("ticker"), F.lit(v).alias("centrality"))
    market = F.array(pair("SPY", 0.5)) if proxy else F.array().cast("array<struct<ticker:string,centrality:double>>")
    fallback = F.when(kind == "MACRO_FED", F.array(pair("SPY", 0.8), pair("QQQ", 0.8))).otherwise(market)
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(fallback))[0]


def decay(seconds: Column, urgency: Column, alpha: float = 0.5, fast: float = 3600.0, slow: float = 86400.0, beta: float = 1.0,
          tolerance: float = 1e-4, horizon: float | None = 604800.0) -> Column:
    """Bi-exponential kernel; 0 below the tolerance, before the event and past the horizon."""
    u = F.least(F.greatest(urgency, F.lit(0.0)), F.lit(0.999))
    value = alpha * F.exp(-seconds / F.greatest(fast * (1.0 - u), F.lit(1e-6))) + (1.0 - alpha) * F.pow(1.0 + seconds / slow, -beta)
    out = seconds < 0
    if horizon is not None:
        out = out | (seconds > horizon)
    # the guard keeps the power's base positive for rows the rule discards
    return F.when(out, 0.0).otherwise(F.when(value < tolerance, 0.0).otherwise(value))
