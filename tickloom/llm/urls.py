"""URL filters: host and path rules, then a weighted vocabulary found by one Aho-Corasick pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import ascii_lower

#: Rules (verdict, host and path) and terms. One strict term rejects, or LIMIT different soft ones.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
STRICT = (
    "porn", "porno", "pornhub", "xxx", "hentai", "camgirl", "camgirls", "escorts", "milf", "bestiality", "redtube", "xvideos", "casino", "casinos", "onlinecasino", "jackpots", "warez", "keygen",
    "keygens", "malware", "phishing", "viagra", "cialis", "spam",
)
SOFT = (
    "adult", "adults", "x", "sex", "sexy", "nude", "nudes", "naked", "erotic", "fetish", "webcam", "webcams", "dating", "hookup", "hookups", "escort", "girls", "hot", "poker", "slot", "slots",
    "bet", "bets", "betting", "gambling", "jackpot", "win", "bonus", "pill", "pills", "pharmacy", "loan", "loans", "payday", "credit", "forex", "crack", "cracks", "serial", "serials",
    "torrent", "torrents", "free", "cheap", "replica", "replicas", "live", "ad", "ads", "track", "tracker", "trackers", "tracking",
)
LIMIT = 2
VOCABULARY: dict[str, int] = {t: LIMIT for t in STRICT} | {t: 1 for t in SOFT}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the longer host) and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        own, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return rule, verdict


def found_terms(text: str, automaton) -> list[str]:
    """The different terms of the vocabulary in ``text`` (A-Z lower-cased) with no letter a-z right before or after."""
    letter = lambda k: 0 <= k < len(text) and "a" <= text[k] <= "z"
    return sorted({term for end, term in automaton.iter(text) if not letter(end + 1) and not letter(end - len(term))})


def score_urls(urls: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """The columns of ``urls`` (``low``: the text to search, A-Z lower-cased; ``row``: a struct) as row, terms and score."""
    schema = T.StructType([urls.schema["row"], T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("score", T.LongType())])

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for term in vocabulary:
            automaton.add_word(term, term)
        if vocabulary:
            automaton.make_automaton()
        for batch in batches:
            terms = [found_terms(u, automaton) if vocabulary else [] for u in batch.column("low").to_pylist()]
            score = [sum(vocabulary[t] for t in own) for own in terms]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(terms, pa.list_(pa.string())), pa.array(score, pa.int64())], ["row", "terms", "score"])

    return urls.mapInArrow(run, schema)


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, terms, score.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits decides. Where
    none fits, the URL up to its query or fragment is searched for the vocabulary: different terms add their weights,
    and ``limit`` blocks. A term next to a letter (``sex`` in ``essex``) does not count; digits and signs are boundaries.

    Null URLs and those without ``://`` have an empty host and path, so no rule fits; a null URL has no terms and is
    allowed. Repeated rows are judged each; an empty table gives no rows. Only page_id and url are read.
    """
    url = F.col("url").cast("string")
    scored = score_urls(pages.select(ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)).alias("low"), F.struct("page_id", url.alias("url")).alias("row")), vocabulary)
    host, path = host_and_path(F.col("row.url"))
    rows = scored.select("row.page_id", host.alias("host"), path.alias("path"), "terms", "score")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "terms", "score")
