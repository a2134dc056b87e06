"""The queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import codes, merkle, mixing, naming, nearby, packing, perplexity, pii, rules, sharding, substrings, toxicity, urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.score_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(documents(spark, sf_dir))


def op8_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.near_groups(documents(spark, sf_dir), words_each=4, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(documents(spark, sf_dir), window=50)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(documents(spark, sf_dir))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_rules": op2_rules,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_perplexity": op6_perplexity,
    "op7_naming": op7_naming,
    "op8_nearby": op8_nearby,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
    "op11_manifest": op11_manifest,
    "op12_codes": op12_codes,
    "op13_urls": op13_urls,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES_SQL = rf"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM words),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT words.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
metric AS (
  SELECT doc_id, lang, source, unnest([
    {{'m': 'symbols', 'v': (1024 * n_symbols) // n_words, 'least': 128, 'both': false}},
    {{'m': 'dup_lines', 'v': (1024 * n_dup_lines) // greatest(n_lines, 1), 'least': 128, 'both': false}},
    {{'m': 'repeats', 'v': (1024 * n_repeat_words) // n_words, 'least': 64, 'both': false}},
    {{'m': 'word_length', 'v': (64 * word_chars) // n_words, 'least': 64, 'both': true}}], recursive := true)
  FROM judged WHERE n_words > 0),
binned AS (SELECT *, v - v % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT)) AS low FROM metric),
groups AS (
  SELECT 'g' AS lev, lang, source, m, least, low FROM binned
  UNION ALL SELECT 'l', lang, NULL, m, least, low FROM binned
  UNION ALL SELECT 'a', NULL, NULL, m, least, low FROM binned),
upto AS (SELECT *, count(*) OVER (PARTITION BY lev, lang, source, m ORDER BY low) AS c, count(*) OVER (PARTITION BY lev, lang, source, m) AS n FROM groups),
quartile AS (SELECT lev, lang, source, m, any_value(least) AS least, any_value(n) AS n, min(low) FILTER (4 * c >= n) AS q1, min(low) FILTER (4 * c >= 3 * n) AS q3 FROM upto GROUP BY ALL),
fence AS (SELECT lev, lang, source, m, n, q1 - 3 * greatest(q3 - q1, least) AS lo, q3 + 3 * greatest(q3 - q1, least) AS hi FROM quartile),
tried AS (
  SELECT b.doc_id, b.v <= f.hi AND (NOT b.both OR b.v >= f.lo) AS ok
  FROM binned b
  JOIN fence g ON g.lev = 'g' AND g.m = b.m AND g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
  JOIN fence l ON l.lev = 'l' AND l.m = b.m AND l.lang IS NOT DISTINCT FROM b.lang
  JOIN fence f ON f.m = b.m AND f.lev = CASE WHEN g.n >= 200 THEN 'g' WHEN l.n >= 200 THEN 'l' ELSE 'a' END
   AND (f.lev = 'a' OR f.lang IS NOT DISTINCT FROM b.lang) AND (f.lev <> 'g' OR f.source IS NOT DISTINCT FROM b.source)),
verdict AS (SELECT doc_id, bool_and(ok) AS ok FROM tried GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept
FROM judged LEFT JOIN verdict USING (doc_id)
"""

SHARDING_SQL = """
WITH RECURSIVE sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT doc_id, size, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM placed),
poly AS (SELECT i AS b, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) r(i)
         UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM poly WHERE step < 8),
lookup AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE step = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
          list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT))),
          lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) AS text_crc32
        FROM documents, lookup)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN crc USING (doc_id)
"""

NAMING_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""

SUBSTRINGS_SQL = rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM windows),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM firsts, range(50) r(k) WHERE f < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
stays AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN stays USING (doc_id)
"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST_SQL = rf"""
WITH RECURSIVE poly AS (SELECT i AS b, 0 AS step, CAST(i AS BIGINT) AS c FROM range(256) r(i)
         UNION ALL SELECT b, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM poly WHERE step < 8),
lookup AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE step = 8),
altered AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(regexp_replace(hex(encode(CAST(doc_id AS VARCHAR))), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT))),
              lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) % 3 = 0 AS hit FROM documents, lookup),
leaves AS (SELECT doc_id, lang, {_leaf("text")} AS leaf,
                  CASE WHEN hit THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS shown
           FROM documents JOIN altered USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (SELECT lang, 0 AS lev, rank AS idx, leaf AS digest, n FROM ranked
       UNION ALL
       SELECT lang, lev + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lang, lev, idx // 8),
roots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM up WHERE n = 1),
above AS (SELECT 0 AS lev, rank AS idx, subroot AS digest, n FROM roots
          UNION ALL
          SELECT lev + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 7) // 8) FROM above WHERE n > 1 GROUP BY lev, idx // 8),
low AS (SELECT r.doc_id, u.lev, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < r.rank // CAST(8 ** u.lev AS BIGINT)) AS l, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > r.rank // CAST(8 ** u.lev AS BIGINT)) AS r
        FROM ranked r JOIN up u ON u.lang IS NOT DISTINCT FROM r.lang AND u.n > 1 AND u.idx // 8 = r.rank // CAST(8 ** (u.lev + 1) AS BIGINT) GROUP BY ALL),
high AS (SELECT s.lang, u.lev, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < s.rank // CAST(8 ** u.lev AS BIGINT)) AS l, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > s.rank // CAST(8 ** u.lev AS BIGINT)) AS r
         FROM roots s JOIN above u ON u.n > 1 AND u.idx // 8 = s.rank // CAST(8 ** (u.lev + 1) AS BIGINT) GROUP BY ALL),
steps AS (SELECT doc_id, 0 AS part, lev, coalesce(l, '') || ',' || coalesce(r, '') AS s FROM low
          UNION ALL SELECT k.doc_id, 1, lev, coalesce(l, '') || ',' || coalesce(r, '') FROM high h JOIN leaves k ON k.lang IS NOT DISTINCT FROM h.lang),
path AS (SELECT k.doc_id, coalesce(list(s ORDER BY part, lev) FILTER (s IS NOT NULL), []) AS p FROM leaves k LEFT JOIN steps USING (doc_id) GROUP BY k.doc_id),
done AS (SELECT k.doc_id, leaf, subroot, (SELECT digest FROM above WHERE n = 1) AS root, sha256(replace(array_to_string(p, ''), ',', '')) AS proof_sha256,
                list_reduce(list_prepend(shown, p), lambda a, s: sha256(split_part(s, ',', 1) || a || split_part(s, ',', 2))) AS folded_root
         FROM leaves k JOIN path USING (doc_id) JOIN roots r ON r.lang IS NOT DISTINCT FROM k.lang)
SELECT *, folded_root = root AS verified FROM done
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    nearest = lambda k: (
        f"d{k} AS (SELECT id, part, entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b USING (part, pos) GROUP BY ALL), "
        f"a{k} AS (SELECT id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{k} GROUP BY ALL)"
    )
    steps = [
        f"""{nearest(k)},
m{k} AS (SELECT part, entry, pos, CAST(sum(v) AS HUGEINT) AS s, count(*) AS c FROM x JOIN a{k} USING (id, part) GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, pos, coalesce((s - ((s % c) + c) % c) // c, b.v) AS v FROM b{k} b LEFT JOIN m{k} USING (part, entry, pos))"""
        for k in range(rounds)
    ]
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, embedding FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
each AS (SELECT id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p, (SELECT (max(len(embedding)) + {parts - 1}) // {parts} FROM kept) AS w FROM kept),
x AS MATERIALIZED (SELECT id, p // w AS part, p % w AS pos, CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT) AS v FROM each),
b0 AS (SELECT part, id AS entry, pos, v FROM x WHERE id < {entries}),
{",".join(steps)},
{nearest(rounds)},
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (id), book
"""


def urls_sql() -> str:
    low = f"translate(regexp_extract(coalesce(url, ''), '^[^?#]*'), '{UPPER}', '{LOWER}')"
    cases = "".join(
        f" WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in sorted(urls.RULES, key=lambda r: -len(r[1]))
    )
    terms = ", ".join(f"{{'t': '{t}', 'w': {w}}}" for t, w in urls.VOCABULARY.items())
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in urls.RULES)
    return rf"""
WITH rest AS (SELECT page_id, {low} AS low, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE{cases} END AS rule, coalesce(list_sum(list_transform(list_filter([{terms}], lambda x: regexp_matches(low, '(^|[^a-z])' || x.t || '([^a-z]|$)')), lambda x: x.w)), 0) AS score FROM parts)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, CASE WHEN score >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


SQL: dict[str, str] = {
    "op10_substrings": SUBSTRINGS_SQL,
    "op11_manifest": MANIFEST_SQL,
    "op12_codes": codes_sql(),
    "op13_urls": urls_sql(),
    "op2_rules": RULES_SQL,
    "op5_sharding": SHARDING_SQL,
    "op7_naming": NAMING_SQL,
}
