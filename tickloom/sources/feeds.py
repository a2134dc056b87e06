"""RSS and Atom landing files to articles, and report export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import text

ITEM_SCHEMA = "title string, description string, summary string, content string, link string, pubDate string, updated string, published string"
ENTRY_SCHEMA = "title string, description string, summary string, content string, link struct<_href: string>, pubDate string, updated string, published string"


def read_feed(spark: SparkSession, path: str, atom: bool) -> DataFrame:
    """Items of feed files; large files split by row tag."""
    tag, schema = ("entry", ENTRY_SCHEMA) if atom else ("item", ITEM_SCHEMA)
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.withColumn("link", F.col("link._href")) if atom else rows


def parse_items(rows: DataFrame, body: str = "xml") -> DataFrame:
    """Items from one XML string column, one item per row."""
    return rows.withColumn("_i", F.from_xml(body, ITEM_SCHEMA)).select(*[c for c in rows.columns if c != body], "_i.*")


def parse_date(raw: Column) -> Column:
    """RFC 2822 first, then ISO 8601; null when neither fits. Text without a zone is UTC."""
    s = F.trim(raw)
    named = F.regexp_replace(F.regexp_replace(s, "^[A-Za-z]{3},\\s*", ""), "\\s(GMT|UT|UTC|Z)$", " +0000")
    rfc = F.coalesce(*[F.try_to_timestamp(named, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])
    return F.coalesce(rfc, F.try_to_timestamp(s))


def to_articles(items: DataFrame, source: Column, ingest_ns: Column, skew_s: float = 60.0) -> DataFrame:
    """Articles of items with a title: clean text, tickers, dates; future publications are dropped."""
    pub = F.coalesce(*[F.unix_micros(parse_date(F.col(c))) * 1000 for c in ("pubDate", "updated", "published")], ingest_ns)
    clean = items.filter(F.length(F.coalesce("title", F.lit(""))) > 0).withColumns({
        "headline": text.clean_html(F.col("title")), "summary": text.clean_html(F.coalesce("summary", "content", "description", F.lit(""))),
        "url": F.coalesce("link", F.lit("")), "source": source, "published_ns": pub, "available_ns": ingest_ns})
    kept = clean.filter((F.col("headline") != "") & (F.col("published_ns") <= F.col("available_ns") + int(skew_s * 1e9)))
    tagged = kept.withColumn("tickers", text.tickers(F.concat_ws(" ", "headline", "summary")))
    return tagged.drop("title", "description", "content", "link", "pubDate", "updated", "published").withColumn(
        "article_hash", text.article_hash(F.col("source"), F.col("headline"), F.col("summary")))


def export_report(metrics: DataFrame, equity: DataFrame, monthly: DataFrame, path: str) -> None:
    """Metrics as JSON, equity series and monthly matrix as Parquet."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    equity.write.mode("overwrite").parquet(f"{path}/equity")
    monthly.write.mode("overwrite").parquet(f"{path}/monthly")
