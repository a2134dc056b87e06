"""SQL states the guards of its query on tables whose daily returns never fall."""

import pytest

import __spark_entry__ as entry
import check


@pytest.fixture
def rising(spark, tmp_path):
    df = spark.range(0, 4000).selectExpr("id AS event_id", "cast(timestamp_seconds(1704067200 + id * 700) AS timestamp_ntz) AS ts", "id % 40 AS user_id",
                                         "'a' AS event_type", "50.0 + (id * 7919 % 977) / 100.0 AS value", "'{}' AS props")
    df = df.selectExpr("event_id", "ts", "user_id", "event_type", "cast(value AS double) AS value", "props")
    df.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["audit_metrics", "tear_sheet_daily", "report_export"])
def test_returns_that_never_fall(spark, rising, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{rising}/events.parquet/*.parquet'")
    assert check.compare(entry.queries()[name](spark, rising), con, entry.oracle_sql()[name]) is None


def test_news_state_past_sixty_days(spark, sf, tmp_path):
    import duckdb

    spark.read.parquet(f"{sf}/embeddings.parquet").limit(20).selectExpr("vec_id * 500 AS vec_id", "embedding", "label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()["active_news_state"](spark, str(tmp_path))
    assert got.selectExpr("max(asof_ns) > 60 * 86400000000000 AS far").first().far
    assert check.compare(got, con, entry.oracle_sql()["active_news_state"]) is None


def test_character_references(spark, tmp_path):
    import duckdb

    html = ["a &amp;lt; b", "&lt &notit; &notin; &copy2 &AMP;&amp", "&#65;&#x42;&#X43 &#0;&#128;&#xD800;&#1114112;&#99999999999999;&#1;&#13;x", "& &; &#; &#x; &q&quot", "&CounterClockwiseContourIntegral;!",
            "a　 b\x0b\x1cc\x85", "<p class='x'>&nbsp;&apos;</p>", None, "", "&aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa;", "&\U0001f600;&lt\U0001f600", "&ngE;&acE;", "&#00000000065;&#x0000000041"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert check.compare(entry.queries()["html_clean"](spark, str(tmp_path)), con, entry.oracle_sql()["html_clean"]) is None


def test_lifo_of_many_small_books(spark, monkeypatch):
    """One Python call a book costs more than its fills; a task goes through all its books in one."""
    from pyspark.sql import GroupedData

    from tickloom.operators import lots

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    fills = spark.range(600).selectExpr("id % 300 AS portfolio_id", "'s' AS symbol", "CASE WHEN id < 300 THEN 'BUY' ELSE 'SELL' END AS side",
                                        "2.0D AS quantity", "1.0D + id AS price", "id AS ts_ns", "id AS order_id")
    m = lots.lifo_matches(lots.split_fills(fills, ["order_id"])).collect()
    assert len(m) == 300 and all(r.quantity == 2.0 and r.realized_pnl == 600.0 for r in m)
