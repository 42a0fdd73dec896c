"""The driver's tables, and the web, news, link and queue tables derived from them.

Each derived table is a list of SQL expressions that Spark and DuckDB read alike, so the oracles use the same rule.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2025, 6, 1)
AS_OF_SQL = "timestamp '2025-06-01 00:00:00'"

WEB = (
    "doc_id as id",
    "concat('https://', source, '.example.org/doc/', doc_id) as url",
    "substring(split_part(text, chr(10), 1), 1, 80) as title",
    "substring(text, 1, 200) as description",
    "text as content",
    "case when doc_id % 17 = 0 then 'processing_error' else 'done' end as status",
)
FEEDS = (
    "concat('https://', source, '.example.org/feed.xml') as feed_url",
    "source as name",
    "cast(substring(source, 4) as int) as k",
)
ARTICLES = (
    "concat('https://news.example.org/', doc_id) as url",
    "concat('https://', source, '.example.org/feed.xml') as feed_url",
    "substring(split_part(text, chr(10), 1), 1, 80) as title",
    "case when doc_id % 8 = 0 then null else substring(text, 1, 200) end as description",
    "text as content",
    "concat('author ', doc_id % 7) as author",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*WEB)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*ARTICLES)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed of each source; even ones were never fetched, others are due at steps around AS_OF."""
    f = documents(spark, sf_dir).selectExpr(*FEEDS).distinct()
    at = F.lit(AS_OF)
    return f.select(
        "feed_url",
        F.when(F.col("k") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://"), "name", F.lit(".example.org/"))).alias("home_url"),
        "name",
        F.when(F.col("k") % 2 == 0, F.lit(None).cast("timestamp")).otherwise(at + F.make_dt_interval(mins=(F.col("k") - 10) * 7)).alias("next_fetch_at"),
        F.when(F.col("k") % 4 == 0, F.lit(None).cast("timestamp")).otherwise(at - F.make_dt_interval(hours=F.col("k"))).alias("last_fetched"),
    )


def outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arithmetic links and an unresolvable one for each document but multiples of 11."""
    d = documents(spark, sf_dir).select("doc_id", "source")
    n = d.count()
    pairs = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("source_doc_id"), F.explode(F.array(F.lit(3), F.lit(7), F.lit(13))).alias("k"))
    to = pairs.select("source_doc_id", F.pmod(F.col("source_doc_id") * F.col("k") + 7, F.lit(n)).alias("t"))
    urls = d.select(F.col("doc_id").alias("t"), F.expr(WEB[1]))
    lost = d.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("source_doc_id"), F.concat(F.lit("https://elsewhere.example.com/"), "doc_id").alias("target_url"))
    return to.join(urls, "t").select("source_doc_id", F.col("url").alias("target_url")).union(lost)


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetch results: status codes and content types dealt so that every route occurs; every third page has a description,
    a date and a feed link."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url",
        "case when page_id % 10 = 3 then 404 when page_id % 10 = 4 then 500 else 200 end as status_code",
        "case when page_id % 10 = 5 then 'application/rss+xml' when page_id % 10 = 6 then 'text/xml' when page_id % 20 = 7 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type",
        "case when page_id % 20 = 6 then concat('  <rss version=\"2.0\">', html) when page_id % 3 = 0 then replace(html, '<style>', concat('<meta name=\"description\" content=\"  Page ', page_id, ' &amp; more\"><meta property=\"article:published_time\" content=\"2024-0', 1 + page_id % 9, '-05T06:07:08+02:00\"><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed', page_id, '.xml?utm_source=x\"><link rel=\"stylesheet\" href=\"/s.css\"><style>')) else html end as body",
    )
