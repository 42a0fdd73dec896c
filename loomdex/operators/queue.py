"""Crawl queue: enqueue, dequeue, status, routing of fetch results, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "in_progress", "done", "validation_error", "non_success_status_error", "processing_error")
LEAST_CONTENT = 120


def empty_queue(spark) -> DataFrame:
    return spark.createDataFrame([], "url string, status string, domain string, last_attempt timestamp, attempt_count int")


def enqueue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """queue with the urls (url, domain) that it lacks, as queued."""
    new = found.select("url", "domain").groupBy("url").agg(F.min("domain").alias("domain")).join(queue.select("url"), "url", "left_anti")
    return queue.unionByName(new.select("url", F.lit("queued").alias("status"), "domain", F.lit(None).cast("timestamp").alias("last_attempt"), F.lit(0).alias("attempt_count")))


def sample(queue: DataFrame, n: int, seed: int) -> DataFrame:
    """n queued urls in an order that only the seed decides."""
    return queue.filter("status = 'queued'").select("url", "domain", F.md5(F.concat(F.lit(f"{seed}:"), "url")).alias("_o")).orderBy("_o", "url").limit(n).drop("_o")


def dequeue(queue: DataFrame, picked: DataFrame, as_of: Column) -> DataFrame:
    """queue after the picked urls went to in_progress."""
    mark = picked.select("url").distinct().withColumn("_p", F.lit(True))
    got = F.coalesce("_p", F.lit(False)) & (F.col("status") == "queued")
    return queue.join(mark, "url", "left").select("url", F.when(got, "in_progress").otherwise(F.col("status")).alias("status"), "domain", F.when(got, as_of).otherwise(F.col("last_attempt")).alias("last_attempt"), (F.col("attempt_count") + F.when(got, 1).otherwise(0)).alias("attempt_count"))


def update_status(queue: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """queue with the status of each of results (url, new_status)."""
    return queue.join(results.select("url", "new_status"), "url", "left").select("url", F.coalesce("new_status", "status").alias("status"), "domain", F.when(F.col("new_status").isNotNull(), as_of).otherwise(F.col("last_attempt")).alias("last_attempt"), "attempt_count")


def is_feed_type(content_type: Column) -> Column:
    return F.lower(content_type).rlike("rss|atom|xml")


def looks_like_feed(body: Column) -> Column:
    head = F.substring(body, 1, 512)
    return head.contains("<rss") | head.contains("<feed") | head.contains("<atom")


def valid_page(title: Column, description: Column, content: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return some(title) & some(description) & some(content) & (F.length(content) >= LEAST_CONTENT)


def route(status_code: Column, content_type: Column, body: Column, valid: Column) -> Column:
    """The status that a fetch result leads to; the order of the cases matters."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    generic = kind.contains("xml") & ~kind.rlike("rss|atom")
    return (
        F.when(status_code >= 400, "non_success_status_error")
        .when(is_feed_type(kind) & generic & ~looks_like_feed(F.coalesce(body, F.lit(""))), "processing_error")
        .when(is_feed_type(kind), "done")
        .when(~kind.contains("text/html"), "processing_error")
        .when(~valid, "validation_error")
        .otherwise("done")
    )


def slots(arrivals: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Each arrival's slot (seconds) when a key gets one request per gap seconds, first come first served (id breaks ties).

    slot_i = max(at_i, slot_(i-1) + gap) closes to i*gap + max over j <= i of (at_j - j*gap): a running maximum.
    """
    w = Window.partitionBy(key).orderBy(at, "id")
    i = F.row_number().over(w) - 1
    rows = arrivals.withColumn("_i", i).withColumn("_d", F.col(at) - F.col("_i") * F.lit(gap))
    run = F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot", F.col("_i") * F.lit(gap) + run).drop("_i", "_d")


def due(feeds: DataFrame, as_of: Column, most: int = 100) -> DataFrame:
    """Feeds to fetch now, those never fetched first."""
    soon = F.coalesce("next_fetch_at", as_of - F.make_dt_interval(secs=F.lit(1))) <= as_of
    return feeds.filter(soon).orderBy(F.asc_nulls_first("next_fetch_at"), F.asc_nulls_first("last_fetched"), "feed_url").limit(most)


def shard_of(key: Column, n: int) -> Column:
    """Shard of a text key: the same for the same key, evenly dealt."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n))


def shard(df: DataFrame, id_col: str, n: int, k: int) -> DataFrame:
    return df.filter(F.pmod(F.col(id_col), F.lit(n)) == k)
