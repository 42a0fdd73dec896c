"""Structured Streaming: crawl ingestion and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, scores, text, urls
from ..operators import index, queue, upsert
from ..plans.batch import Cycle

FETCHED = "page_id long, url string, status_code int, content_type string, body string"


def parsed(fetched: DataFrame, as_of: datetime) -> DataFrame:
    """Fetch results with the page's parts, its status and scores; works on batches and streams."""
    page = markup.page_parser(as_of)(F.col("url"), F.when((F.col("status_code") < 400) & F.lower("content_type").contains("text/html"), F.col("body")))
    rows = fetched.withColumn("page", page)
    valid = queue.valid_page(F.col("page.title"), F.col("page.description"), F.col("page.content"))
    rows = rows.withColumn("status", queue.route(F.col("status_code"), F.col("content_type"), F.col("body"), valid))
    words = text.white_words(F.col("page.content"))
    return rows.select(
        "page_id", "url", "status", ((F.col("status") == "done") & queue.is_feed_type(F.col("content_type"))).alias("is_feed"), "page.title", "page.description", "page.content", "page.links", "page.feed_links", "page.published_at", "page.updated_at",
        words.alias("word_count"), scores.quality(words, F.size("page.links")).alias("quality_score"),
        scores.freshness(F.col("page.updated_at"), F.col("page.published_at"), F.lit(as_of)).alias("freshness_score"),
    )


def ingest(spark: SparkSession, source: str, as_of: datetime, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 100):
    """Parses what arrives at source (Parquet files of FETCHED rows) and hands each micro-batch to sink; ends when all is read."""
    stream = spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return parsed(stream, as_of).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawl_sink(cycle: Cycle, as_of: datetime) -> Callable[[DataFrame, int], None]:
    """A sink for ingest(): merges each micro-batch into the cycle's tables documents, tokens, outgoing, feeds, articles and queue.

    Of a URL that a batch holds twice the later fetch (largest page_id) counts. Valid pages replace their document, its tokens and
    its links, and their links join the queue; feeds that were fetched or linked are discovered; empty articles take the text of
    their page, valid or not. A batch that comes again after a failure leaves the same tables. Each batch writes new snapshots of
    all six tables, so a trigger should take many files.
    """
    at = F.lit(as_of)

    def merge(batch: DataFrame, _: int) -> None:
        cycle.write("batch", upsert.latest(batch, "url", "page_id"))
        rows = cycle.read("batch")
        done = rows.filter("status = 'done' and not is_feed")
        cycle.write("documents", upsert.upsert_documents(cycle.read("documents"), done, at))
        stored = cycle.read("documents").join(done.select("url", "links"), "url")
        ids = stored.select(F.col("id").alias("doc_id"))
        web = index.tokens(index.web_postings(stored), index.news_postings(stored.limit(0)))
        cycle.write("tokens", index.replace_for_keys(cycle.read("tokens"), web, ids, "doc_id"))
        links = stored.select(F.col("id").alias("source_doc_id"), F.explode("links").alias("target_url"))
        cycle.write("outgoing", index.replace_for_keys(cycle.read("outgoing"), links, ids.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id"))
        found = done.select(F.explode("feed_links").alias("feed_url"), "url", "page_id").union(rows.filter("is_feed").select(F.col("url").alias("feed_url"), "url", "page_id"))
        first = found.groupBy("feed_url").agg(F.min_by("url", "page_id").alias("home_url"))
        cycle.write("feeds", upsert.discover_feeds(cycle.read("feeds"), first.withColumn("discovered_by_url", F.col("home_url"))))
        cycle.write("articles", upsert.backfill(cycle.read("articles"), rows.select("url", F.col("content").alias("page_content")), text.white_words(F.col("page_content"))))
        state = queue.update_status(cycle.read("queue"), rows.select("url", F.col("status").alias("new_status")), at)
        cycle.write("queue", queue.enqueue(state, links.select(F.col("target_url").alias("url"), urls.registrable_domain(F.col("target_url")).alias("domain"))))

    return merge


def status_counts(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per window and type; late ones beyond the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))


def rate_limited(arrivals: DataFrame, gap: float) -> DataFrame:
    """(key, id, at) to (key, id, slot): the rate limiter with each key's next free slot as state."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for i, at in zip(rows.id, rows["at"], strict=True):
            slot = max(at, free)
            free = slot + gap
            out.append((key[0], i, slot))
        state.update((free,))
        yield pd.DataFrame(out, columns=["key", "id", "slot"])

    return arrivals.groupBy("key").applyInPandasWithState(step, "key string, id long, slot double", "free double", "append", "NoTimeout")
