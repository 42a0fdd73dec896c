"""Idempotent merges of a batch into a table: each gives the table's new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

BACKFILL_WORDS = 120


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an arrival number."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Column], fresh: dict[str, Column] | None = None) -> DataFrame:
    """Full outer merge on key. rules give a column where old (o) and new (n) meet; rows of one side keep theirs, those of
    new alone take `fresh` first. Columns are old's; what new lacks is null."""
    fresh = fresh or {}
    o = old.select(F.col(key).alias("ok"), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key).alias("nk"), F.struct(*new.columns).alias("n"))
    both = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    kinds = dict(old.dtypes)
    mine = lambda c: F.col(f"n.{c}") if c in new.columns else F.lit(None)
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull(), fresh.get(c, mine(c)).cast(kinds[c])).otherwise(rules.get(c, F.col(f"o.{c}")).cast(kinds[c]))
    return both.select(*(pick(c).alias(c) for c in old.columns))


def filled(c: str) -> Column:
    """The new text unless it is empty."""
    return F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"))


def kept(c: str) -> Column:
    """The old value unless it is null."""
    return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))


def newer(c: str) -> Column:
    """The new value unless it is null."""
    return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))


def upsert_documents(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Last writer wins on url. Ids, canonical_url and created_at stay; new rows get the next ids in the order of urls."""
    taken = ("title", "description", "content", "published_at", "updated_at", "word_count", "quality_score", "freshness_score", "status")
    rules = {c: F.col(f"n.{c}") for c in taken if c in new.columns}
    merged = merge(old, new, "url", rules, {"id": F.lit(None), "canonical_url": F.col("n.url"), "created_at": as_of})
    return number_new(merged, old)


def number_new(rows: DataFrame, old: DataFrame) -> DataFrame:
    """Ids after old's largest for rows without one, without sorting all rows in one task: counted per range of urls, then offset.

    The ranges are written before they are read twice: sampled anew, they might be others.
    """
    shared.checkpoints(old.sparkSession)
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    lacking = rows.filter("id is null").repartitionByRange("url").select("url", F.spark_partition_id().alias("p")).checkpoint()
    inside = lacking.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("url")))
    sizes = lacking.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("b"))  # a row per partition
    ids = inside.join(F.broadcast(before), "p").crossJoin(F.broadcast(top)).select("url", (F.col("top") + F.col("b") + F.col("k")).alias("new_id"))
    return rows.join(ids, "url", "left").select(*(F.coalesce("id", "new_id").alias("id") if c == "id" else F.col(c) for c in rows.columns))


def discover_feeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """Feeds found on pages: known ones only gain what was null."""
    return merge(old, new, "feed_url", {c: kept(c) for c in ("home_url", "discovered_by_url") if c in old.columns})


def refresh_feeds(old: DataFrame, new: DataFrame, as_of: Column, minutes: int = 20) -> DataFrame:
    """Metadata after a fetch; the next one is due after some minutes."""
    at = {"last_fetched": as_of, "next_fetch_at": as_of + F.make_dt_interval(mins=F.lit(minutes))}
    rules = {c: filled(c) for c in ("name", "link", "image") if c in old.columns} | {"last_published": newer("last_published")} | at
    return merge(old, new, "feed_url", {c: r for c, r in rules.items() if c in old.columns}, at)


def upsert_articles(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Non-empty new texts win, dates are kept where new has none, the feed of a known article stays."""
    rules = {c: filled(c) for c in ("title", "description", "image", "author", "content") if c in old.columns}
    rules |= {"published_at": newer("published_at"), "updated_at": as_of}
    return merge(old, new, "url", {c: r for c, r in rules.items() if c in old.columns}, {"updated_at": as_of})


def backfill(articles: DataFrame, pages: DataFrame, words: Column) -> DataFrame:
    """Articles without content take that of the crawled page (url, page_content) if it has enough words."""
    p = pages.filter(words >= BACKFILL_WORDS).select(F.col("url").alias("_u"), F.col("page_content").alias("_c"))
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    return articles.join(p, F.col("url") == F.col("_u"), "left").select(*(F.when(empty & F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("content")).alias("content") if c == "content" else F.col(c) for c in articles.columns))
