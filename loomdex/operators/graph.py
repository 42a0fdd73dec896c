"""Link graph: resolution, in-degree, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

DAMPING, ITERATIONS, CHECKPOINT_EVERY = 0.85, 20, 5


def resolve(outgoing: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct (source_doc_id, target_doc_id): target URLs that a document has, whatever its status."""
    return outgoing.join(docs.select(F.col("id").alias("target_doc_id"), F.col("url").alias("target_url")), "target_url").select("source_doc_id", "target_doc_id").distinct()


def done_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_doc_id"), "source_doc_id", "left_semi").join(ids.withColumnRenamed("id", "target_doc_id"), "target_doc_id", "left_semi")


def inlinks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = done_edges(edges, nodes).groupBy(F.col("target_doc_id").alias("id")).agg(F.count("*").cast("int").alias("inlink_count"))
    return nodes.select("id").join(n, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("inlink_count", F.lit(0)).alias("inlink_count"))


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(doc_id, pagerank) after a fixed number of rounds. Mass of nodes without out-links is lost; self-links count.

    A round is a join of ranks with edges that stay partitioned by source, and one aggregation, whose shuffle is the
    only one: its result is partitioned as the edges are. Lineage is cut every few rounds by checkpoint() in the shared
    folder; cached tables are recomputed where an executor is lost.
    """
    spark = edges.sparkSession
    shared.checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.select("id").distinct().repartition(parts, "id").cache()
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "doc_id long, pagerank double")
    kept = done_edges(edges, nodes)
    out = kept.groupBy("source_doc_id").agg(F.count("*").alias("out"))
    links = kept.join(out, "source_doc_id").select("source_doc_id", "target_doc_id", (F.lit(damping) / F.col("out")).alias("share")).repartition(parts, "source_doc_id").cache()
    none = nodes.select("id", F.lit(0.0).alias("got"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        sent = links.join(ranks, F.col("source_doc_id") == F.col("id")).select(F.col("target_doc_id").alias("id"), (F.col("rank") * F.col("share")).alias("got"))
        ranks = sent.union(none).groupBy("id").agg((F.lit((1 - damping) / n) + F.sum("got")).alias("rank"))
        if (i + 1) % CHECKPOINT_EVERY == 0 or i + 1 == iterations:
            ranks = ranks.checkpoint()
    if iterations:  # the last ranks are written, so nothing reads these any more
        links.unpersist()
        nodes.unpersist()
    return ranks.select(F.col("id").alias("doc_id"), F.col("rank").alias("pagerank"))


def authority(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return pagerank(edges, nodes).join(inlinks(edges, nodes), "doc_id")


def merge_authority(old: DataFrame, new: DataFrame) -> DataFrame:
    """new over old; rows that new lacks stay, and an empty new changes nothing."""
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)
