"""The batch cycle: a small graph of DataFrame jobs over snapshot tables.

Each job reads the newest snapshots of the tables it names and writes new ones beside them. A snapshot counts once its
writer has committed it, so a job that fails leaves the last one as what is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import dedup, graph, index, queue, spell, upsert

LAYERS = (("news",), ("fingerprints",), ("links",), ("authority", "statistics", "dictionary"))
GLOBAL_JOBS = {"links", "authority", "statistics", "dictionary"}
#: Committed snapshots of a table that stay.
KEPT = 2
FIELDS = ("title", "description", "content")


def runs_global(role: str, total_nodes: int, node_index: int) -> bool:
    """Whether a node of a given role runs the global jobs."""
    role = role.strip().lower()
    if role in ("coordinator", "worker"):
        return role == "coordinator"
    return total_nodes == 1 or node_index == 0


def pause(interval: float, elapsed: float, failed: bool = False) -> float:
    return 15.0 if failed else max(1.0, interval - int(elapsed))


@dataclass
class Cycle:
    """root: directory of snapshots; tables documents, outgoing, tokens, articles, feeds, external and bodies (feed_url, body: what
    was fetched, null where that failed) must be there or in `given`. Tables in `given` win until a job writes them."""

    spark: SparkSession
    root: str
    given: dict[str, DataFrame] = field(default_factory=dict)

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[str]:
        """Committed snapshots of a table, oldest first."""
        at, files = self._files(f"{self.root}/{name}/*/_SUCCESS")
        return sorted(x.getPath().getParent().toString() for x in (files.globStatus(at) or ()))

    def read(self, name: str) -> DataFrame:
        if found := self.versions(name):
            return self.spark.read.parquet(found[-1])
        return self.given[name]

    def has(self, name: str) -> bool:
        return name in self.given or bool(self.versions(name))

    def write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}/{time.time_ns():020d}")
        for old in self.versions(name)[:-KEPT]:
            at, files = self._files(old)
            files.delete(at, True)

    def _done(self) -> DataFrame:
        return self.read("documents").filter("status = 'done'")

    def news(self) -> dict[str, DataFrame]:
        """Due feeds are read; their articles, tokens and metadata are merged, and empty articles filled from crawled pages. A feed
        whose body is missing or is no feed changes nothing but stays due."""
        as_of = F.lit(datetime.now(timezone.utc).replace(tzinfo=None))
        old, articles = self.read("feeds"), self.read("articles")
        due = queue.due(old, as_of).select("feed_url").join(self.read("bodies"), "feed_url")
        got = due.filter("body is not null").select("feed_url", "body").mapInPandas(markup.feed_parser(), f"feed_url string, {markup.FEED}").filter("ok")
        items = got.select("feed_url", F.explode("items").alias("i")).select("feed_url", "i.*").withColumnRenamed("image_url", "image").dropDuplicates(["url"])
        feeds = upsert.refresh_feeds(old, got.select("feed_url", "name", "link", F.col("image_url").alias("image"), "last_published"), as_of)
        merged = upsert.upsert_articles(articles, items, as_of)
        page = self._done().select("url", F.col("content").alias("page_content"))
        filled = upsert.backfill(merged, page, text.white_words(F.col("page_content")))
        rows = index.tokens(self._done().limit(0).transform(index.web_postings), index.news_postings(items))
        return {"feeds": feeds, "articles": filled, "tokens": index.replace_by_key(self.read("tokens"), rows, "article_url")}

    def authority(self) -> DataFrame:
        new = graph.authority(self.read("links"), self._done())
        return graph.merge_authority(self.read("authority"), new) if self.has("authority") else new

    def dictionary(self) -> DataFrame:
        new = spell.dictionary(spell.word_counts((self._done(), FIELDS), (self.read("articles"), FIELDS)), self.read("external"))
        return spell.apply_sync(spell.sync(self.read("dictionary"), new)) if self.has("dictionary") else new

    def fingerprints(self) -> DataFrame:
        new = dedup.simhash(self._done(), "id", "content")
        return index.replace_by_key(self.read("fingerprints"), new, "id") if self.has("fingerprints") else new

    def jobs(self) -> dict[str, Callable[[], DataFrame | dict[str, DataFrame]]]:
        return {
            "news": self.news,
            "fingerprints": self.fingerprints,
            "links": lambda: graph.resolve(self.read("outgoing"), self.read("documents")),
            "authority": self.authority,
            "statistics": lambda: index.term_statistics(self.read("tokens"), self.read("documents")),
            "dictionary": self.dictionary,
        }

    def run(self, role: str = "auto", total_nodes: int = 1, node_index: int = 0) -> dict[str, float]:
        """One cycle; jobs of a layer run side by side. Seconds of each job."""
        jobs, took = self.jobs(), {}
        everything = runs_global(role, total_nodes, node_index)

        def one(name: str) -> None:
            began = time.time()
            made = jobs[name]()
            for table, df in (made if isinstance(made, dict) else {name: made}).items():
                self.write(table, df)
            took[name] = time.time() - began

        for layer in LAYERS:
            names = [n for n in layer if everything or n not in GLOBAL_JOBS]
            if "news" in names and not self.has("bodies"):
                names.remove("news")
            if names:
                with ThreadPoolExecutor(len(names)) as pool:
                    list(pool.map(one, names))
        return took

    def run_every(self, interval: float, cycles: int | None = None, sleep: Callable[[float], None] = time.sleep, **node) -> list[str]:
        """Cycles at an interval, without end or for some number; one that fails is tried again after a short pause. What each came to."""
        seen: list[str] = []
        while cycles is None or len(seen) < cycles:
            began = time.time()
            try:
                self.run(**node)
                failed = False
            except Exception as e:  # a failed cycle must not end the service
                failed = True
                seen.append(f"failed: {type(e).__name__}")
            else:
                seen.append("done")
            if cycles is None or len(seen) < cycles:
                sleep(pause(interval, time.time() - began, failed))
            if cycles is None:
                del seen[:-100]
        return seen
