"""The index as a service: search and spelling over its tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, search, spell


def stemmed(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Postings by stem: each distinct term is stemmed once, then frequencies add up."""
    return postings.join(index.stems(postings), "term").groupBy(*keys, F.col("stem").alias("term")).agg(F.sum("frequency").cast("int").alias("frequency"))


@dataclass
class WebIndex:
    """documents (id, url, title, description, content, status, word_count), articles, feeds; tokens, statistics and
    dictionary as build() makes them. Written tables, sorted by term, let a query's filter prune what is read."""

    spark: SparkSession
    documents: DataFrame
    articles: DataFrame
    feeds: DataFrame
    tokens: DataFrame
    statistics: DataFrame
    dictionary: DataFrame

    @classmethod
    def build(cls, spark: SparkSession, root: str, documents: DataFrame, articles: DataFrame, feeds: DataFrame, external: DataFrame) -> WebIndex:
        """Writes tokens, statistics and dictionary under root and opens them."""
        web = stemmed(index.web_postings(documents), ["doc_id", "field"])
        news = stemmed(index.news_postings(articles), ["article_url"])
        index.tokens(web, news).repartitionByRange("source_type", "term").sortWithinPartitions("source_type", "term").write.mode("overwrite").parquet(f"{root}/tokens")
        tokens = spark.read.parquet(f"{root}/tokens")
        index.term_statistics(tokens, documents).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{root}/statistics")
        text = ("title", "description", "content")
        spell.dictionary(spell.word_counts((documents, text), (articles, text)), external).repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{root}/dictionary")
        return cls(spark, documents, articles, feeds, tokens, spark.read.parquet(f"{root}/statistics"), spark.read.parquet(f"{root}/dictionary"))

    def _hits(self, q: str, source: int) -> tuple[search.Query, tuple[str, ...], DataFrame, DataFrame]:
        query = search.Query.of(q)
        stems = query.stems()
        own = F.col("term").isin(*stems)
        return query, stems, self.tokens.filter(own & (F.col("source_type") == source)), self.statistics.filter(own)

    def search_web(self, q: str, limit: int = 20, offset: int = 0) -> dict:
        """{count, results}: a page of at most 100 ranked documents; count is what has been seen, at most the candidates or the page's end."""
        search.validate(q, limit, offset)
        query, stems, tokens, stats = self._hits(q, index.WEB)
        if not stems:
            return {"count": 0, "results": []}
        found = search.web_candidates(tokens, self.documents, stats, limit, offset).cache()
        try:
            page = [r.asDict() for r in search.page(search.rank_web(found, query, len(stems)), limit, offset).collect()]
            return {"count": search.result_count(found.count(), len(page), offset), "results": page}
        finally:
            found.unpersist()

    def search_news(self, q: str, limit: int = 20, offset: int = 0) -> dict:
        """{count, results} of news articles, with their feeds, in the order of token scores."""
        search.validate(q, limit, offset)
        query, stems, tokens, stats = self._hits(q, index.NEWS)
        if not stems:
            return {"count": 0, "results": []}
        found = search.news_candidates(tokens, self.articles, self.feeds, stats, limit, offset).cache()
        try:
            rows = search.score_news(found, query, len(stems)).orderBy(F.desc("token_score"), "url")
            page = [r.asDict(recursive=True) for r in search.page(rows, limit, offset).collect()]
            return {"count": search.result_count(found.count(), len(page), offset), "results": page}
        finally:
            found.unpersist()

    @staticmethod
    def json_of(response: dict) -> str:
        """A response as JSON text; times are ISO-8601 in UTC."""
        return json.dumps(response, ensure_ascii=False, default=lambda t: t.replace(tzinfo=t.tzinfo or timezone.utc).isoformat())

    def text_of(self, response: dict) -> str:
        """A response as text: `[url](title)`, the description and an empty line for each result."""
        return "".join(f"[{r['url']}]({r['title']})\n{r['description']}\n\n" for r in response["results"]).strip()

    def spellcheck(self, q: str, by_prefix: bool = False) -> str | None:
        """q with its misspelt words corrected, or None; candidates by trigrams or, as a fallback, by first letter."""
        one = self.spark.createDataFrame([(0, q)], "qid int, q string")
        asked = spell.suspects(spell.query_words(one), self.dictionary).select("input_word").distinct()
        find = spell.prefix_candidates if by_prefix else spell.trigram_candidates
        fixed = spell.corrections(asked, find(asked, self.dictionary), self.dictionary)
        return spell.suggest(one, fixed).first()["suggestion"]
