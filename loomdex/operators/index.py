"""Inverted index and corpus statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

WEB, NEWS = 1, 2


def web_postings(docs: DataFrame, only: list[str] | None = None, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, field, term, frequency) of title, description and content; `only`, or `where`, keeps some terms before anything is exploded."""
    if only is not None:
        where = lambda t: t.isin(*only)
    keep = lambda c: F.filter(text.terms(c), where) if where is not None else text.terms(c)
    fields = ((scores.FIELD_TITLE, "title"), (scores.FIELD_DESCRIPTION, "description"), (scores.FIELD_BODY, "content"))
    each = F.array(*(F.struct(F.lit(code).cast("short").alias("field"), keep(F.col(c)).alias("terms")) for code, c in fields))
    rows = docs.select(F.col("id").alias("doc_id"), F.explode(each).alias("f")).select("doc_id", "f.field", F.explode("f.terms").alias("term"))
    return rows.groupBy("doc_id", "field", "term").agg(F.count("*").cast("int").alias("frequency"))


def news_postings(articles: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(article_url, term, frequency) over title, description and content together."""
    whole = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "content")))
    found = F.filter(text.terms(whole), lambda t: t.isin(*only)) if only is not None else text.terms(whole)
    return articles.select(F.col("url").alias("article_url"), F.explode(found).alias("term")).groupBy("article_url", "term").agg(F.count("*").cast("int").alias("frequency"))


def tokens(web: DataFrame, news: DataFrame) -> DataFrame:
    """The token table of both sources: news rows have a null doc_id, field 4 and source type 2."""
    w = web.select("doc_id", "term", "field", "frequency", F.lit(None).cast("string").alias("article_url"), F.lit(WEB).cast("short").alias("source_type"))
    n = news.select(F.lit(None).cast("long").alias("doc_id"), "term", F.lit(scores.FIELD_BODY).cast("short").alias("field"), "frequency", "article_url", F.lit(NEWS).cast("short").alias("source_type"))
    return w.unionByName(n)


def news_layout(token_rows: DataFrame) -> DataFrame:
    """The news rows of a token table in a layout of their own: (article_url, term, frequency), one row for each article's term."""
    n = token_rows.filter((F.col("source_type") == NEWS) & F.col("article_url").isNotNull())
    return n.groupBy("article_url", "term").agg(F.max("frequency").alias("frequency"))


def term_statistics(token_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_frequency, idf, avg_doc_len). Only doc_id counts, so a term of news alone has frequency 0."""
    size = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avg_doc_len"))
    df = token_rows.groupBy("term").agg(F.countDistinct("doc_id").alias("doc_frequency"))
    return df.crossJoin(F.broadcast(size)).select("term", "doc_frequency", scores.idf(F.col("n"), F.col("doc_frequency")).alias("idf"), "avg_doc_len")  # one row of totals


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """term_statistics() of documents (unique ids) straight from their texts: a document's distinct terms are found in its
    row, so the only shuffle is that of partial counts."""
    every = F.array_distinct(F.concat(*(text.terms(F.col(c)) for c in ("title", "description", "content"))))
    df = docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("doc_frequency"))
    size = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.coalesce(F.avg("word_count"), F.lit(0.0)).alias("avg_doc_len"))
    return df.crossJoin(F.broadcast(size)).select("term", "doc_frequency", scores.idf(F.col("n"), F.col("doc_frequency")).alias("idf"), "avg_doc_len")  # one row of totals


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms: the stemmer sees each word once."""
    return terms.select("term").distinct().withColumn("stem", text.stem_udf("term"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new. Keys without new rows keep their old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_for_keys(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """As replace_by_key, but the old rows of every row of keys go, even where new has none."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)
