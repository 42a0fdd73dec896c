import pytest
from pyspark.sql import functions as F

from loomdex.api import WebIndex
from loomdex.functions.register import all_deletes, register
from loomdex.functions.text import stem, white_words
from loomdex.sources import tables


@pytest.fixture(scope="module")
def index(spark, sf_dir, tmp_path_factory):
    docs = tables.web(spark, sf_dir).withColumn("word_count", white_words(F.col("content")))
    external = spark.createDataFrame([("license", 40), ("the", 60)], "word string, external_frequency long")
    return WebIndex.build(spark, f"file://{tmp_path_factory.mktemp('index')}", docs, tables.articles(spark, sf_dir), tables.feeds(spark, sf_dir), external)


def test_search_matches_any_form_of_a_word(index):
    got = index.search_web("Licensing rights", 5)
    assert 0 < len(got["results"]) <= 5 and got["count"] >= len(got["results"])
    scores = [r["score"] for r in got["results"]]
    assert scores == sorted(scores, reverse=True)
    again = index.search_web("licensed RIGHT", 5)
    assert {r["url"] for r in again["results"]} == {r["url"] for r in got["results"]}


def test_pages(index):
    whole = index.search_web("the licensed rights", 100)["results"]
    assert index.search_web("the licensed rights", 3, 2)["results"] == whole[2:5]
    assert index.search_web("licensed", 20, 5000)["count"] >= 5000
    assert index.search_web("the of and") == {"count": 0, "results": []}
    with pytest.raises(ValueError):
        index.search_web("x", 101)


def test_news(index):
    got = index.search_news("licensed rights reserved", 4)
    assert all(r["url"].startswith("https://news.") and r["feed"]["feed_url"] for r in got["results"])
    assert all(len(r["feed"]["last_fetched"] or "2025-06-01T00:00:00+00:00") == 25 for r in got["results"]) and index.json_of(got).startswith('{"count"')
    assert index.text_of(got).startswith("[https://news.") if got["results"] else True


def test_spelling(index):
    assert index.spellcheck("Licence") == "License"
    assert index.spellcheck("LICENS", by_prefix=True) in ("LICENSE", "LICENSED")
    assert index.spellcheck("license") is None and index.spellcheck("12 !") is None


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("select stem('running'), osa_distance('teh', 'the'), normalize_url('Ex.com')").first() == (stem("running"), 1, "https://ex.com")
    assert {r.cut for r in spark.sql("select * from generate_deletes('abcd')").collect()} == all_deletes("abcd")
