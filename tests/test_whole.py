"""Queries over a few documents, held against plain Python: no word, row or id is left out."""

from itertools import combinations

import pytest

from loomdex.plans import queries


@pytest.fixture()
def small(spark, tmp_path):
    """A folder whose documents table has the given texts, numbered from 0."""

    def make(*texts):
        rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def test_deletes_of_words_of_any_length(spark, small):
    words = {"ab", "letter", "eightlet", "ninechars", "abcdefghijklmnopqrstuvwxyzabcdef"}
    got = queries.spell_generate_deletes(spark, small(*sorted(words))).collect()
    # a string under two characters isn't shortened: of a two-letter word only one may go
    cut = lambda w, k: {"".join(c for i, c in enumerate(w) if i not in out) for out in combinations(range(len(w)), k)}
    want = {(w, x) for w in words for k in (1, 2) if len(w) > k for x in cut(w, k)}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_backfill_counts_tokens_of_every_document(spark, small):
    got = queries.migration_token_backfill(spark, small("alpha beta beta", "gamma", "delta alpha")).collect()
    web = {r.field: (r.n, r.tokens, r.with_doc) for r in got if r.source_type == 1}
    assert web == {f: (5, 6, 5) for f in (1, 2, 4)}


def test_every_document_is_an_article(spark, small):
    at = small("license alpha", "license beta", "license gamma", "nothing", "license delta")
    assert {r.url for r in queries.news_search(spark, at).collect()} == {f"https://news.example.org/{i}" for i in (0, 1, 2, 4)}
    count = {r.word: r.total_frequency for r in queries.spell_words(spark, at).collect()}
    assert (count["license"], count["beta"], count["nothing"]) == (23, 6, 6)  # article 0 has no description
    for query in (queries.backfill_content, queries.upsert_articles):
        assert {r.url[-1] for r in query(spark, at).collect()} == set("01234")
    assert {r.article_url[-1] for r in queries.replace_news_tokens(spark, at).collect()} == set("01234")
    assert [(r.n, r.tokens) for r in queries.migration_token_backfill(spark, at).collect() if r.source_type == 2] == [(9, 25)]


def test_every_document_has_a_shard(spark, small):
    assert {tuple(r) for r in queries.shard_assignment(spark, small(*"abcdef")).collect()} == {(i, i % 4) for i in range(6)}


def test_lexicon_is_exported_to_its_production_size(spark, small):
    words = {"word" + a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    assert words <= {r.word for r in queries.spell_meta_topn(spark, small(" ".join(sorted(words)))).collect()}
