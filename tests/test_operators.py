from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex.operators import dedup, graph, index, queue, search, spell, upsert
from loomdex.plans.batch import Cycle
from loomdex.sources import files, tables
from loomdex.sources.tables import AS_OF
from loomdex.streaming import ingest


def test_pagerank_loses_dangling_mass(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 2)], "source_doc_id long, target_doc_id long")
    got = {r.doc_id: r.pagerank for r in graph.pagerank(edges, nodes).collect()}
    assert got == {1: pytest.approx(0.075), 2: pytest.approx(0.13875)}
    assert graph.pagerank(edges, nodes.limit(0)).count() == 0


def test_pagerank_sum_is_at_most_one(spark, sf_dir):
    from loomdex.plans import queries

    assert queries.pagerank(spark, sf_dir).agg(F.sum("pagerank")).first()[0] <= 1 + 1e-9


def test_merge_authority_keeps_stale_rows(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.5)], "doc_id long, pagerank double")
    new = spark.createDataFrame([(2, 0.9)], "doc_id long, pagerank double")
    assert sorted(map(tuple, graph.merge_authority(old, new).collect())) == [(1, 0.5), (2, 0.9)]


def test_simhash_of_empty_text(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in dedup.simhash(df).collect()}
    assert got[1] == got[2] == 0 and got[3] != 0


def test_idf_falls_with_frequency(spark):
    from loomdex.functions.scores import idf

    v = [r[0] for r in spark.range(1, 50).select(idf(F.lit(50), F.col("id"))).collect()]
    assert v == sorted(v, reverse=True)


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], "id long, url string, title string").selectExpr("id", "url", "url canonical_url", "title", "timestamp'2024-01-01' created_at")
    new = spark.createDataFrame([("u2", "c"), ("u3", "d"), ("u0", "e")], "url string, title string")
    once = upsert.upsert_documents(old, new, F.lit(AS_OF))
    twice = upsert.upsert_documents(once, new, F.lit(AS_OF))
    assert sorted((r.id, r.url, r.title) for r in once.collect()) == [(1, "u1", "a"), (2, "u2", "c"), (3, "u0", "e"), (4, "u3", "d")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_latest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "url string, seq int")
    assert sorted(map(tuple, upsert.latest(df, "url", "seq").collect())) == [("a", 3), ("b", 2)]


def test_replace_for_keys_clears_empty_ones(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, term string")
    new = spark.createDataFrame([(3, "c")], "doc_id long, term string")
    keys = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert sorted(map(tuple, index.replace_for_keys(old, new, keys, "doc_id").collect())) == [(2, "b"), (3, "c")]


def test_sync_applied_gives_new(spark):
    schema = "word string, doc_frequency long, total_frequency long, external_frequency long, popularity_score double"
    old = spark.createDataFrame([("a", 0, 1, 0, 1.0), ("b", 0, 2, 0, 2.0)], schema)
    new = spark.createDataFrame([("b", 0, 3, 0, 2.5), ("c", 0, 1, 0, 1.0)], schema)
    feed = spell.sync(old, new)
    assert {r.word: r.action for r in feed.collect()} == {"a": "delete", "b": "update", "c": "insert"}
    assert sorted(map(tuple, spell.apply_sync(feed).collect())) == sorted(map(tuple, new.collect()))


def test_slots_match_the_loop(spark):
    at = [("d", i, float(t)) for i, t in enumerate([0, 0, 1, 9, 9, 9, 30])]
    got = {r.id: r.slot for r in queue.slots(spark.createDataFrame(at, "k string, id long, at double"), "k", "at", 2.0).collect()}
    free, want = float("-inf"), {}
    for _, i, t in at:
        want[i] = max(t, free)
        free = want[i] + 2.0
    assert got == want


def test_queue(spark):
    found = spark.createDataFrame([("u1", "d"), ("u1", "d"), ("u2", "d")], "url string, domain string")
    q = queue.enqueue(queue.empty_queue(spark), found)
    assert queue.enqueue(q, found).count() == 2
    p = queue.dequeue(q, queue.sample(q, 1, 3), F.lit(AS_OF))
    assert {r.status: r["count"] for r in p.groupBy("status").count().collect()} == {"queued": 1, "in_progress": 1}
    assert queue.dequeue(p, p, F.lit(AS_OF)).agg(F.sum("attempt_count")).first()[0] == 2


@pytest.mark.parametrize("code,kind,body,valid,want", [
    (404, "text/html", "", True, "non_success_status_error"), (200, "application/rss+xml", "x", False, "done"), (200, "text/xml", "  <rss>", False, "done"),
    (200, "text/xml", "<html>", True, "processing_error"), (200, "application/xhtml+xml", "<html>", True, "processing_error"), (200, "image/png", "", True, "processing_error"),
    (200, "text/html", "", False, "validation_error"), (200, "text/html", "", True, "done"),
])
def test_route(spark, code, kind, body, valid, want):
    assert spark.range(1).select(queue.route(F.lit(code), F.lit(kind), F.lit(body), F.lit(valid))).first()[0] == want


def test_search_without_terms(spark, sf_dir):
    assert search.Query.of("the of").words == ()


def test_external_limit_counts_accepted_rows(spark):
    lines = spark.createDataFrame([("the 0", 1), ("you 5", 2), ("x 9", 3), ("are 7", 4)], "value string, rank long")
    assert [r.word for r in spell.external_counted(lines, 1, 1.0).collect()] == ["you"]


def test_files(spark, tmp_path):
    (tmp_path / "w.txt").write_text("b\n\n a \n")
    assert [tuple(r) for r in files.text_lines(spark, f"file://{tmp_path}/w.txt").orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    assert files.text_lines(spark, f"file://{tmp_path}/none.txt").count() == 0
    lex = spark.createDataFrame([("a", 0, 1, 0, 1.0), ("b", 0, 2, 0, 2.0)], files.LEXICON)
    files.write_lexicon(lex, f"file://{tmp_path}/lex", 1)
    assert [r.word for r in files.read_lexicon(spark, f"file://{tmp_path}/lex").collect()] == ["b"]
    assert files.read_lexicon(spark, f"file://{tmp_path}/none").count() == 0
    assert spark.range(1).select(files.image_text(F.lit(b"abc")), files.image_text(F.lit(None).cast("binary"))).first() == ("YWJj", "")


def test_batch_cycle(spark, sf_dir, tmp_path):
    docs = tables.web(spark, sf_dir).withColumn("word_count", F.lit(3))
    c = Cycle(spark, f"file://{tmp_path}", {"documents": docs, "outgoing": tables.outgoing(spark, sf_dir), "tokens": index.tokens(index.web_postings(docs), index.news_postings(tables.articles(spark, sf_dir))), "articles": tables.articles(spark, sf_dir), "external": spark.createDataFrame([("the", 5)], "word string, external_frequency long")})
    assert set(c.run("worker")) == {"fingerprints"}
    assert set(c.run()) == {"fingerprints", "links", "authority", "statistics", "dictionary"}
    assert c.read("authority").count() == docs.filter("status = 'done'").count()


def test_failing_job_leaves_the_last_snapshot(spark, tmp_path):
    lexicon = "word string, external_frequency long"
    docs = spark.createDataFrame([(1, "u", "alpha beta", "", "alpha", "done", 2)], "id long, url string, title string, description string, content string, status string, word_count int")
    articles = docs.select("url", "title", "description", "content").limit(0)
    c = Cycle(spark, f"file://{tmp_path}", {"documents": docs, "articles": articles, "external": spark.createDataFrame([], lexicon)})
    c.write("dictionary", c.dictionary())
    before = sorted(map(tuple, c.read("dictionary").collect()))
    assert {r[0] for r in before} == {"alpha", "beta"}
    fail = F.udf(lambda x: 1 // 0, "long")
    with pytest.raises(Exception):
        c.write("dictionary", c.read("dictionary").withColumn("total_frequency", fail("word")))
    assert sorted(map(tuple, c.read("dictionary").collect())) == before
    c.given["documents"] = docs.limit(0)  # a rebuild that finds no words changes nothing
    c.write("dictionary", c.dictionary())
    assert sorted(map(tuple, c.read("dictionary").collect())) == before
    for _ in range(4):
        c.write("dictionary", c.read("dictionary"))
    assert len(c.versions("dictionary")) == 2 and sorted(map(tuple, c.read("dictionary").collect())) == before


def test_authority_keeps_what_a_cycle_lacks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "done"), (2, "done")], "id long, status string")
    links = spark.createDataFrame([(1, 2)], "source_doc_id long, target_doc_id long")
    c = Cycle(spark, f"file://{tmp_path}", {"documents": docs, "links": links})
    c.write("authority", c.authority())
    c.given["documents"] = docs.filter("id = 2")
    c.write("authority", c.authority())
    assert {r.doc_id for r in c.read("authority").collect()} == {1, 2}


def test_cycles_go_on_after_a_failure(spark, tmp_path):
    c = Cycle(spark, f"file://{tmp_path}")
    slept = []
    assert c.run_every(60, 2, slept.append) == ["failed: KeyError"] * 2 and slept == [15.0]


def test_news_job(spark, tmp_path):
    """Items of due feeds become articles with tokens; a failed fetch and a body that is no feed change nothing."""
    feeds = spark.createDataFrame([("https://a.org/f", None), ("https://b.org/f", "B"), ("https://c.org/f", "C"), ("https://d.org/f", "later")], "feed_url string, name string")
    feeds = feeds.selectExpr("feed_url", "name", "cast(null as string) link", "cast(null as string) image", "cast(null as timestamp) last_published", "cast(null as timestamp) last_fetched", "case when name = 'later' then timestamp'2999-01-01' end next_fetch_at")
    old = spark.createDataFrame([("https://a.org/1", "old", "", "")], "url string, title string, description string, content string").selectExpr("url", "'https://a.org/f' feed_url", "title", "description", "'' image", "content", "'' author", "timestamp'2024-01-01' published_at", "timestamp'2024-01-02' updated_at")
    xml = "<rss><channel><title>A</title><item><link>/1</link><title>new alpha</title></item><item><link>/2</link><title>beta</title></item></channel></rss>"
    bodies = spark.createDataFrame([("https://a.org/f", xml), ("https://b.org/f", None), ("https://c.org/f", "oops"), ("https://d.org/f", xml)], "feed_url string, body string")
    docs = spark.createDataFrame([(1, "https://a.org/2", "t", "d", "word " * 150, "done", 150)], "id long, url string, title string, description string, content string, status string, word_count int")
    tokens = index.tokens(index.web_postings(docs), index.news_postings(old))
    c = Cycle(spark, f"file://{tmp_path}", {"feeds": feeds, "articles": old, "bodies": bodies, "documents": docs, "tokens": tokens})
    assert set(c.run("worker")) == {"news", "fingerprints"}
    got = {r.url: r for r in c.read("articles").collect()}
    assert set(got) == {"https://a.org/1", "https://a.org/2"} and got["https://a.org/1"].title == "new alpha" and len(got["https://a.org/2"].content) == 750
    state = {r.feed_url[8]: (r.name, r.last_fetched is not None) for r in c.read("feeds").collect()}
    assert state == {"a": ("A", True), "b": ("B", False), "c": ("C", False), "d": ("later", False)}
    news = {(r.article_url[-1], r.term) for r in c.read("tokens").filter("source_type = 2").collect()}
    assert news == {("1", "new"), ("1", "alpha"), ("2", "beta")} and c.read("tokens").filter("source_type = 1").count() > 0


def test_lexicon_document(spark):
    import json

    lex = spark.createDataFrame([("a", 0, 1, 0, 1.0), ("b", 0, 2, 0, 2.0), ("c", 0, 2, 0, 2.0)], files.LEXICON)
    got = json.loads(files.lexicon_document(lex, F.lit(AS_OF), 2).first().value)
    assert got["generated_at"] == "2025-06-01T00:00:00Z" and [w["word"] for w in got["words"]] == ["b", "c"]
    assert json.loads(files.lexicon_document(lex.limit(0), F.lit(AS_OF)).first().value)["words"] == []


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from loomdex.sources import shared

    bare = SimpleNamespace(get=lambda *_: None)
    undefined = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined))
    far = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(_jsc=jsc, getConf=lambda: bare, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared.checkpoints(far)


def test_stream_ingest_equals_batch(spark, sf_dir, tmp_path):
    fetched = tables.fetched(spark, sf_dir).select(*[x.split()[0] for x in ingest.FETCHED.split(", ")]).withColumns({"page_id": F.col("page_id").cast("long"), "status_code": F.col("status_code").cast("int")})
    fetched.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    q = ingest.ingest(spark, f"file://{tmp_path}/in", AS_OF, lambda df, _: seen.extend((r.page_id, r.status) for r in df.select("page_id", "status").collect()), f"file://{tmp_path}/ck", 1)
    q.awaitTermination()
    want = [(r.page_id, r.status) for r in ingest.parsed(fetched, AS_OF).select("page_id", "status").collect()]
    assert sorted(seen) == sorted(want)


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = tables.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    q = ingest.status_counts(stream).writeStream.outputMode("complete").format("memory").queryName("ev").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.awaitTermination()
    assert spark.table("ev").agg(F.sum("n")).first()[0] == events.count()


def test_stateful_rate_limit(spark, tmp_path):
    rows = pd.DataFrame({"key": ["a"] * 4 + ["b"], "id": [0, 1, 2, 3, 4], "at": [0.0, 0.5, 9.0, 9.0, 0.0]})
    spark.createDataFrame(rows, "key string, id long, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, id long, at double").parquet(f"file://{tmp_path}/in")
    q = ingest.rate_limited(stream, 2.0).writeStream.format("memory").queryName("slots").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.slot for r in spark.table("slots").collect()} == {0: 0.0, 1: 2.0, 2: 9.0, 3: 11.0, 4: 0.0}


def test_backfill_needs_words(spark):
    a = spark.createDataFrame([("u", None), ("v", "x")], "url string, content string")
    pages = spark.createDataFrame([("u", "w " * 120), ("v", "w " * 200)], "url string, page_content string")
    got = upsert.backfill(a, pages, F.size(F.split(F.trim("page_content"), " ")))
    assert {r.url: len(r.content) for r in got.collect()} == {"u": 240, "v": 1}


def test_due_order(spark):
    f = spark.createDataFrame([("a", datetime(2025, 5, 1), None), ("b", None, None), ("c", datetime(2026, 1, 1), None)], "feed_url string, next_fetch_at timestamp, last_fetched timestamp")
    assert [r.feed_url for r in queue.due(f, F.lit(AS_OF)).collect()] == ["b", "a"]


def test_lines_over_many_blocks(spark, tmp_path):
    lines = [f"w{i}" if i % 7 else " \t" for i in range(3000)]
    (tmp_path / "w.txt").write_bytes(b"\r\n".join(x.encode() for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(f"file://{tmp_path}/w.txt").rdd.getNumPartitions() > 1
        got = [tuple(r) for r in files.text_lines(spark, f"file://{tmp_path}/w.txt").orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(x, i) for i, x in enumerate((x for x in lines if x.strip()), 1)]


def test_lexicon_is_read_again_when_written(spark, tmp_path):
    lex = spark.createDataFrame([("a", 0, 1, 0, 1.0), ("b", 0, 2, 0, 2.0)], files.LEXICON)
    cache = files.LexiconCache(spark, f"file://{tmp_path}/lex")
    assert cache.words().count() == 0
    files.write_lexicon(lex, f"file://{tmp_path}/lex", 1)
    first = cache.words()
    assert [r.word for r in first.collect()] == ["b"] and cache.words() is first
    files.write_lexicon(lex, f"file://{tmp_path}/lex")
    assert cache.words().count() == 2


def test_crawl_sink(spark, tmp_path):
    """Two micro-batches: a page, its later fetch, an invalid page, a feed, and a replay of the last batch."""
    html = "<html><head><title>{0}</title><meta name='description' content='d'><link rel='alternate' type='application/rss+xml' href='/rss.xml'></head><body><p>{1}</p><a href='https://b.example.org/x'>x</a></body></html>"
    long, short = "alpha beta " * 80, "gamma"
    page = lambda i, url, title, body: (i, url, 200, "text/html", html.format(title, body))
    a, b, feed, gone = "https://a.example.org/", "https://a.example.org/b", "https://a.example.org/atom", "https://a.example.org/gone"
    batches = [
        [page(1, a, "old", long), page(2, a, "new", long), page(3, b, "b", short)],
        [(4, feed, 200, "application/atom+xml", "<feed/>"), (5, gone, 404, "text/html", ""), page(6, b, "b", "delta " * 130), page(7, a, "newest", "delta " * 130)],
    ]
    doc = "id long, url string, canonical_url string, title string, description string, content string, published_at timestamp, updated_at timestamp, word_count int, quality_score double, freshness_score double, status string, created_at timestamp"
    none = lambda schema: spark.createDataFrame([], schema)
    tokens = index.tokens(index.web_postings(none(doc)), index.news_postings(spark.createDataFrame([("n", "kept", "", "")], "url string, title string, description string, content string")))
    given = {
        "documents": spark.createDataFrame([(41, "https://z.example.org/", "c", "z", "z", "z", None, None, 1, 0.0, 0.0, "done", None)], doc),
        "tokens": tokens, "outgoing": none("source_doc_id long, target_url string"),
        "feeds": none("feed_url string, home_url string, discovered_by_url string"),
        "articles": spark.createDataFrame([(b, None), (a, "own")], "url string, content string"),
        "queue": queue.enqueue(queue.empty_queue(spark), spark.createDataFrame([(u, "example.org") for u in (a, b, feed, gone)], "url string, domain string")),
    }
    cycle = Cycle(spark, f"file://{tmp_path}/tables", given)
    sink = ingest.crawl_sink(cycle, AS_OF)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ingest.FETCHED).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        q = ingest.ingest(spark, f"file://{tmp_path}/in{i}", AS_OF, sink, f"file://{tmp_path}/ck{i}")
        q.awaitTermination()
        if i == 0:
            assert {r.url: (r.id, r.title) for r in cycle.read("documents").collect()} == {"https://z.example.org/": (41, "z"), a: (42, "new")}

    def state():
        read = lambda name, *cols: sorted(map(tuple, cycle.read(name).select(*cols).collect()), key=repr)
        return read("documents", "id", "url", "title", "created_at"), read("tokens", "doc_id", "term", "field", "frequency", "article_url"), read("outgoing", "*"), read("feeds", "*"), read("articles", "*"), read("queue", "url", "status")

    after = state()
    docs, terms, links, feeds, articles, todo = after
    assert [r[:3] for r in docs] == [(41, "https://z.example.org/", "z"), (42, a, "newest"), (43, b, "b")]
    mine = {r[1:4] for r in terms if r[0] == 42}
    assert {("newest", 1, 1), ("delta", 4, 130)} <= mine and not {t for t, _, _ in mine} & {"alpha", "beta", "new", "old"} and any(r[4] == "n" and r[1] == "kept" for r in terms)
    assert links == [(42, "https://b.example.org/x"), (43, "https://b.example.org/x")]
    assert sorted(feeds) == sorted([("https://a.example.org/rss.xml", a, a), (feed, feed, feed)])
    assert dict(articles)[a] == "own" and dict(articles)[b].startswith("delta")
    assert dict(todo) == {a: "done", b: "done", feed: "done", gone: "non_success_status_error", "https://b.example.org/x": "queued"}
    sink(ingest.parsed(spark.createDataFrame(batches[1], ingest.FETCHED), AS_OF), 1)
    assert state() == after
