"""The registry of queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, scores, spelling, text, urls
from ..operators import dedup, graph, index, queue, search, spell, upsert
from ..sources import files, tables
from ..sources.tables import AS_OF
from ..streaming import ingest

QUERY = "the only Of shansher rely apache license"
STEM_QUERY = "licensed licenses released rights"
MISSPELT = ("licens", "teh", "thta", "tokne", "relased", "wiht", "reserveed", "zzqqx", "an", "apahce")
SUGGEST = ("Teh LICENS was relased", "all good with that", "Apahce licens TOKNE", "")
COUNTED = ("the 22,761", "you 20,000", "zero 0", "a 99", "bad x1", "token 400", "the 5")
RANKED = ("the", "token", "x", "license", "n0t", "apache")
QUEUE_N, SEED, GAP = 40, 7, 3600.0


def _web(s, d):
    """Web documents with their word count."""
    return tables.web(s, d).withColumn("word_count", text.white_words(F.col("content")))


def tokenize_terms(s, d):
    return tables.documents(s, d).select("doc_id", F.explode(text.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def term_freq_by_field(s, d):
    return index.web_postings(tables.web(s, d)).select("doc_id", F.col("field").cast("int").alias("field"), "term", "frequency")


def term_statistics(s, d):
    t = index.corpus_statistics(_web(s, d))
    return t.select("term", "doc_frequency", F.round("idf", 9).alias("idf"), F.round("avg_doc_len", 6).alias("avg_doc_len"))


def token_statistics(s, d):
    """The same statistics from a token table."""
    t = index.term_statistics(index.web_postings(tables.web(s, d)), _web(s, d))
    return t.select("term", "doc_frequency", F.round("idf", 9).alias("idf"), F.round("avg_doc_len", 6).alias("avg_doc_len"))


def _search(s, d, words=None):
    """Postings of the query's terms, documents, and the statistics of those terms."""
    words = list(words or search.Query.of(QUERY).words)
    docs = _web(s, d)
    postings = index.web_postings(docs, words)
    return postings, docs, index.term_statistics(postings, docs)


def web_search_candidates(s, d):
    c = search.web_candidates(*_search(s, d))
    return c.select("title", "description", "url", F.round("token_score", 6).alias("token_score"), "matched_terms")


def web_search_ranked(s, d):
    q = search.Query.of(QUERY)
    r = search.rank_web(search.web_candidates(*_search(s, d)), q, len(q.words))
    return r.select("url", "title", F.round("score", 6).alias("score"))


def web_search_page(s, d):
    q = search.Query.of(QUERY)
    r = search.rank_web(search.web_candidates(*_search(s, d), 10, 10), q, len(q.words))
    return search.page(r, 10, 10).select("url", F.round("score", 6).alias("score"))


def web_search_textless(s, d):
    q = search.Query.of(QUERY)
    r = search.rank_textless(search.web_candidates(*_search(s, d)), len(q.words))
    return r.select(F.round("score", 6).alias("score"))


def web_search_stemmed(s, d):
    """Search over stemmed terms: the vocabulary is stemmed, its forms of the query's stems are retrieved, and counts add up by stem."""
    q = search.Query.of(STEM_QUERY)
    docs = _web(s, d)
    hits = search.stemmed_postings(docs, q.stems())
    c = search.web_candidates(hits, docs, index.term_statistics(hits, docs))
    return search.rank_web(c, q, len(q.stems())).select("url", F.round("score", 6).alias("score"))


def stem_vocabulary(s, d):
    words = tables.documents(s, d).select(F.explode(text.distinct_terms(F.col("text"))).alias("term"))
    return index.stems(words)


def news_search(s, d):
    q = search.Query.of(QUERY)
    words = list(q.words)
    articles, docs = tables.articles(s, d), _web(s, d)
    postings = index.news_postings(articles, words)
    stats = index.term_statistics(index.tokens(index.web_postings(docs, words), postings), docs)
    c = search.score_news(search.news_candidates(postings, articles, tables.feeds(s, d), stats), q, len(words))
    return c.select("url", "title", "description", "author", F.col("feed.feed_url").alias("feed_url"), F.col("feed.home_url").alias("home_url"), F.round("token_score", 6).alias("token_score"), "matched_terms", F.round("score", 6).alias("score"))


def news_idf_df_zero(s, d):
    """Statistics over the tokens of both sources: terms of news alone have frequency 0."""
    docs = _web(s, d).filter("id % 4 <> 0")
    t = index.tokens(index.web_postings(docs), index.news_postings(tables.articles(s, d)))
    return index.term_statistics(t, docs).filter("doc_frequency = 0").select("term", "doc_frequency", F.round("idf", 9).alias("idf"))


def _words(s, d):
    return spell.word_counts((tables.web(s, d), ("title", "description", "content")), (tables.articles(s, d), ("title", "description", "content")))


def spell_words(s, d):
    return _words(s, d)


def _lines(s, rows):
    return s.createDataFrame([(x, i + 1) for i, x in enumerate(rows)], "value string, rank long")


def _external(s):
    return spell.external_scores(spell.external_counted(_lines(s, COUNTED), 50_000, 1.0), spell.external_ranked(_lines(s, RANKED), 20_000, 1.0))


def spell_external_scores(s, d):
    return _external(s)


def _dictionary(s, d):
    return spell.dictionary(_words(s, d), _external(s))


def _lexicon_out(df):
    return df.select("word", "doc_frequency", "total_frequency", "external_frequency", F.round("popularity_score", 9).alias("popularity_score"))


def spell_dictionary(s, d):
    return _lexicon_out(_dictionary(s, d))


def spell_meta_topn(s, d):
    return _lexicon_out(files.top_words(_dictionary(s, d)))


def _inputs(s):
    return s.createDataFrame([(w,) for w in MISSPELT], "input_word string")


def spell_candidates_trigram(s, d):
    return spell.trigram_candidates(_inputs(s), _dictionary(s, d)).select("input_word", "word", "total_frequency", F.round("similarity", 6).alias("similarity"))


def spell_candidates_prefix(s, d):
    return spell.prefix_candidates(_inputs(s), _dictionary(s, d)).select("input_word", "word", F.round("popularity_score", 9).alias("popularity_score"))


def spell_corrections(s, d):
    lex = _dictionary(s, d)
    return spell.corrections(_inputs(s), spell.trigram_candidates(_inputs(s), lex), lex)


def spell_suspects(s, d):
    return spell.suspects(_inputs(s), _dictionary(s, d))


def spell_suggest(s, d):
    q = s.createDataFrame(list(enumerate(SUGGEST)), "qid int, q string")
    lex = _dictionary(s, d)
    asked = spell.suspects(spell.query_words(q), lex).select("input_word").distinct()
    return spell.suggest(q, spell.corrections(asked, spell.trigram_candidates(asked, lex), lex))


def spell_generate_deletes(s, d):
    return _words(s, d).select("word", F.explode(spelling.deletes(F.col("word"))).alias("cut"))


def dictionary_sync_diff(s, d):
    """The change feed from a lexicon of older documents to that of all."""
    old = spell.dictionary(spell.word_counts((tables.web(s, d).filter("id % 3 <> 0"), ("title", "description", "content"))), _external(s))
    old = old.unionByName(s.createDataFrame([("goneword", 0, 3, 0, 1.0)], old.schema))
    new = spell.dictionary(spell.word_counts((tables.web(s, d), ("title", "description", "content"))), _external(s))
    return spell.sync(old, new).select("word", "total_frequency", "action")


def link_graph(s, d):
    return graph.resolve(tables.outgoing(s, d), tables.web(s, d))


def _done(s, d):
    return tables.web(s, d).filter("status = 'done'").select("id")


def inlink_counts(s, d):
    return graph.inlinks(link_graph(s, d), _done(s, d))


def pagerank(s, d):
    return graph.pagerank(link_graph(s, d), _done(s, d)).select("doc_id", F.round("pagerank", 12).alias("pagerank"))


def simhash_fingerprints(s, d):
    return dedup.simhash(tables.documents(s, d))


def url_normalize(s, d):
    return tables.table(s, d, "pages").select("page_id", "url").withColumn("normal", urls.normalize_url_udf("url"))


def registrable_domain(s, d):
    return tables.table(s, d, "pages").select("page_id", urls.registrable_domain(F.col("url")).alias("domain"))


def _parsed(s, d):
    return ingest.parsed(tables.fetched(s, d), AS_OF)


def _pages(s, d):
    """Every page as fetched, parsed whatever its route."""
    return tables.fetched(s, d).withColumn("p", markup.page_parser(AS_OF)(F.col("url"), F.col("body"))).select("page_id", "p.*")


def page_parse_title_links(s, d):
    return _pages(s, d).select("page_id", "title", "description", F.size("links").alias("n_links"), "published_at", "updated_at")


def page_links(s, d):
    return _pages(s, d).select("page_id", F.posexplode("links").alias("at", "link"))


def page_feed_links(s, d):
    return _pages(s, d).select("page_id", F.explode("feed_links").alias("feed_url"))


def page_content(s, d):
    """Main text of every page without its white space, which the oracle can't place."""
    return _pages(s, d).select("page_id", F.md5(F.regexp_replace("content", r"\s", "")).alias("content_md5"))


def page_status_routing(s, d):
    return _parsed(s, d).select("page_id", "status")


def quality_freshness(s, d):
    w = _web(s, d).withColumn("updated_at", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(days=(F.col("id") % 700).cast("int"))))
    w = w.withColumn("published_at", F.when(F.col("id") % 10 == 0, F.to_timestamp(F.lit("2025-01-01"))))
    q = scores.quality(F.col("word_count"), F.col("id") % 50)
    return w.select("id", "word_count", F.round(q, 9).alias("quality"), F.round(scores.freshness(F.col("updated_at"), F.col("published_at"), F.lit(AS_OF)), 9).alias("freshness"))


def _queue(s, d):
    found = tables.table(s, d, "pages").select(urls.normalize_url_udf("url").alias("url")).withColumn("domain", urls.registrable_domain(F.col("url")))
    return queue.enqueue(queue.empty_queue(s), found)


def queue_enqueue(s, d):
    return _queue(s, d).select("url", "domain", "status", "attempt_count")


def queue_dequeue(s, d):
    """A deterministic sample goes to in_progress."""
    q = _queue(s, d)
    return queue.dequeue(q, queue.sample(q, QUEUE_N, SEED), F.lit(AS_OF)).select("url", "status", "attempt_count", "last_attempt")


def queue_status_counts(s, d):
    q = _queue(s, d)
    results = _parsed(s, d).select(urls.normalize_url_udf("url").alias("url"), F.col("status").alias("new_status")).groupBy("url").agg(F.max("new_status").alias("new_status"))
    q = queue.update_status(queue.dequeue(q, q, F.lit(AS_OF)), results, F.lit(AS_OF))
    return q.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))


def rate_limit_slots(s, d):
    e = tables.table(s, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_timestamp("ts").cast("double").alias("at"))
    return queue.slots(e, "user_id", "at", GAP).select("id", "user_id", "at", "slot")


def feeds_due(s, d):
    f = queue.due(tables.feeds(s, d), F.lit(AS_OF))
    return f.select("feed_url", "next_fetch_at", "last_fetched")


def shard_assignment(s, d):
    """Every document with its shard by id, one of four."""
    return tables.web(s, d).select("id", F.pmod("id", F.lit(4)).cast("long").alias("shard"))


def feed_shards(s, d):
    return tables.feeds(s, d).select("feed_url", queue.shard_of(F.col("feed_url"), 4).alias("shard"))


def _snapshot(s, d):
    """Documents as stored: every second one, with an older title."""
    rows = tables.web(s, d).filter("id % 2 = 0")
    return rows.selectExpr("id", "url", "url canonical_url", "concat('old ', title) title", "description", "content", "timestamp'2024-01-01' published_at", "timestamp'2024-01-02' updated_at", "1 word_count", "0.5D quality_score", "0.5D freshness_score", "status", "timestamp'2023-12-31' created_at")


def upsert_documents(s, d):
    new = tables.web(s, d).filter("id % 3 = 0").selectExpr("url", "title", "case when id % 2 = 0 then null else description end description", "content", "cast(null as timestamp) published_at", "timestamp'2025-01-01' updated_at", "2 word_count", "0.7D quality_score", "0.1D freshness_score", "'done' status")
    m = upsert.upsert_documents(_snapshot(s, d), new, F.lit(AS_OF))
    return m.select("id", "url", "canonical_url", "title", "description", F.md5("content").alias("content_md5"), "published_at", "updated_at", "word_count", "quality_score", "freshness_score", "status", "created_at")


def _article_rows(df, stamp):
    return df.selectExpr("url", "feed_url", "title", "description", "'' image", "content", "author", f"{stamp} published_at", "timestamp'2024-01-02' updated_at")


def upsert_articles(s, d):
    old = _article_rows(tables.articles(s, d).filter("url not like '%2'"), "timestamp'2024-01-01'").withColumn("content", F.when(F.col("url").like("%4"), F.lit("")).otherwise(F.col("content")))
    new = _article_rows(tables.articles(s, d).filter("url like '%2' or url like '%4' or url like '%6'"), "cast(null as timestamp)")
    new = new.withColumns({"title": F.when(F.col("url").like("%6"), F.lit("")).otherwise(F.concat(F.lit("new "), "title")), "content": F.when(F.col("url").like("%6"), F.lit(None)).otherwise(F.col("content")), "feed_url": F.lit("other")})
    m = upsert.upsert_articles(old, new, F.lit(AS_OF))
    return m.select("url", "feed_url", "title", "description", F.md5("content").alias("content_md5"), "author", "published_at", "updated_at")


def _feed_rows(s, d):
    return tables.feeds(s, d).selectExpr("feed_url", "home_url", "name", "cast(null as string) link", "'img' image", "cast(null as string) discovered_by_url", "cast(null as timestamp) last_published", "last_fetched", "next_fetch_at")


def upsert_feeds(s, d):
    """Feeds after a discovery and a refresh."""
    old = _feed_rows(s, d).filter("name <> 'src1'")
    seen = tables.feeds(s, d).selectExpr("feed_url", "concat('https://home.', name, '/') home_url", "'https://page' discovered_by_url")
    got = tables.feeds(s, d).filter("name like '%1%'").selectExpr("feed_url", "case when name like '%0' then '' else concat(name, ' news') end name", "'' image", "'https://l' link", "timestamp'2025-05-05' last_published")
    return upsert.refresh_feeds(upsert.discover_feeds(old, seen), got, F.lit(AS_OF))


def backfill_content(s, d):
    a = tables.articles(s, d).withColumn("content", F.when(F.col("url").like("%2"), F.lit("")).when(F.col("url").like("%6"), F.lit(None)).otherwise(F.col("content")))
    pages = tables.articles(s, d).select("url", F.col("content").alias("page_content"))
    b = upsert.backfill(a, pages, text.white_words(F.col("page_content")))
    return b.select("url", F.md5("content").alias("content_md5"))


def replace_news_tokens(s, d):
    """News tokens after a second batch: articles whose new text has no term keep theirs."""
    a = tables.articles(s, d)
    old = index.news_postings(a)
    new = index.news_postings(a.filter("url like '%4'").withColumn("content", F.when(F.col("url").like("%44"), F.lit("?")).otherwise(F.lit("alpha beta beta"))).withColumns({"title": F.lit(""), "description": F.lit("")}))
    return index.replace_by_key(old, new, "article_url").groupBy("article_url").agg(F.count("*").alias("terms"), F.sum("frequency").alias("tokens"))


def _xml(c):
    """A column's text as XML character data, without the characters that XML forbids."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    return F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _rfc2822(at):
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss +0000")


def fetched_feeds(s, d):
    """One feed of each ten documents, RSS and Atom in turn, with an item of each. Every thirteenth
    breaks off in an item more, at a bare ampersand; every seventeenth is no feed at all."""
    docs = tables.articles(s, d).join(tables.documents(s, d).select(F.expr(tables.ARTICLES[0]), "doc_id"), "url")
    when = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=(F.col("doc_id") % 400_000).cast("int"))
    rss = F.concat(F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><link>/item/"), "doc_id", F.lit("?utm_source=f#x</link><description>"), _xml(F.concat(F.lit("<p>No "), "doc_id", F.lit(" &amp; <b>on</b></p>"))), F.lit("</description><dc:creator>"), "author", F.lit("</dc:creator><pubDate>"), _rfc2822(when), F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), _xml(F.col("title")), F.lit('</title><link href="/item/'), "doc_id", F.lit('"/><summary>'), _xml(F.concat(F.lit("<p>No "), "doc_id", F.lit(" &amp; <b>on</b></p>"))), F.lit("</summary><author><name>"), "author", F.lit("</name></author><published>"), _rfc2822(when), F.lit("</published></entry>"))
    k = F.floor(F.col("doc_id") / 10)
    one = docs.select(k.alias("k"), "doc_id", F.when(k % 2 == 0, rss).otherwise(atom).alias("item"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "")
    feeds = one.groupBy("k").agg(body.alias("items"))
    link = F.concat(F.lit("https://h"), "k", F.lit(".example.org//home"))
    broken = F.when(F.col("k") % 13 == 5, F.concat(F.when(F.col("k") % 2 == 0, "<item>").otherwise("<entry>"), F.lit("<title>this & that</title>"))).otherwise("")
    whole = F.when(F.col("k") % 2 == 0, F.concat(F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed '), "k", F.lit("</title><link>"), link, F.lit("</link>"), "items", broken, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '), "k", F.lit('</title><link href="'), link, F.lit('"/>'), "items", broken, F.lit("</feed>")))
    return feeds.select(F.concat(F.lit("https://f"), "k", F.lit(".example.org/feed")).alias("feed_url"), F.when(F.col("k") % 17 == 3, F.lit("502 bad gateway")).otherwise(whole).alias("body"))


def rss_parse(s, d):
    """Every feed's items; a body that is no feed has a row without any."""
    got = fetched_feeds(s, d).mapInPandas(markup.feed_parser(), f"feed_url string, {markup.FEED}")
    rows = got.select("feed_url", "name", "link", "last_published", F.explode_outer("items").alias("i"))
    return rows.select("feed_url", "name", "link", "last_published", "i.url", F.md5("i.title").alias("title_md5"), "i.description", "i.author", "i.published_at")


def rfc2822_dates(s, d):
    """The engine's date parser over RFC 2822 forms of all event times, in three zones, and over ISO-8601 ones, which it refuses."""
    e = tables.table(s, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    local = lambda hours: F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), "EEE, dd MMM yyyy HH:mm:ss")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(local(0), F.lit(" GMT"))).when(kind == 1, F.concat(local(5), F.lit(" +0500"))).when(kind == 2, F.concat(local(-8), F.lit(" PST"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", markup.rfc2822_udf(raw).alias("at"))


def feed_times(s, d):
    """Times of feeds as search results show them."""
    return tables.feeds(s, d).select("feed_url", scores.iso(F.col("last_fetched")).alias("last_fetched"), scores.iso(F.col("next_fetch_at")).alias("next_fetch_at"))


def replace_web_tokens(s, d):
    """Web tokens after a third of the documents were crawled again, some to pages without any term: these have no tokens left."""
    docs = tables.web(s, d)
    again = docs.filter("id % 3 = 0").withColumns({"title": F.lit(""), "description": F.lit("?"), "content": F.when(F.col("id") % 2 == 0, F.lit("gamma delta gamma")).otherwise(F.lit(" the "))})
    kept = index.replace_for_keys(index.web_postings(docs), index.web_postings(again), again.select(F.col("id").alias("doc_id")), "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("frequency").alias("tokens"))


def replace_links(s, d):
    """Outgoing links after a third of the documents were crawled again: one link each, or none."""
    old = tables.outgoing(s, d)
    again = tables.web(s, d).filter("id % 3 = 0").select(F.col("id").alias("source_doc_id"))
    new = again.filter("source_doc_id % 2 = 0").withColumn("target_url", F.lit("https://new.example.org/"))
    return index.replace_for_keys(old, new, again, "source_doc_id")


def authority_upsert(s, d):
    """Authority of all documents after a cycle over the even ones: rows that it doesn't reach stay."""
    nodes = tables.web(s, d).select("id")
    old = nodes.select(F.col("id").alias("doc_id"), F.lit(0.5).alias("pagerank"), F.lit(7).alias("inlink_count"))
    part = nodes.filter("id % 2 = 0")
    edges = link_graph(s, d)
    new = part.select(F.col("id").alias("doc_id"), F.lit(0.25).alias("pagerank")).join(graph.inlinks(edges, part), "doc_id")
    return graph.merge_authority(old, new)


def format_text_results(s, d):
    r = web_search_page(s, d).alias("r").join(tables.web(s, d).select("url", "title", "description"), "url")
    w = Window.orderBy(F.desc("score"), "url")
    return files.result_text(r.withColumn("rank", F.row_number().over(w)))


def migration_token_backfill(s, d):
    """News tokens of the old layout in the joint token table."""
    old = index.news_postings(tables.articles(s, d))
    t = index.tokens(index.web_postings(tables.web(s, d)), old)
    return t.groupBy(F.col("source_type").cast("int").alias("source_type"), F.col("field").cast("int").alias("field")).agg(F.count("*").alias("n"), F.sum("frequency").alias("tokens"), F.count("doc_id").alias("with_doc"))


def migration_downgrade(s, d):
    """The joint token table back in the old layout of news, by article."""
    t = index.tokens(index.web_postings(tables.web(s, d)), index.news_postings(tables.articles(s, d)))
    return index.news_layout(t).groupBy("article_url").agg(F.count("*").alias("terms"), F.sum("frequency").alias("tokens"))


def image_base64(s, d):
    """Bytes of every page as an image's would be handed out; every ninth is missing."""
    body = F.when(F.col("page_id") % 9 != 0, F.encode("html", "utf-8"))
    return tables.table(s, d, "pages").select("page_id", F.md5(files.image_text(body)).alias("image_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_terms, term_freq_by_field, term_statistics, token_statistics, web_search_candidates, web_search_ranked, web_search_page,
        web_search_textless, web_search_stemmed, stem_vocabulary, news_search, news_idf_df_zero, spell_words,
        spell_external_scores, spell_dictionary, spell_meta_topn, spell_candidates_trigram, spell_candidates_prefix,
        spell_corrections, spell_suspects, spell_suggest, spell_generate_deletes, dictionary_sync_diff, link_graph,
        inlink_counts, pagerank, simhash_fingerprints, url_normalize, registrable_domain, page_parse_title_links,
        page_links, page_status_routing, quality_freshness, queue_enqueue, queue_dequeue, queue_status_counts,
        rate_limit_slots, feeds_due, shard_assignment, feed_shards, upsert_documents, upsert_articles, upsert_feeds,
        backfill_content, replace_news_tokens, rss_parse, rfc2822_dates, feed_times, replace_web_tokens, replace_links, authority_upsert, page_feed_links,
        page_content, format_text_results, migration_token_backfill, migration_downgrade, image_base64,
    )
}
