import re
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import markup, scores, spelling, text, urls
from loomdex.operators import search
from loomdex.plans import batch


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else tuple(r)


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"),
    ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"),
    ("predication", "predic"), ("feudalism", "feudal"), ("hopefulness", "hope"), ("formality", "formal"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("news", "news"), ("on", "on"),
])
def test_stem(word, stem):
    assert text.stem(word) == stem


def test_tokens(spark):
    line = F.lit("für über foo_bar ab1 x schön café ok")
    assert one(spark, text.terms(line)) == ["ab1", "ok"]
    assert one(spark, text.spell_words(F.lit("für überx"))) == ["berx"]
    assert one(spark, text.terms(F.lit(None).cast("string"))) == []
    assert one(spark, text.white_words(F.lit("a b\x1cc  d"))) == 4


@pytest.mark.parametrize("raw,want", [
    ("HTTP://Ex.com//a//b?utm_source=x&q=1#f", "http://ex.com/a/b?q=1"), ("https://example.com", "https://example.com/"),
    ("example.com/A", "https://example.com/a"), ("mailto:X@y.z", "mailto://x@y.z"), ("http://e.com/?a=&B=x y&GCLID=1", "http://e.com/?B=x+y"),
])
def test_normalize_url(raw, want):
    assert urls.normalize_url(raw) == want


def test_bad_url_is_null(spark):
    df = spark.createDataFrame([("http://[x",), (None,)], "u string").select(urls.normalize_url_udf("u").alias("n"))
    assert [r.n for r in df.collect()] == [None, None]


@pytest.mark.parametrize("raw,want", [("https://a.b.example.co.uk/", "example.co.uk"), ("http://10.0.0.1/", "0.1"), ("http://u@W.Ex.com:80/x", "ex.com"), ("nohost", ""), ("http://localhost", "localhost")])
def test_registrable_domain(spark, raw, want):
    assert one(spark, urls.registrable_domain(F.lit(raw))) == want


def test_osa():
    assert spelling.osa("ca", "abc") is None
    assert spelling.osa("teh", "the") == 1
    assert spelling.osa("abcd", "badc") == 2


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_is_symmetric_and_bounded(a, b):
    d = spelling.osa(a, b)
    assert d == spelling.osa(b, a)
    assert (d == 0) == (a == b)
    if d is None:
        assert a != b
    else:
        assert d >= abs(len(a) - len(b))


def test_like_case(spark):
    case = lambda t: one(spark, spelling.like_case(F.lit(t), F.lit("the")))
    assert [case(t) for t in ("TEH", "Teh", "teh", "tEh")] == ["THE", "The", "the", "the"]


def test_deletes(spark):
    assert set(one(spark, spelling.deletes(F.lit("abc")))) == {"ab", "ac", "bc", "a", "b", "c"}


def test_quality_and_freshness(spark):
    at = F.to_timestamp(F.lit("2025-06-01"))
    null = F.lit(None).cast("timestamp")
    assert one(spark, scores.quality(F.lit(600), F.lit(60))) == pytest.approx(0.9)
    assert one(spark, scores.quality(F.lit(0), F.lit(3))) == 0
    assert one(spark, scores.freshness(null, null, at)) == 0.1
    assert one(spark, scores.freshness(F.to_timestamp(F.lit("2024-04-27")), null, at)) == 0


def test_limits():
    assert search.candidate_limit(20, 0) == 220
    assert search.candidate_limit(100, 0) == 1000
    assert search.candidate_limit(100, 5000) == 2000
    assert search.result_count(5, 0, 50) == 50
    assert search.clamp(1000, -3) == (100, 0)
    with pytest.raises(ValueError):
        search.validate("", 20, 0)


def test_dates():
    assert markup.rfc2822("Mon, 01 Jan 2024 05:30:00 +0530") == datetime(2024, 1, 1)
    assert markup.rfc2822("2024-01-01T00:00:00Z") is None


def test_page():
    html = """<html><head><title> T </title><meta name="description" content="D"><link rel="alternate" type="application/rss+xml" href="/feed.xml">
      <meta property="article:published_time" content="2024-01-01T00:00:00Z"><meta property="article:modified_time" content="2999-01-01"></head>
      <body><nav>skip</nav><article>Main <b>text</b><script>no()</script></article><a href="/x#y">1</a><a href="/x">2</a><a href="mailto:a@b.c">3</a></body></html>"""
    p = markup.parse_page("https://e.org/p", html, datetime.fromisoformat("2025-01-01T00:00:00+00:00"))
    assert (p["title"], p["description"], p["content"]) == ("T", "D", "Main text")
    assert p["links"] == ["https://e.org/x", "mailto://a@b.c"]
    assert p["feed_links"] == ["https://e.org/feed.xml"]
    assert p["published_at"] == datetime(2024, 1, 1) and p["updated_at"] is None


def test_feed_limits():
    items = "".join(f"<item><link>https://e.org/{i}</link></item>" for i in range(60))
    got = markup.parse_feed("https://e.org/f", f"<rss><channel><item><link>https://e.org/{'x' * 2000}</link></item>{items}</channel></rss>")
    assert len(got["items"]) == 50 and got["items"][0]["url"] == "https://e.org/0"
    assert not markup.parse_feed("https://e.org/f", "no feed")["ok"] and not markup.parse_feed("https://e.org/f", "")["ok"]
    cut = markup.parse_feed("https://e.org/f", "<rss><channel><title>T</title><item><link>/1</link></item><item><link>/2</link><title>a & b</title></item><item><link>/3</link></item></channel></rss>")
    assert cut["ok"] and cut["name"] == "T" and [x["url"] for x in cut["items"]] == ["https://e.org/1", "https://e.org/2"]


def test_stems_begin_as_their_terms():
    import random

    r = random.Random(1)
    roots = ["relat", "happi", "conflat", "siz", "hop", "capabil", "sensib", "feudal", "triplic", "valen", "analog", "radic", "tan", "die", "ag", "skies", "y", "by"]
    ends = ["", "s", "es", "ed", "ing", "y", "ies", "ational", "ization", "izer", "abli", "alli", "ently", "ousness", "iveness", "biliti", "ility", "logi", "icate", "ative", "ical", "ness", "ement", "ion", "e", "ll", "eed", "bly", "ibly", "anci", "ency"]
    words = [a + b + c for a in roots for b in ends for c in ends] + ["".join(r.choice("aeioubdlnstyz") for _ in range(r.randrange(2, 9))) for _ in range(20_000)] + list(text.IRREGULAR)
    assert all(w.startswith(text.stem_prefix(text.stem(w))) for w in words)


def test_roles():
    assert batch.runs_global("auto", 1, 5) and batch.runs_global("auto", 3, 0) and not batch.runs_global("auto", 3, 1)
    assert batch.runs_global("Coordinator ", 3, 2) and not batch.runs_global("worker", 1, 0)
    assert batch.pause(60, 59.9) == 1 and batch.pause(60, 10, failed=True) == 15


def test_stop_words():
    assert len(set(text.STOP_WORDS)) == 33
    assert re.fullmatch(text.SPELL_WORD, "ab")


def test_free_form_dates():
    from loomdex.functions.markup import _stamp

    as_of = datetime(2025, 6, 1, 12, tzinfo=timezone.utc)
    assert _stamp("March 5, 2024 10:30 PM", as_of) == datetime(2024, 3, 5, 22, 30)
    assert _stamp("5 Mar 2024 10:00 +0200", as_of) == datetime(2024, 3, 5, 8)
    assert _stamp("2024/03/05", as_of) == datetime(2024, 3, 5)
    assert _stamp("May 2025", as_of) == datetime(2025, 5, 1)
    assert [_stamp(x, as_of) for x in (None, "", "soon", "March 5, 2031", "99999999999999999999")] == [None] * 5


def test_registered_parser(spark):
    from loomdex.functions.register import register

    register(spark)
    row = spark.sql("select parse_html('https://a.example.org/', '<title> T </title><a href=\"/x\">x</a><p>body</p>') p").first().p
    assert (row.title, row.links, row.content) == ("T", ["https://a.example.org/x"], "x body")
