"""Scores: IDF, popularity, quality, freshness, search intent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TERM, normal_text

FIELD_TITLE, FIELD_DESCRIPTION, FIELD_BODY = 1, 2, 4
# Field weights and the points of the intent score.
FIELD_WEIGHTS = {FIELD_TITLE: 3.2, FIELD_DESCRIPTION: 1.7}
POINTS = {
    "text": 12.0, "coverage": 25.0, "all_terms": 40.0, "phrase_title": 140.0, "phrase_url": 70.0, "phrase_description": 25.0,
    "compact_url": 90.0, "title_hit": 22.0, "url_hit": 16.0, "compact_hit": 12.0, "all_title": 80.0, "all_url": 55.0,
    "all_compact": 45.0, "news": 8.0,
}


def field_weight(field: Column) -> Column:
    out = F
    for code, weight in FIELD_WEIGHTS.items():
        out = out.when(field == code, F.lit(weight))
    return out.otherwise(F.lit(1.0))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def popularity(df: Column, tf: Column, external: Column) -> Column:
    part = lambda c: F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))
    return 4.0 * part(df) + 2.0 * part(tf) + 3.0 * part(external)


def quality(words: Column, links: Column) -> Column:
    full = F.least(F.lit(1.0), words / F.lit(300.0)) - F.least(F.lit(0.4), links / F.nullif(words, F.lit(0)))
    return F.when(words == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), full))


def freshness(updated: Column, published: Column, as_of: Column) -> Column:
    ts = F.coalesce(updated, published)
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86400)
    return F.when(ts.isNull(), F.lit(0.1)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(365), days) / F.lit(365.0)))


def intent(score: Column, matched: Column, total: int, query: str, words: Sequence[str], title: Column, description: Column, url: Column, news: bool = False) -> Column:
    """Points of a candidate: words are the query's words as written, total the number of its terms."""
    p, n = POINTS, len(words)
    phrase = " ".join(_ascii_runs(query))
    compact = "".join(words)
    t, d, u = (normal_text(F.coalesce(c, F.lit(""))) for c in (title, description, url))
    flat = F.regexp_replace(F.lower(url), "[^a-z0-9]", "")
    bonus = lambda cond, pts: F.when(cond, F.lit(pts)).otherwise(F.lit(0.0))
    hits = lambda c: F.size(F.array_intersect(F.array(*map(F.lit, words)), F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0)))) if words else F.lit(0)
    out = p["text"] * F.log1p(F.greatest(score, F.lit(0.0)))
    if total:
        out = out + p["coverage"] * matched / F.lit(float(total)) + bonus(matched == total, p["all_terms"])
    if phrase:
        out = out + bonus(t.contains(phrase), p["phrase_title"]) + bonus(u.contains(phrase), p["phrase_url"]) + bonus(d.contains(phrase), p["phrase_description"])
    if compact:
        out = out + bonus(flat.contains(compact), p["compact_url"])
    if n:
        th, uh = hits(title), hits(url)
        ch = sum((F.when(flat.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        out = out + p["title_hit"] * th + p["url_hit"] * uh + p["compact_hit"] * ch
        out = out + bonus(th == n, p["all_title"]) + bonus(uh == n, p["all_url"]) + bonus(ch == n, p["all_compact"])
    return out + F.lit(p["news"] if news else 0.0)


def textless(score: Column, matched: Column, total: int) -> Column:
    """Points without any text: the mode for rows whose text can't be read."""
    p = POINTS
    return p["text"] * F.log1p(F.greatest(score, F.lit(0.0))) + p["coverage"] * matched / F.lit(float(total)) + F.when(matched == total, F.lit(p["all_terms"])).otherwise(F.lit(0.0))


def iso(stamp: Column) -> Column:
    """ISO-8601 text of a UTC timestamp; a fraction of a second only where there is one."""
    whole, part = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(stamp, ".SSSSSS")
    return F.when(part == ".000000", F.concat(whole, F.lit("+00:00"))).otherwise(F.concat(whole, part, F.lit("+00:00")))


def _ascii_runs(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", text.lower())
