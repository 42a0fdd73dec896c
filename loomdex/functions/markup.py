"""HTML pages and RSS or Atom feeds, parsed with the standard library in Arrow batches."""

from __future__ import annotations

import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from contextlib import suppress
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html import unescape
from html.parser import HTMLParser

import pandas as pd

try:  # comes with pandas
    from dateutil import parser as free_dates
except ImportError:
    free_dates = None

from .urls import normalize_url

MAX_ITEMS, MAX_URL = 50, 2000
_FEED_MARKS = ("rss", "atom", "feed", ".xml")
_SKIP = ("script", "style", "noscript", "template")
_ASIDE = ("nav", "header", "footer", "aside", "form")

PAGE = "title string, description string, content string, links array<string>, feed_links array<string>, published_at timestamp, updated_at timestamp"


def _url(raw: str, base: str) -> str | None:
    try:
        return normalize_url(raw, base)
    except ValueError:
        return None


def _free_form(raw: str, as_of: datetime) -> datetime:
    """A date as people write it; what it leaves out is that of as_of's day, at midnight."""
    if free_dates is None:
        raise ValueError(raw)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # names of zones that it doesn't know
        return free_dates.parse(raw, default=as_of.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None))


def _stamp(raw: str | None, as_of: datetime) -> datetime | None:
    """ISO-8601 or free-form date (RFC 2822, where no free-form parser is installed), UTC if it names no zone; none if bad or after as_of."""
    raw = (raw or "").strip()
    for read in (datetime.fromisoformat, lambda r: _free_form(r, as_of), parsedate_to_datetime) if raw else ():
        try:
            got = read(raw)
        except (ValueError, TypeError, OverflowError):
            continue
        got = got.replace(tzinfo=timezone.utc) if got.tzinfo is None else got.astimezone(timezone.utc)
        return got.replace(tzinfo=None) if got <= as_of else None
    return None


class _Page(HTMLParser):
    """Collects title, metas, links and text. Main text is that of <article> or <main> if any, else all outside navigation."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.metas: list[dict[str, str]] = []
        self.link_tags: list[dict[str, str]] = []
        self.hrefs: list[str] = []
        self.main: list[str] = []
        self.rest: list[str] = []
        self.skip = self.aside = self.inside = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.metas.append(a)
        elif tag == "link":
            self.link_tags.append(a)
        elif tag == "a" and "href" in a:
            self.hrefs.append(a["href"])
        elif tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        self.skip += tag in _SKIP
        self.aside += tag in _ASIDE
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        self.skip = max(0, self.skip - (tag in _SKIP))
        self.aside = max(0, self.aside - (tag in _ASIDE))
        self.inside = max(0, self.inside - (tag in ("article", "main")))

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and data.strip():
            if self.inside:
                self.main.append(data.strip())
            elif not self.aside:
                self.rest.append(data.strip())


def _feed_links(page: _Page, base: str) -> list[str]:
    found = []
    for a in page.link_tags:
        rel, kind, href = a.get("rel", "").lower(), a.get("type", "").lower(), a.get("href", "").strip()
        typed = any(x in kind for x in ("rss", "atom"))
        if href and (("alternate" in rel or not rel) if typed else any(x in rel for x in ("alternate", "feed", "rss", "atom"))):
            found.append(href)
    for a in page.metas:
        if any(x in (a.get("name") or a.get("property") or "").lower() for x in ("rss", "atom", "feed")):
            found += [a[k] for k in ("content", "value", "href") if a.get(k)]
    urls = [_url(x.strip(), base) for x in found if any(m in x.lower() for m in _FEED_MARKS)]
    return list(dict.fromkeys(u for u in urls if u is not None))


def parse_page(url: str, html: str, as_of: datetime) -> dict:
    page = _Page()
    page.feed(html)
    page.close()
    meta = lambda key, name: next((m.get("content") or "" for m in page.metas if m.get(key) == name), "")
    links = [_url(h, url) for h in page.hrefs]
    return {
        "title": (page.title or "").strip(),
        "description": meta("name", "description").strip(),
        "content": " ".join(page.main or page.rest),
        "links": list(dict.fromkeys(x for x in links if x is not None)),
        "feed_links": _feed_links(page, url),
        "published_at": _stamp(meta("property", "article:published_time"), as_of),
        "updated_at": _stamp(meta("property", "article:modified_time"), as_of),
    }


def page_parser(as_of: datetime):
    """A pandas UDF (url, html) -> PAGE; dates after as_of are null, null html counts as empty."""
    from pyspark.sql import functions as F

    as_of = as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of

    @F.pandas_udf(PAGE)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for url, html in batches:
            got = pd.DataFrame([parse_page(u or "", h or "", as_of) for u, h in zip(url, html, strict=True)], columns=[x.split()[0] for x in PAGE.split(", ")])
            for c in ("published_at", "updated_at"):
                got[c] = pd.to_datetime(got[c])
            yield got

    return parse


# ---- feeds -------------------------------------------------------------------

ITEM = "url string, title string, description string, content string, author string, image_url string, published_at timestamp"
FEED = f"name string, link string, image_url string, last_published timestamp, items array<struct<{', '.join(x.replace(' ', ': ') for x in ITEM.split(', '))}>>, ok boolean"
# Prefixes and the namespaces that they stand for; the first tag with text counts.
_AUTHOR = ("author", "dc:creator", "creator", "itunes:author", "dcterms:creator")
_PREFIX = re.compile(r"xmlns:(\w+)\s*=\s*[\"']([^\"']*)[\"']")


def rfc2822(raw: str | None) -> datetime | None:
    """UTC time (naive) of an RFC 2822 date; anything else, ISO-8601 too, is none."""
    try:
        got = parsedate_to_datetime(raw or "")
    except (ValueError, TypeError):
        return None
    return (got if got.tzinfo else got.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)


def _rfc2822_all(raw: pd.Series) -> pd.Series:
    return pd.to_datetime(raw.map(rfc2822, na_action="ignore"))


def rfc2822_udf(raw):
    """rfc2822() of a column."""
    from pyspark.sql import functions as F

    return F.pandas_udf(_rfc2822_all, "timestamp")(raw)


class _Strip(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())


def strip_tags(raw: str) -> str:
    """Entities decoded, then tags removed; pieces of text are joined by blanks."""
    p = _Strip()
    p.feed(unescape(raw))
    p.close()
    return " ".join(p.parts)


class _Node:
    """An element with names as written: prefix:name, or name in the default namespace."""

    def __init__(self, element: ET.Element, prefixes: dict[str, str]):
        self.element, self.prefixes = element, prefixes

    def name(self, e: ET.Element) -> str:
        space, _, local = e.tag[1:].rpartition("}") if e.tag.startswith("{") else ("", "", e.tag)
        prefix = self.prefixes.get(space, "")
        return f"{prefix}:{local}" if prefix else local

    def find(self, name: str) -> ET.Element | None:
        return next((e for e in self.element.iter() if e is not self.element and isinstance(e.tag, str) and self.name(e) == name), None)

    def text(self, *names: str) -> str:
        for n in names:
            if (e := self.find(n)) is not None and (got := " ".join(x.strip() for x in e.itertext() if x.strip())):
                return got
        return ""

    def attribute(self, name: str, key: str) -> str:
        return (e.get(key) or "").strip() if (e := self.find(name)) is not None else ""

    def link(self) -> str:
        e = self.find("link")
        return "" if e is None else (e.get("href") or "".join(e.itertext())).strip()

    def image(self, base: str) -> str:
        enclosure = self.attribute("enclosure", "url") if "image" in self.attribute("enclosure", "type").lower() else ""
        raw = self.attribute("media:content", "url") or self.attribute("media:thumbnail", "url") or enclosure or self.text("image", "thumbnail")
        return (_url(raw, base) or "") if raw else ""

    def date(self, *names: str) -> datetime | None:
        return next((d for n in names if (d := rfc2822(self.text(n))) is not None), None)


def _read(xml: str) -> ET.Element | None:
    """The root of a document, with what was read before a fault; none if that is nothing."""
    root, parser = None, ET.XMLPullParser(["start"])
    with suppress(ET.ParseError):
        parser.feed(xml)
        for _, e in parser.read_events():
            root = e if root is None else root
    return root


def parse_feed(feed_url: str, xml: str) -> dict:
    """Metadata and accepted items (at most MAX_ITEMS, in document order) of a feed. Of malformed XML counts what stands before the
    fault; ok is false where that is no element at all."""
    none = {"name": "", "link": "", "image_url": "", "last_published": None, "items": [], "ok": False}
    root = _read(xml.strip())
    if root is None:
        return none
    prefixes = {uri: p for p, uri in _PREFIX.findall(xml)}
    top = _Node(root, prefixes)
    every = [e for e in root.iter() if isinstance(e.tag, str)]
    source = next((_Node(e, prefixes) for n in ("channel", "feed") for e in every if top.name(e) == n), top)
    items: list[dict] = []
    for e in every:
        if top.name(e) not in ("item", "entry") or len(items) >= MAX_ITEMS:
            continue
        node = _Node(e, prefixes)
        url = _url(link, feed_url) if (link := node.link()) else None
        if url is None or len(url) > MAX_URL:
            continue
        items.append({
            "url": url, "title": node.text("title"), "description": strip_tags(node.text("description", "summary")),
            "content": node.text("content", "content:encoded"), "author": node.text(*_AUTHOR), "image_url": node.image(feed_url),
            "published_at": node.date("pubDate", "published", "updated"),
        })
    dates = [d for d in (source.date("lastBuildDate", "pubDate", "updated"), *(i["published_at"] for i in items)) if d is not None]
    link = source.link()
    return {"name": source.text("title"), "link": (_url(link, feed_url) or "") if link else "", "image_url": source.image(feed_url), "last_published": max(dates, default=None), "items": items, "ok": True}


def feed_parser():
    """A mapInPandas function over (feed_url, body): feed_url and the columns of FEED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"feed_url": u} | parse_feed(u or "", x or "") for u, x in zip(b.feed_url, b.body, strict=True)], columns=["feed_url", "name", "link", "image_url", "last_published", "items", "ok"])

    return run
