"""URL normalisation and registrable domains."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that are dropped.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")
# Suffixes of two labels.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp")


def normalize_url(raw: str, base: str | None = None) -> str:
    """Canonical form of a URL, resolved against base if given: lower-case scheme (https if none) and authority, single
    slashes, no fragment, no tracking or blank parameters. A bare path counts as the authority. Bad URLs raise ValueError."""
    whole = raw if base is None else urljoin(base, raw)
    parts = urlsplit(whole.strip())
    wanted = urlencode([(k, v) for k, v in parse_qsl(parts.query) if k.lower() not in TRACKING])
    if parts.netloc or not parts.path:
        place = (parts.netloc.lower(), re.sub("/+", "/", parts.path) or "/")
    else:
        place = (parts.path.lower(), "")
    return urlunsplit((parts.scheme.lower() or "https", *place, wanted, ""))


def _or_none(raw: str | None, base: str | None = None) -> str | None:
    try:
        return None if raw is None else normalize_url(raw, base)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normalize_url_udf(raw: pd.Series) -> pd.Series:
    """normalize_url() of each; null for null and for bad URLs."""
    return raw.map(_or_none, na_action="ignore")


def host(url: Column) -> Column:
    """Lower-case host without user, port and outer dots."""
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[^:\]]*$", "")
    return F.regexp_replace(F.lower(bare), r"^\.+|\.+$", "")


def registrable_domain(url: Column) -> Column:
    """Last two labels of the host, three below a suffix of two labels; an empty string without a host."""
    h = host(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(h == "", F.lit("")).when(F.size(labels) <= 2, h).when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))
