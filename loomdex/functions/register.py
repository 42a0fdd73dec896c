"""SQL names for the functions that Spark lacks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import markup, spelling, text, urls


def all_deletes(word: str, most: int = 2) -> set[str]:
    """Distinct strings with up to `most` characters removed; strings under two characters aren't shortened."""
    found: set[str] = set()
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer if len(w) >= 2 for i in range(len(w))}
        found |= layer
    return found


class Deletes:
    """Table function generate_deletes(word): a row per deletion."""

    def eval(self, word: str) -> Iterator[tuple[str]]:
        for cut in sorted(all_deletes(word)) if word is not None else ():
            yield (cut,)


def register(spark: SparkSession, as_of: datetime | None = None) -> None:
    """stem(term), osa_distance(a, b), normalize_url(url), parse_html(url, html), which gives a struct without dates after as_of
    (now, if not given), and the table function generate_deletes(word)."""
    spark.udf.register("parse_html", markup.page_parser(as_of or datetime.now(timezone.utc)))
    spark.udf.register("stem", text.stem_udf)
    spark.udf.register("osa_distance", spelling.osa_udf)
    spark.udf.register("normalize_url", urls.normalize_url_udf)
    spark.udtf.register("generate_deletes", udtf(Deletes, returnType="cut string"))
