"""Spelling: lexicon, candidates, corrections, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, spelling, text

MIN_POPULARITY, MOST_CANDIDATES, KNOWN_POPULARITY = 2.0, 120, 3.0
SIMILAR = 0.3
LEXICON = ("word", "doc_frequency", "total_frequency", "external_frequency", "popularity_score")


def word_counts(*sources: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """(word, total_frequency) over the text columns of several tables; each is counted before they are joined."""
    parts = []
    for df, cols in sources:
        words = df.select(F.explode(text.spell_words(F.concat_ws(" ", *cols))).alias("word"))
        parts.append(words.groupBy("word").agg(F.count("*").alias("n")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("word").agg(F.sum("n").alias("total_frequency"))


def _valid(word, least: int = 2, most: int | None = None):
    return word.rlike(rf"^\p{{L}}{{{least},{most or ''}}}$")


def external_counted(lines: DataFrame, limit: int, weight: float) -> DataFrame:
    """(word, score) of `word count` lines (value, rank); the first `limit` that score count."""
    part = lambda i: F.try_element_at(F.split("value", r"\s+"), F.lit(i))
    count = F.regexp_replace(part(2), ",", "")
    rows = lines.select("rank", F.lower(part(1)).alias("word"), count.alias("c")).filter(_valid(F.col("word")) & F.col("c").rlike(r"^\d+$"))
    return _first(rows.select("rank", "word", F.floor(F.log1p(F.col("c").cast("double")) * 6.0 * weight).cast("int").alias("score")), limit)


def external_ranked(lines: DataFrame, limit: int, weight: float) -> DataFrame:
    """(word, score) of `word` lines (value, rank) by their rank."""
    rows = lines.select("rank", F.lower(F.try_element_at(F.split("value", r"\s+"), F.lit(1))).alias("word")).filter(_valid(F.col("word")))
    score = F.floor(F.log1p(F.greatest(F.lit(1.0), (limit - F.col("rank") + 1).cast("double"))) * 5.0 * weight).cast("int")
    return _first(rows.select("rank", "word", score.alias("score")), limit)


def _first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter("score > 0").orderBy("rank").limit(limit).select("word", "score")


def external_scores(*lists: DataFrame) -> DataFrame:
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("word").agg(F.sum("score").cast("long").alias("external_frequency"))


def dictionary(words: DataFrame, external: DataFrame) -> DataFrame:
    """The spelling dictionary; document frequencies are not counted and stay 0."""
    own = words.select(F.lower(F.trim("word")).alias("word"), "total_frequency").filter(_valid(F.col("word"))).groupBy("word").agg(F.sum("total_frequency").alias("total_frequency"))
    both = own.join(external, "word", "full_outer").filter(_valid(F.col("word"), 2, 32))
    both = both.select("word", F.lit(0).cast("long").alias("doc_frequency"), F.coalesce("total_frequency", F.lit(0)).cast("long").alias("total_frequency"), F.coalesce("external_frequency", F.lit(0)).cast("long").alias("external_frequency"))
    return both.withColumn("popularity_score", scores.popularity(F.col("doc_frequency"), F.col("total_frequency"), F.col("external_frequency")))


def sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change feed that makes old equal new: new's columns and action insert, update, delete or unchanged. An empty new, as of
    a rebuild that found no words, changes nothing."""
    names = LEXICON[1:]
    if new.isEmpty():
        return old.select(*LEXICON, F.lit("unchanged").alias("action"))
    o = old.select("word", F.struct(*names).alias("o"))
    n = new.select("word", F.struct(*names).alias("n"))
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("o").eqNullSafe(F.col("n")), "update").otherwise("unchanged")
    return o.join(n, "word", "full_outer").select("word", *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in names), action.alias("action"))


def apply_sync(changes: DataFrame) -> DataFrame:
    return changes.filter("action <> 'delete'").select(*LEXICON)


def trigram_candidates(inputs: DataFrame, lexicon: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(input_word, lexicon columns, similarity): the best of each input's similar words.

    Words meet by shared trigrams: an equi-join of trigram rows whose counts give the Jaccard similarity, so
    no input is compared with the whole lexicon. A word's columns travel with its trigrams, so the lexicon is read once.
    """
    lex = lexicon.filter(F.col("popularity_score") >= MIN_POPULARITY).withColumn("g", spelling.trigrams(F.col("word")))
    lex_rows = lex.select(*LEXICON, F.size("g").alias("n"), F.explode("g").alias("t"))
    asked = inputs.select("input_word").distinct().withColumn("g", spelling.trigrams(F.col("input_word")))
    ask_rows = asked.select("input_word", F.size("g").alias("m"), F.explode("g").alias("t"))
    near = F.length("word").between(F.greatest(F.lit(2), F.length("input_word") - 2), F.length("input_word") + 2)
    shared = ask_rows.join(lex_rows, "t").filter(near).groupBy("input_word", "m", "n", *LEXICON).agg(F.count("*").alias("k"))
    sim = F.col("k") / (F.col("m") + F.col("n") - F.col("k")).cast("double")
    rows = shared.withColumn("similarity", sim).filter(F.col("similarity") >= SIMILAR)
    w = Window.partitionBy("input_word").orderBy(F.desc(F.round("similarity", 6)), F.desc("popularity_score"), "word")
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("input_word", *LEXICON, "similarity")


def prefix_candidates(inputs: DataFrame, lexicon: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates of the same first letter and a like length, by popularity."""
    first = lambda c: F.substring(c, 1, 1)
    near = F.length("word").between(F.greatest(F.lit(2), F.length("input_word") - 2), F.length("input_word") + 2)
    lex = lexicon.filter(F.col("popularity_score") >= MIN_POPULARITY).withColumn("f", first("word"))
    rows = inputs.select("input_word").distinct().withColumn("f", first("input_word")).join(lex, "f").filter(near)
    w = Window.partitionBy("input_word").orderBy(F.desc("popularity_score"), "word")
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("input_word", *LEXICON)


def corrections(inputs: DataFrame, candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(input_word, best, distance) of the inputs that a candidate corrects.

    Distance at most 2 (1 for words up to 3 letters); the closest, then most popular and frequent candidate must beat a
    known word's popularity by a factor, or an absolute bound for an unknown word.
    """
    known = lexicon.select(F.col("word").alias("input_word"), F.col("popularity_score").alias("known"))
    near = candidates.filter((F.col("word") != F.col("input_word")) & (F.levenshtein("word", "input_word") <= 4)).withColumn("distance", spelling.osa_udf("input_word", "word"))
    near = near.filter((F.col("distance") <= 2) & ((F.length("input_word") > 3) | (F.col("distance") <= 1)))
    order = F.struct("distance", -F.col("popularity_score"), -F.col("doc_frequency"), -F.col("total_frequency"), "word")
    best = near.groupBy("input_word").agg(F.min_by(F.struct("word", "distance", "popularity_score"), order).alias("b"))
    rows = best.join(known, "input_word", "left").select("input_word", F.col("b.word").alias("best"), F.col("b.distance").alias("distance"), F.col("b.popularity_score").alias("p"), F.coalesce("known", F.lit(0.0)).alias("known"))
    one = F.col("distance") == 1
    need = F.when(F.col("known") > 0, F.col("known") * F.when(one, 1.8).otherwise(4.0)).otherwise(F.when(one, 0.5).otherwise(2.5))
    return rows.filter(F.col("p") >= need).select("input_word", "best", "distance")


def suspects(inputs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Input words that are unknown or rare."""
    known = lexicon.select(F.col("word").alias("input_word"), "popularity_score")
    return inputs.join(known, "input_word", "left").filter(F.coalesce("popularity_score", F.lit(0.0)) < KNOWN_POPULARITY).select(*inputs.columns)


def query_words(queries: DataFrame) -> DataFrame:
    """(qid, input_word) of queries (qid, q)."""
    found = F.transform(F.regexp_extract_all("q", F.lit(text.QUERY_WORD), F.lit(0)), F.lower)
    return queries.select("qid", F.explode(F.filter(found, lambda w: ~w.isin(*text.STOP_WORDS))).alias("input_word"))


def suggest(queries: DataFrame, fixed: DataFrame) -> DataFrame:
    """(qid, q, suggestion): q with its words corrected in their own case, null if nothing changes (fixed: input_word, best)."""
    mark = "\u0000"
    cut = F.split(F.regexp_replace("q", f"({text.QUERY_WORD})".replace("(?U)", "").join(("(?U)", "")), f"{mark}$1{mark}"), mark)
    parts = queries.select("qid", "q", F.posexplode(cut).alias("i", "part"))
    got = parts.join(fixed.select("input_word", "best"), F.lower("part") == F.col("input_word"), "left")
    new = F.when((F.col("i") % 2 == 1) & F.col("best").isNotNull(), spelling.like_case(F.col("part"), F.col("best"))).otherwise(F.col("part"))
    rows = got.groupBy("qid", "q").agg(F.sort_array(F.collect_list(F.struct("i", new.alias("t")))).alias("p"))
    line = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return rows.select("qid", "q", F.when(line != F.col("q"), line).alias("suggestion"))
