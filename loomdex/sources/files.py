"""File sources and sinks of the engine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEXICON = "word string, doc_frequency long, total_frequency long, external_frequency long, popularity_score double"
TOP_WORDS = 120_000


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank lines with their rank (from 1) in the order of file names and lines; a missing file has none.

    Lines are counted within the blocks that Spark reads a file in, and each block starts behind the sum of those before it; only
    one row a block is ordered in one task.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "value string, rank long")
    block = ["_file", "_start"]
    lines = raw.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")).filter("value <> ''")
    sizes = lines.groupBy(*block).agg(F.count("*").alias("_n"))
    before = sizes.select(*block, (F.sum("_n").over(Window.orderBy(*block)) - F.col("_n")).alias("_before"))
    inside = lines.withColumn("_k", F.row_number().over(Window.partitionBy(*block).orderBy("_at")))
    return inside.join(before, block).select("value", (F.col("_before") + F.col("_k")).alias("rank"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Words of an exported lexicon; an empty table if there is no such file."""
    try:
        return spark.read.schema(LEXICON).json(path)
    except AnalysisException:
        return spark.createDataFrame([], LEXICON)


class LexiconCache:
    """An exported lexicon that is kept in memory and read again only when its files were written anew; without any it is empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._seen: tuple[tuple[str, int], ...] | None = None
        self._words: DataFrame | None = None

    def _files(self) -> tuple[tuple[str, int], ...]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(at) if files.exists(at) else ()
        return tuple(sorted((x.getPath().toString(), x.getModificationTime()) for x in found))

    def words(self) -> DataFrame:
        now = self._files()
        if self._words is None or now != self._seen:
            if self._words is not None:
                self._words.unpersist()
            self._seen, self._words = now, read_lexicon(self.spark, self.path).cache()
        return self._words


def top_words(dictionary: DataFrame, most: int = TOP_WORDS) -> DataFrame:
    return dictionary.orderBy(F.desc("popularity_score"), "word").limit(most)


def write_lexicon(dictionary: DataFrame, path: str, most: int = TOP_WORDS) -> None:
    top_words(dictionary, most).write.mode("overwrite").json(path)


def lexicon_document(dictionary: DataFrame, as_of: Column, most: int = TOP_WORDS) -> DataFrame:
    """One row `value`: the exported lexicon as a JSON document of generated_at and words, best first. It holds at most `most` words."""
    names = [x.split()[0] for x in LEXICON.split(", ")]
    top = top_words(dictionary.select(*names), most).agg(F.collect_list(F.struct(-F.col("popularity_score"), "word", F.struct(*names).alias("row"))).alias("all"))
    words = F.transform(F.sort_array("all"), lambda x: x["row"])
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return top.select(F.to_json(F.struct(stamp.alias("generated_at"), words.alias("words"))).alias("value"))


def image_text(content: Column) -> Column:
    """Base64 of an image's bytes in one line, whatever the session breaks lines at; missing or empty ones give an empty string."""
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, F.lit("")).otherwise(F.translate(F.base64(content), "\r\n", ""))


def result_text(results: DataFrame, order: str = "rank") -> DataFrame:
    """One row: results (a page of at most 100) as `[url](title)`, description and an empty line each."""
    line = F.concat(F.lit("["), "url", F.lit("]("), F.coalesce("title", F.lit("")), F.lit(")\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return results.agg(F.regexp_replace(F.array_join(F.transform(rows, lambda x: x["t"]), ""), r"^\s+|\s+$", "").alias("text"))
