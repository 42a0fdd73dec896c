"""Word-level SimHash fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): bit i is set iff more than half of the words' hashes (low 64 bits of their MD5) have it; no words: 0.

    Two counters share each long, so 32 sums carry the 64 bits.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))
    rows = docs.select(F.col(id_col), F.explode_outer(words).alias("w"))
    h = F.conv(F.substring(F.md5("w"), 17, 16), 16, -10).cast("long")
    rows = rows.select(id_col, h.alias("h"))
    bit = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))
    sums = rows.groupBy(id_col).agg(F.count("h").alias("n"), *(F.sum(bit(i) + F.shiftleft(bit(i + 32), 32)).alias(f"s{i}") for i in range(32)))
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{i}", 32)
        for at, c in ((i, low), (i + 32, high)):
            out = out.bitwiseOR(F.when(2 * c > F.col("n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return sums.select(id_col, out.alias("fingerprint"))
