"""Merkle fixity audit of WARC replicas.

Records are hashed one by one, each with its number, its offset in its archive file and its length;
ordered ranges of FANOUT consecutive records, then of FANOUT such ranges and so on, are hashed with
the offsets where they begin and end into a tree up to one root. Two replicas are compared from the
root down: only the children of nodes that differ are looked at, until the records are reached.
Where numbers below and above zero occur, the top has one root for either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, written

FANOUT = 16
#: Record numbers that share an archive file.
ARCHIVE = 1024
_NULL = -(1 << 40)  # the number of records without one


def warc_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """number, archive, offset (in the archive file, records in order of number) and record (WARC/1.0 text) of every page.

    Null url or html count as empty; pages without an id share one number. date is the time of capture, which pages lack.
    """
    body = F.coalesce("html", F.lit(""))
    lines = ["WARC/1.0", "WARC-Type: resource", F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit(""))), f"WARC-Date: {date}", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")), "Content-Type: text/html", F.concat(F.lit("Content-Length: "), F.octet_length(body))]
    head = F.concat_ws("\r\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    made = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL)).alias("number"), F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n")).alias("record"))
    sizes = made.groupBy("number").agg(F.sum(F.octet_length("record").cast("long")).alias("size"))
    order = Window.partitionBy("archive").orderBy("number")  # ARCHIVE rows at most
    at = sizes.withColumn("archive", _archive()).select("number", "archive", (F.sum("size").over(order) - F.col("size")).alias("offset"))
    return made.join(at, "number").select("number", "archive", "offset", "record")


def _archive() -> Column:
    return F.floor(F.col("number") / ARCHIVE).cast("long")


def leaves(records: DataFrame) -> DataFrame:
    """One leaf per record number: digest, length, archive and least offset.

    Records that share a number are one leaf: of their count, the least and greatest digest and an order-free sum, so
    a number with very many records needs no list of them. A null number is a number of its own, a null record empty,
    a null offset -1.
    """
    record = F.coalesce("record", F.lit(""))
    each = records.select(F.coalesce(F.col("number").cast("long"), F.lit(_NULL)).alias("number"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    one = each.groupBy("number").agg(F.count("*").alias("copies"), F.min("offset").alias("offset"), F.sum("length").alias("length"), F.min("digest").alias("least"), F.max("digest").alias("most"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.sum(F.xxhash64(F.lit(7), "digest").cast("decimal(38,0)")).alias("y"))
    digest = F.when(F.col("copies") == 1, F.col("least")).otherwise(F.sha2(F.concat_ws(":", "copies", "least", "most", "x", "y"), 256))
    return one.select("number", _archive().alias("archive"), "offset", "length", digest.alias("digest"))


def tree(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Levels 0 (records) to depth; node k of a level covers numbers [k * FANOUT^level, (k + 1) * FANOUT^level), and its hash the
    offsets where its first record begins and its last one ends."""
    at = F.sha2(F.concat_ws(":", "number", "offset", "length", "digest"), 256)
    level = leaf.select(F.col("number").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), at.alias("hash"))
    out = [level]
    for _ in range(depth):
        child = F.sort_array(F.collect_list(F.struct("node", "begin", "end", "hash")))  # FANOUT at most
        up = level.groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(child.alias("c"))
        text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["node"], c["begin"], c["end"], c["hash"])), "|")
        level = written(up.select(F.col("up").alias("node"), F.col("c")[0]["begin"].alias("begin"), F.element_at("c", -1)["end"].alias("end"), F.sha2(text, 256).alias("hash")))
        out.append(level)
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records (number, offset, record) of two replicas that differ.

    Rows: number, archive, offset and length (of the left replica; null where it lacks the record), offset_right,
    digest_left, digest_right and status (corrupt, moved: the same bytes elsewhere, missing: on the right, extra: on the
    right). Equal or empty replicas give no rows. Null numbers, null records and records that share a number: see leaves().
    Other columns of the replicas, whatever their names, are ignored; records of any length are hashed whole.
    """
    a, b = written(leaves(left)), written(leaves(right))
    ends = a.select("number").union(b.select("number")).agg(F.min("number").alias("lo"), F.max("number").alias("hi")).first()
    depth = 0
    if ends["lo"] is not None:
        while (ends["lo"] // FANOUT**depth, ends["hi"] // FANOUT**depth) not in ((-1, 0), (k := ends["hi"] // FANOUT**depth, k)):
            depth += 1
    ta, tb = tree(a, depth), tree(b, depth)
    bad = None
    for level in range(depth, 0, -1):
        x, y = (t[level].select("node", F.col("hash").alias(h)) for t, h in ((ta, "ha"), (tb, "hb")))
        if bad is not None:
            up = bad.select("up")
            x, y = (t.withColumn("up", F.floor(F.col("node") / FANOUT)).join(up, "up", "left_semi").drop("up") for t in (x, y))
        worse = written(x.join(y, "node", "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select(F.col("node").alias("up")))
        drop(ta[level], tb[level], *([bad] if bad is not None else []))
        bad = worse
    a, b = (t.select("number", "archive", "offset", "length", "digest") for t in (a, b))
    if bad is not None:
        a, b = (t.withColumn("up", F.floor(F.col("number") / FANOUT)).join(bad, "up", "left_semi").drop("up") for t in (a, b))
    both = a.withColumnRenamed("digest", "digest_left").join(b.select("number", F.col("offset").alias("offset_right"), F.col("length").alias("length_right"), F.col("digest").alias("digest_right")), "number", "full_outer")
    same = F.col("digest_left").eqNullSafe(F.col("digest_right")) & F.col("length").eqNullSafe(F.col("length_right"))
    status = F.when(F.col("digest_right").isNull(), "missing").when(F.col("digest_left").isNull(), "extra").when(same, "moved").otherwise("corrupt")
    return both.filter(~(same & F.col("offset").eqNullSafe(F.col("offset_right")))).select("number", "archive", "offset", "offset_right", "length", "digest_left", "digest_right", status.alias("status"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica of records with faults: a byte changed, records lost, moved within their archive, and added."""
    cols = ("number", "offset", "record")
    kept = records.select(*cols).filter("number < 0 or number % 193 <> 7")
    changed = kept.withColumn("record", F.when((F.col("number") >= 0) & (F.col("number") % 97 == 13), F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("~"))).otherwise(F.col("record")))
    moved = changed.withColumn("offset", F.when((F.col("number") >= 0) & (F.col("number") % 151 == 11), F.col("offset") + 16).otherwise(F.col("offset")))
    added = records.select(*cols).filter("number >= 0 and number % 211 = 5").withColumn("number", -F.col("number") - 1)
    return moved.unionByName(added)


def oracle(table: str = "pages") -> str:
    """audit() of the records of pages and damaged() of them as DuckDB SQL, found by comparing all records."""
    record = """concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: resource', 'WARC-Target-URI: ' || coalesce(url, ''), 'WARC-Date: 2024-01-01T00:00:00Z', 'WARC-Record-ID: <urn:page:' || page_id || '>', 'Content-Type: text/html', 'Content-Length: ' || strlen(coalesce(html, '')), '', coalesce(html, ''), '', '')"""
    return f"""
    with r as (select number, (floor(number / {ARCHIVE}))::bigint archive, record, strlen(record)::bigint length from (select page_id number, {record} record from {table}))
    , a as (select *, sha256(record) digest, (sum(length) over (partition by archive order by number) - length)::bigint "offset" from r)
    , b as (select number, case when number % 151 = 11 then "offset" + 16 else "offset" end "offset", sha256(case when number % 97 = 13 then left(record, length(record) - 1) || '~' else record end) digest from a where number % 193 <> 7
        union all select -number - 1, "offset", digest from a where number % 211 = 5)
    select coalesce(a.number, b.number) number, archive, a."offset", b."offset" offset_right, a.length, a.digest digest_left, b.digest digest_right,
      case when b.digest is null then 'missing' when a.digest is null then 'extra' when a.digest = b.digest then 'moved' else 'corrupt' end status
    from a full outer join b on a.number = b.number where a.digest is distinct from b.digest or a."offset" <> b."offset"
    """
