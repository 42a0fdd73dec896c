"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are parted by the number n of their shingles into classes of doubling size. At a
containment of t an item of a class with upper size u lacks at most (1 - t) u shingles, so its
floor((1 - t) u) + 1 smallest hashes (a bottom-k MinHash sketch, k fixed per class) include one that
the document has: candidates miss nothing. Documents stream past the sketches; every candidate pair
is verified by the exact share of the item's shingle strings that the document holds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of item texts that are held by a task at a time; more items are searched block by block.
BLOCK_BYTES = 16 << 20
_BITS = 20


def shingles(text: str | None) -> set[bytes]:
    """Distinct five-word shingles of the A-Z-lowered text; fewer words: the whole sequence; none: empty."""
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def _hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and doc of every shingle of each text."""
    low = tn.LOWER[buf]
    w = tn.words(low, at)
    h = tn.hashes(low, w.start, w.end)
    g, first = tn.grams(h, w.doc, SHINGLE)
    out, doc = [g], [w.doc[first]]
    count = w.counts()
    begin = np.cumsum(count) - count
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            x, i = tn.grams(h, w.doc, n)
            pick = np.isin(i, begin[short])
            out.append(x[pick] + np.uint64(n))  # apart from five-word hashes
            doc.append(w.doc[i[pick]])
    return np.concatenate(out), np.concatenate(doc)


class Index:
    """Sketches of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, s) for i, t in items if (s := shingles(t))]
        probes: dict[int, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(self.items):
            upper = 2 ** (len(s).bit_length()) - 1  # of its size class
            take = math.floor((1 - THRESHOLD) * upper + 1e-9) + 1
            got, _ = _hashes(*tn.flat(pa.array([x.decode("utf-8", "surrogateescape") for x in s])))
            for h in np.sort(np.unique(got))[:take].tolist():
                probes[h].append(k)
        self.keys = np.array(sorted(probes), np.uint64)
        self.of = [probes[h] for h in self.keys.tolist()]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, buf: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
        """Items that share a sketch value, by text."""
        out: dict[int, set[int]] = defaultdict(set)
        if not len(self.keys):
            return out
        h, doc = _hashes(buf, at)
        pick = self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        h, doc = h[pick], doc[pick]
        i = np.searchsorted(self.keys, h)
        i[i == len(self.keys)] = 0
        for d, k in zip(doc[self.keys[i] == h].tolist(), i[self.keys[i] == h].tolist(), strict=True):
            out[d].update(self.of[k])
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64()), ("containment", pa.float64())])
SPARK_SCHEMA = "doc_id long, h1 long, h2 long, item_id long, shared long, item_shingles long, containment double"


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded text size."""
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = math.ceil(total / BLOCK_BYTES) or 1
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, h1, h2, item_id, shared, item_shingles, containment) for every document that holds at least
    THRESHOLD of an item's distinct shingles.

    Null and empty texts, of documents or items, match nothing. Repeated document or item rows give repeated pairs.
    """
    from .golay_simhash import with_row_key

    spark = docs.sparkSession
    tn.small_batches(spark)
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", "h1", "h2")
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for b in batches:
                got: list[tuple] = []
                for i, _, buf, at in tn.slices(b.column(1)):
                    for d, found in index.candidates(buf, at).items():
                        mine = shingles(b.column(1)[i + d].as_py())
                        row = [b.column(c)[i + d].as_py() for c in (0, 2, 3)]
                        for k in sorted(found):
                            item, s = index.items[k]
                            n = len(s & mine)
                            if n >= THRESHOLD * len(s) - 1e-9:
                                got.append((*row, item, n, len(s), n / len(s)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], f.type) for c, f in enumerate(SCHEMA)], schema=SCHEMA)

        part = rows.mapInArrow(tn.released(run), SPARK_SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that match no item; rows, columns and nulls as they were.

    The flag is made in the same pass, so texts are not shuffled.
    """
    spark = docs.sparkSession
    tn.small_batches(spark)
    cols = docs.columns
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for b in batches:
                texts = b.column(cols.index("text"))
                ok = np.ones(b.num_rows, bool)
                for i, _, buf, at in tn.slices(texts):
                    for d, found in index.candidates(buf, at).items():
                        mine = shingles(texts[i + d].as_py())
                        ok[i + d] = not any(len(s & mine) >= THRESHOLD * len(s) - 1e-9 for s in (index.items[k][1] for k in found))
                yield b.filter(pa.array(ok))

        docs = docs.mapInArrow(tn.released(run), docs.schema)
    return docs


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle(docs: str = "documents", items: str = "benchmark", select: str | None = None) -> str:
    """The pairs doc_id, item_id, shared, item_shingles, containment as DuckDB SQL."""
    words = lambda c: f"regexp_extract_all({LOWER_SQL.format(c)}, '[^\\x20\\x09-\\x0D]+')"
    cut = lambda ws: f"list_transform(range(1, greatest(len({ws}) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string({ws}[i:i + {SHINGLE - 1}], ' '))"
    return f"""
    with bi as (select row_number() over () r, item_id, {words('text')} ws from {items} where text is not null)
    , bs as (select r, item_id, unnest(list_distinct({cut('ws')})) g from bi where len(ws) > 0)
    , bn as (select r, count(*) n from bs group by r)
    , di as (select row_number() over () q, doc_id, {words('text')} ws from {docs} where text is not null)
    , ds as (select q, doc_id, unnest(list_distinct({cut('ws')})) g from di where len(ws) > 0)
    , m as (select q, any_value(doc_id) doc_id, bs.r, any_value(item_id) item_id, count(*) shared from ds join bs using (g) group by q, bs.r)
    select doc_id, item_id, shared::bigint shared, n::bigint item_shingles, shared::double / n containment from m join bn using (r) where shared >= {THRESHOLD}::double * n - 1e-9
    """
