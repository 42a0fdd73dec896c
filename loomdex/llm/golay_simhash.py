"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments (23, 23 and 18 bits, the last padded), each decoded to the
nearest codeword of the perfect [23,12,7] Golay code. Two fingerprints that differ in at most two
bits have a point at most one bit from both; by pigeonhole each side flips one of the two bits, in
one segment. So a fingerprint's keys are the codeword triples of all points within one bit of it
(1 to 16 different ones), and any two linked fingerprints share a key. Candidates of a key are
verified by exact Hamming distance. Keys with many fingerprints are resolved exactly as well, by
the points themselves: at most 65 fingerprints lie within one bit of a point, and all those of a
point are linked to the smallest of them, so work stays linear in large groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .graph import components
from .store import drop, written

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of a key up to which its pairs are compared one by one.
PAIRWISE = 32
#: Rows to leave out or to look at again up to which their keys are sent to all executors; more are joined by a shuffle.
SENT_KEYS = 500_000
#: Shingles that are hashed at a time.
_HASH_BLOCK = 1 << 17
_BYTES = np.uint64(0x0101010101010101)
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte value at byte places 0 to 2, and the error pattern of each syndrome."""
    bit = []
    for i in range(24):
        x = 1 << i
        for k in range(i, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        bit.append(x)
    syndrome = np.zeros((3, 256), np.uint32)
    for p in range(3):
        for v in range(256):
            s = 0
            for k in range(8):
                s ^= bit[8 * p + k] if v >> k & 1 else 0
            syndrome[p, v] = s
    leader = np.zeros(1 << 11, np.uint32)
    for w in range(4):
        for where in combinations(range(23), w):
            s = 0
            for k in where:
                s ^= bit[k]
            leader[s] = sum(1 << k for k in where)
    return syndrome, leader


_SYNDROME, _LEADER = _tables()


def codeword(v: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit value."""
    v = v.astype(np.uint32)
    s = _SYNDROME[0][v & 255] ^ _SYNDROME[1][v >> 8 & 255] ^ _SYNDROME[2][v >> 16]
    return ((v ^ _LEADER[s]) >> 11).astype(np.uint64)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all different keys of each fingerprint (uint64)."""
    parts = [(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
    index = [codeword(p) << np.uint64(12 * i) for i, p in enumerate(parts)]
    near = [index[0] | index[1] | index[2]]
    for i, (_, n) in enumerate(SEGMENTS):
        rest = np.bitwise_or.reduce([x for j, x in enumerate(index) if j != i])
        near += [(codeword(parts[i] ^ np.uint64(1 << k)) << np.uint64(12 * i)) | rest for k in range(n)]
    every = np.sort(np.stack(near, axis=1), axis=1)
    fresh = np.ones(every.shape, bool)
    fresh[:, 1:] = every[:, 1:] != every[:, :-1]
    row, col = np.nonzero(fresh)
    return row, every[row, col]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(x: np.ndarray, into: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turn(into + x * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[start:end] for many spans at once: all spans take their first eight bytes, then all that have more their next."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        data = np.concatenate([buf, np.zeros(8, np.uint8)])
        word = np.ndarray(len(buf) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
        size, at = end - start, start.copy()
        s = np.uint64(seed)
        h = np.full(len(start), s + _P5, np.uint64)
        if len(long := np.flatnonzero(size >= 32)):
            acc = np.repeat(np.array([[s + _P1 + _P2], [s + _P2], [s], [s - _P1]], np.uint64), len(long), axis=1)
            on = np.arange(len(long))
            while len(on):
                place = at[long[on]]
                for k in range(4):
                    acc[k, on] = _lane(word[place + 8 * k], acc[k, on])
                at[long[on]] += 32
                on = on[end[long[on]] - at[long[on]] >= 32]
            mixed = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for k in range(4):
                mixed = (mixed ^ _lane(acc[k])) * _P1 + _P4
            h[long] = mixed
        h += size.astype(np.uint64)
        on = np.flatnonzero(end - at >= 8)
        while len(on):
            h[on] = _turn(h[on] ^ _lane(word[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            on = on[end[on] - at[on] >= 8]
        on = np.flatnonzero(end - at >= 4)
        h[on] = _turn(h[on] ^ ((word[at[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[on] += 4
        on = np.flatnonzero(at < end)
        while len(on):
            h[on] = _turn(h[on] ^ (data[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            on = on[at[on] < end[on]]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def fingerprint_many(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the three-word shingles of each text; no words: 0."""
    n = len(at) - 1
    w = tn.words(buf, at)
    if not len(w.start):
        return np.zeros(n, np.uint64)
    size = w.end - w.start
    after = np.cumsum(size + 1)  # words back to back, a blank behind each
    norm = np.full(after[-1], 0x20, np.uint8)
    inside = ~tn.SPACE[buf]
    norm[np.arange(inside.sum()) + np.repeat(np.arange(len(size)), size)] = tn.LOWER[buf[inside]]
    begin, end = after - size - 1, after - 1
    count = w.counts()
    first = np.cumsum(count) - count
    last = np.minimum(np.arange(len(size)) + SHINGLE, (first + count)[w.doc]) - 1
    pick = np.flatnonzero((last - np.arange(len(size)) == SHINGLE - 1) | (np.arange(len(size)) == first[w.doc]))
    start, stop, doc = begin[pick], end[last[pick]], w.doc[pick]
    ones = np.zeros((n, 64), np.int64)  # bit 8 * byte + k
    for i in range(0, len(start), _HASH_BLOCK):
        j = min(i + _HASH_BLOCK, len(start))
        a, b = start[i], stop[i:j].max()
        h = xxh64(norm[a:b], start[i:j] - a, stop[i:j] - a)
        mine = doc[i:j]
        fresh = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        length = np.diff(np.append(fresh, len(mine)))
        cut = np.flatnonzero((np.arange(len(mine)) - np.repeat(fresh, length)) % 255 == 0)  # eight counters of a byte each
        for k in range(8):
            part = np.add.reduceat((h >> np.uint64(k)) & _BYTES, cut).astype("<u8").view(np.uint8).reshape(-1, 8)
            np.add.at(ones[:, k::8], mine[cut], part)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint(text: str | None) -> int:
    return int(fingerprint_many(*tn.flat(pa.array([text], pa.large_string())))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h1, h2 (together naming a row's id and text) and fp, the fingerprint as a signed long."""
    tn.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in tn.slices(b.column(3)):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(fingerprint_many(buf, at).view(np.int64))], schema=schema)

    return with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "h1", "h2", "text").mapInArrow(tn.released(run), "doc_id long, h1 long, h2 long, fp long")


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64("text", "doc_id", F.lit(1))})


def _with_keys(fps: DataFrame) -> DataFrame:
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key.view(np.int64))], schema=schema)

    return fps.select("fp").mapInArrow(tn.released(run), "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints whose closure is that of all pairs within MAX_BITS (fps: distinct values)."""
    keyed = written(_with_keys(fps))
    size = keyed.groupBy("key").count().filter("count > 1")
    cold = keyed.join(size.filter(F.col("count") <= PAIRWISE).select("key"), "key")
    left, right = cold.select("key", F.col("fp").alias("a")), cold.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & close).select("a", "b")
    hot = keyed.join(size.filter(F.col("count") > PAIRWISE).select("key"), "key", "left_semi").select("fp").distinct()
    points = hot.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # 65 at most
    stars = hubs.select("a", F.explode("all").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, h1, h2, fingerprint (16 hex digits), root (a fingerprint, one for each component) and
    component_id, the smallest doc_id that links of at most two differing bits reach (itself included).

    Texts without words have fingerprint zero and are linked like any other; a null text is empty. Copies and repeated rows
    share a fingerprint and are never made into pairs. A null doc_id takes part but names no component unless all are null.
    An empty table gives no rows; texts of any length are hashed whole, in blocks; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(fps))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "h1", "h2", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component left: that of the smallest doc_id (null ids last, then by text hash); of
    rows that repeat id and text, one. Columns stay as they are.

    Texts are shuffled only where the rows to leave out are more than SENT_KEYS.
    """
    groups = written(near_duplicates(docs).select("doc_id", "h1", "h2", "root"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("k")).select("k.h1", "k.h2", F.lit(True).alias("first"))
    sizes = groups.groupBy("h1", "h2").agg(F.count("*").alias("n")).join(first, ["h1", "h2"], "left")
    marked = written(sizes.select("h1", "h2", "n", F.coalesce("first", F.lit(False)).alias("first")).filter("n > 1 or not first"))
    cols = docs.columns
    rows = with_row_key(docs.select(F.struct(*cols).alias("row"), "doc_id", "text")).select("row", "h1", "h2")
    out, again = marked.select("h1", "h2"), marked.filter("first").select("h1", "h2")
    if marked.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        out, again = F.broadcast(out), F.broadcast(again)
    kept = rows.join(out, ["h1", "h2"], "left_anti")
    if marked.filter("first").limit(1).count():  # rows that repeat id and text: one of each
        kept = kept.unionByName(rows.join(again, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    drop(groups)
    return kept.select("row.*")
