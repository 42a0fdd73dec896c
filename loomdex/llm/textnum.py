"""Vectorised text primitives over Arrow string columns.

A batch's texts lie back to back in one byte array; words, lines and shingles are
index arrays into it. Work goes in slices of a bounded number of bytes, so memory
follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 19, 50_000
ARROW_ROWS = 1000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

_R = 0x9E3779B97F4A7C15 | 1
_M = 1 << 64
_TABLE = np.random.default_rng(20240917).integers(1, _M, 256, dtype=np.uint64)
_POW = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def small_batches(spark) -> None:
    """Bound the rows of an Arrow batch, since texts can be long. The setting is the session's and stays: it is read when a plan runs, after we return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        n = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _R), ("down", pow(_R, -1, _M))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
        _POW["n"] = n
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply), so that equal low bits don't cluster."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of at most SLICE_ROWS texts of at most `most` bytes, or one text."""
    buf, at = flat(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        j = min(j, n, i + SLICE_ROWS)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Spans:
    """Runs of non-separator bytes that stay within a text: start, end and doc index of each."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, gap: np.ndarray):
        self.n_docs = len(at) - 1
        first = np.zeros(len(buf) + 1, bool)
        first[at] = True
        on = ~gap
        before = np.ones(len(buf), bool)
        before[1:] = gap[:-1]
        after = np.ones(len(buf), bool)
        after[:-1] = gap[1:]
        self.start = np.flatnonzero(on & (before | first[:-1]))
        self.end = np.flatnonzero(on & (after | first[1:])) + 1
        self.doc = np.searchsorted(at, self.start, side="right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words(buf: np.ndarray, at: np.ndarray) -> Spans:
    """Words `[^\\x20\\x09-\\x0D]+` of each text."""
    return Spans(buf, at, SPACE[buf])


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for each span, by one rolling sum over the buffer."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n word hashes within one text, and the index of its first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for j in range(n):
        g = g * np.uint64(_R) + h[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[at]), at


def by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def release() -> None:
    """Gives free memory back to the system: a Python worker is kept for later tasks, and with it what it held at its most."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with release() when a task has ended."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def per_row(make: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: pa.Schema):
    """A mapInArrow function: doc_id (first column) as it is, and what `make` gives for each slice of the text (second column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at in slices(batch.column(1)):
                got = make(buf, at)
                cols = [batch.column(0).slice(i, j - i), *(pa.array(got[f.name]).cast(f.type) for f in list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return released(run)
