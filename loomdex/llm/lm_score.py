"""Context-tree weighting over bytes, trained on the corpus by distributed counting.

A byte is eight binary decisions, each with a context tree of its own over the preceding bytes.
Every node holds a Krichevsky-Trofimov estimate; weighting mixes a node's estimate with its
children's at every depth. The trained tree depends on the training texts through the counts of
(context, byte) alone, so the model is made from n-gram counts, and a text's code length is a sum
of one value per n-gram.

Nothing of the model is held whole anywhere. A task packs the documents it reads into chunks, and a
chunk asks once for each distinct word and n-gram it holds. Requests go in two steps: those of SPREAD
chunks meet in cells, one for each of RANGES ranges of the key space, and are merged there; what cells
ask for then meets in buckets, where counts are summed. So each step deals a task's keys to a bounded
number of places, or to those of one range. Subtrees below three context bytes are weighted in
parts, each context whole, since so few n-grams can follow one; the depth above is summed over the
parts and joined back to them, and the two above that (256 x 255 nodes at most) are shared by all.
Values go back the way that the requests came.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .lang_id import remainder
from .store import written

#: Context bytes. A key holds them and the byte itself, and with a text's number in its slice it fits 64 bits.
DEPTH = 5
#: Text bytes of a chunk and of what is worked on at a time.
CHUNK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Ranges of the key space, chunks whose requests meet in a cell, requested keys of a bucket, and distinct n-grams of a part.
RANGES, SPREAD, BUCKET_KEYS, PART_KEYS = 64, 64, 1 << 20, 1 << 18
#: Context bytes below which a subtree is weighted in one part.
SPLIT = 3
END = 255  # no byte of UTF-8
WORD, GRAM, TEXT = 0, 1, 2
_U = np.uint64


# ---- n-grams and trees -------------------------------------------------------


def ngrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, doc) for each byte of each text and its end: the preceding DEPTH bytes, nearest first, then the byte. Before a text stand zeros."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at) + 1)
    begin = at[:-1] + np.arange(n)
    y = np.full(len(buf) + n, END, np.uint8)
    inside = np.ones(len(y), bool)
    inside[at[1:] + np.arange(n)] = False
    y[inside] = buf
    place = np.arange(len(y)) - begin[doc]
    key = y.astype(np.uint64)
    for j in range(1, DEPTH + 1):
        c = np.zeros(len(y), np.uint64)
        c[j:] = y[:-j]
        c[place < j] = 0
        key |= c << _U(8 * (DEPTH + 1 - j))
    return key, doc


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: Stirling's series after shifting by 8."""
    shift = np.zeros(len(x))
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - shift


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: id is the context << 8 | bit node (1 to 255)."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.ids, self.a, self.b = ids, a, b
        own = kt(a, b)
        self.weighted = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.stop = np.ones(len(ids)) if below is None else np.exp(own - self.weighted - math.log(2))

    def parents(self) -> tuple[Level, np.ndarray]:
        """The level above, and the place in it of each node's parent."""
        up, at = np.unique(_up(self.ids), return_inverse=True)
        add = lambda v: np.bincount(at, weights=v, minlength=len(up))
        return Level(up, add(self.a), add(self.b), add(self.weighted)), at


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node id at full depth and bit, of the eight decisions of each key, one decision after another."""
    ctx, x = (key >> _U(8)) << _U(8), key & _U(255)
    ids = [ctx | _U(1 << k) | (x >> _U(8 - k)) for k in range(8)]
    return np.concatenate(ids), np.concatenate([(x >> _U(7 - k)) & _U(1) for k in range(8)])


def _deepest(key: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    ids, bit = _bits(key)
    up, at = np.unique(ids, return_inverse=True)
    many = np.tile(n, 8)
    return Level(up, np.bincount(at, weights=many * (bit == 0), minlength=len(up)), np.bincount(at, weights=many * (bit == 1), minlength=len(up)), None), at, bit


def _up(ids: np.ndarray) -> np.ndarray:
    """Ids of the parents."""
    return ((ids >> _U(16)) << _U(8)) | (ids & _U(255))


def subtree_tops(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id at depth SPLIT - 1, a, b, log weight) summed over the depth-SPLIT nodes of these n-grams, whose subtrees must be whole."""
    level = _deepest(key, n)[0]
    for _ in range(DEPTH - SPLIT):
        level = level.parents()[0]
    up, at = np.unique(_up(level.ids), return_inverse=True)
    return up, *(np.bincount(at, weights=v, minlength=len(up)) for v in (level.a, level.b, level.weighted))


class Top:
    """Depths 1 and 0, of fixed size."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        self.levels = []
        order = np.argsort(ids)
        one = Level(ids[order], a[order], b[order], below[order])
        zero = one.parents()[0]
        for level, size in ((one, 1 << 16), (zero, 1 << 8)):
            dense = np.zeros((3, size))
            dense[2] = 0.5
            dense[:, level.ids.astype(np.int64)] = level.a, level.b, level.stop
            self.levels.append(dense)


def predict(key: np.ndarray, n: np.ndarray, joined: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], top: Top) -> np.ndarray:
    """log10 probability of each n-gram's byte after its context, under the weighted tree. joined: id (sorted), a, b and stop of the nodes at depth SPLIT - 1."""
    level, at, bit = _deepest(key, n)
    one = lambda a, b: (np.where(bit == 0, a, b) + 0.5) / (a + b + 1.0)
    p = one(level.a[at], level.b[at])
    for _ in range(DEPTH - SPLIT):
        level, up = level.parents()
        at = up[at]
        p = level.stop[at] * one(level.a[at], level.b[at]) + (1 - level.stop[at]) * p
    ids = _up(level.ids)
    i = np.searchsorted(joined[0], ids)[at]
    a, b, stop = (x[i] for x in joined[1:])
    p = stop * one(a, b) + (1 - stop) * p
    ids = ids[at]
    for dense, i in zip(top.levels, (_up(ids), ids & _U(255)), strict=True):
        a, b, stop = dense[:, i.astype(np.int64)]
        p = stop * one(a, b) + (1 - stop) * p
    return np.log10(p).reshape(8, -1).sum(axis=0)


# ---- distributed counting ----------------------------------------------------


def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, value = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((keys, np.uint64), (values, float)))
    order = np.argsort(key)
    return key[order], value[order]


def _merge(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed values."""
    key, value = _sorted(keys, values)
    if not len(key):
        return key, value
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(value, first)


class Counter:
    """Sums by key, merged whenever what came since the last time outgrows it."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.merged = self.held = 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(key)
        self.values.append(value)
        self.held += len(key)
        if self.held > 2 * self.merged + (1 << 20):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        got = _merge(self.keys, self.values)
        self.keys, self.values, self.merged = [got[0]], [got[1]], len(got[0])
        self.held = self.merged
        return got


def _blob(x: np.ndarray) -> bytes:
    """An array's bytes, first all lowest ones, then the next: sorted keys and small counts compress well so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _read(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _keys(x: bytes) -> np.ndarray:
    return _read(x, np.uint64)


def _floats(x: bytes) -> np.ndarray:
    return _read(x, np.float64)


def _counts(x: bytes) -> np.ndarray:
    return _read(x, np.uint32).astype(np.float64)


def _context(key: np.ndarray) -> np.ndarray:
    """Hash of an n-gram's SPLIT nearest context bytes."""
    return tn.mix(key >> _U(8 * (DEPTH + 1 - SPLIT)))


def _range(kind: int, key: np.ndarray) -> np.ndarray:
    """Range of a key: n-grams of a context share one."""
    return ((_context(key) if kind == GRAM else tn.mix(key)) % _U(RANGES)).astype(np.int64)


def _cut(place: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(place, columns of its rows) for each place that occurs, rows in the order they had."""
    if not len(place):
        return []
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return [(int(place[i]), *(c[i:j] for c in columns)) for i, j in zip(cut, np.append(cut[1:], len(place)), strict=True)]


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


_ASKED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("range", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])
_CELL = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("cell", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTAL = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("seen", pa.int64()), ("total", pa.float64())])
_PART = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_TOP = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("s", pa.float64())])
_LEVEL = pa.schema([("id", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("s", pa.float64()), ("stop", pa.float64())])
_VALUE = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_BACK = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("cell", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("n_bytes", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ask(batches: list[pa.RecordBatch]) -> pa.Table:
    """A chunk's rows: its texts, packed, and its requests by range."""
    t = pa.Table.from_batches(batches)
    chunk = uuid.uuid4().int >> 65
    train = (~t.column("held_out").to_numpy()).astype(float)
    found = {WORD: Counter(), GRAM: Counter()}
    for i, j, buf, at in tn.slices(t.column("text"), SLICE_BYTES):
        low = tn.LOWER[buf]
        w = tn.words(low, at)
        for kind, (key, doc) in ((WORD, (tn.hashes(low, w.start, w.end), w.doc)), (GRAM, ngrams(low, at))):
            for part in (0, 1):  # training texts, then the others, which ask without adding
                mine = key[train[i:j][doc] == 1 - part]
                mine.sort()
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
                found[kind].add(mine[first], np.diff(np.append(first, len(mine))) * float(1 - part))
    out = [(TEXT, chunk, 0, None, None, _pack(t))]
    for kind in list(found):
        key, count = found.pop(kind).sums()
        out += [(kind, chunk, r, _blob(k), _blob(c), None) for r, k, c in _cut(_range(kind, key), key, count.astype(np.uint32))]
    return _table(_ASKED, out)


def _all_keys(t: pa.Table) -> np.ndarray:
    return np.concatenate([_keys(x) for x in t.column("keys").to_pylist()])


def _looked_up(have: pa.Table):
    """A function from keys to their values in have."""
    key, value = _sorted([_keys(x) for x in have.column("keys").to_pylist()], [_floats(x) for x in have.column("values").to_pylist()])
    return lambda k: value[np.searchsorted(key, k)]


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: token counts, the smoothed unigram base_score and the context-tree score (log10), and bits per byte.

    Training texts are those with held_out false. A null text is empty: one token (the end), and the end symbol's
    score. With no training rows every count is zero and both models are uniform. Repeated rows count as often as
    they stand, and give a row each; an empty table gives none; other columns are ignored. Texts are whole: one longer than
    CHUNK_BYTES is a chunk of its own. Sets the session's Arrow batch to textnum.ARROW_ROWS rows.
    """
    spark = docs.sparkSession
    tn.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield from _ask(held).to_batches()
                held, size = [], 0
        if held:
            yield from _ask(held).to_batches()

    # Written before anything else reads it: chunks are numbered at random, and which documents share one depends on the task.
    asked = written(rows.mapInArrow(tn.released(ask), _ddl(_ASKED)))
    size = asked.agg(F.count(F.when(F.col("kind") == TEXT, 1)).alias("chunks"), F.sum(F.when(F.col("kind") == GRAM, F.octet_length("keys") / 8)).alias("keys")).first()
    cells = max(1, math.ceil(size["chunks"] / SPREAD))
    buckets = max(1, math.ceil((size["keys"] or 0) / (RANGES * BUCKET_KEYS)))
    requests = asked.filter(F.col("kind") < TEXT).select("kind", "range", F.pmod(F.xxhash64("chunk"), F.lit(cells)).alias("cell"), "chunk", "keys", "counts")
    n_end = rows.filter(~F.col("held_out")).count()

    def meet(t: pa.Table) -> pa.Table:
        kind, r, cell = (t.column(c)[0].as_py() for c in ("kind", "range", "cell"))
        key, count = _merge([_keys(x) for x in t.column("keys").to_pylist()], [_counts(x) for x in t.column("counts").to_pylist()])
        place = (tn.mix(key ^ _U(0x5851F42D4C957F2D)) % _U(buckets)).astype(np.int64)
        return _table(_CELL, [(kind, r, cell, b, _blob(k), _blob(c)) for b, k, c in _cut(place, key, count)])

    met = written(requests.select("kind", "range", "cell", "keys", "counts").groupBy("kind", "range", "cell").applyInArrow(meet, _ddl(_CELL)))

    def add(t: pa.Table) -> pa.Table:
        key, count = _merge([_keys(x) for x in t.column("keys").to_pylist()], [_floats(x) for x in t.column("counts").to_pylist()])
        return _table(_TOTAL, [(*(t.column(c)[0].as_py() for c in ("kind", "range", "bucket")), _blob(key), _blob(count), int((count > 0).sum()), float(count.sum()))])

    totals = written(met.groupBy("kind", "range", "bucket").applyInArrow(add, _ddl(_TOTAL)))
    stats = totals.groupBy("kind").agg(F.sum("seen").alias("v"), F.sum("total").alias("n"), F.sum(F.octet_length("keys") / 8).alias("keys")).collect()
    by_kind = {r["kind"]: r for r in stats}
    n_train = n_end + (int(by_kind[WORD]["n"]) if WORD in by_kind else 0)
    vocabulary = (n_end > 0) + (int(by_kind[WORD]["v"]) if WORD in by_kind else 0)
    in_range = max(1, math.ceil((by_kind[GRAM]["keys"] if GRAM in by_kind else 0) / (RANGES * PART_KEYS)))

    # context trees: n-grams by their SPLIT nearest context bytes; a range's go to parts of that range
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                key, count = _keys(b.column(2)[r].as_py()), _floats(b.column(3)[r].as_py())
                part = ((_context(key) >> _U(32)) % _U(in_range)).astype(np.int64) * RANGES + b.column(0)[r].as_py()
                yield from _table(_PART, [(p, b.column(1)[r].as_py(), _blob(k), _blob(c)) for p, k, c in _cut(part, key, count)]).to_batches()

    parts = totals.filter(F.col("kind") == GRAM).select("range", "bucket", "keys", "counts").mapInArrow(deal, _ddl(_PART))

    def gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _all_keys(t), np.concatenate([_floats(x) for x in t.column("values").to_pylist()])

    def tops(t: pa.Table) -> pa.Table:
        ids, a, b, s = subtree_tops(*gathered(t))
        return pa.Table.from_arrays([pa.array(np.full(len(ids), t.column("part")[0].as_py())), pa.array(ids.astype(np.int64)), pa.array(a), pa.array(b), pa.array(s)], schema=_TOP)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            level = Level(*(t.column(c).to_numpy(zero_copy_only=False) for c in range(4)))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in range(3)), pa.array(level.weighted), pa.array(level.stop)], schema=_LEVEL)

    below = written(parts.groupBy("part").applyInArrow(tops, _ddl(_TOP)))
    level = written(below.groupBy("id").agg(*(F.sum(c).alias(c) for c in "abs")).mapInArrow(weigh, _ddl(_LEVEL)))
    up = F.shiftleft(F.shiftright("id", 16), 8).bitwiseOR(F.col("id").bitwiseAND(F.lit(255)))
    above = level.groupBy(up.alias("id")).agg(*(F.sum(c).alias(c) for c in "abs")).toArrow()  # 256 x 255 rows at most
    top = spark.sparkContext.broadcast(Top(above.column("id").to_numpy().astype(np.uint64), *(above.column(c).to_numpy() for c in "abs")))

    def values(t: pa.Table, have: pa.Table) -> pa.Table:
        key, count = gathered(t)
        ids = have.column("id").to_numpy()
        order = np.argsort(ids)
        value = predict(key, count, (ids[order].astype(np.uint64), *(have.column(c).to_numpy()[order] for c in ("a", "b", "stop"))), top.value)
        cut = np.concatenate([[0], np.cumsum([len(x) // 8 for x in t.column("keys").to_pylist()])])
        r = t.column("part")[0].as_py() % RANGES
        return _table(_VALUE, [(GRAM, r, b, _blob(key[i:j]), _blob(value[i:j])) for b, i, j in zip(t.column("bucket").to_pylist(), cut, cut[1:], strict=False)])

    joined = below.select("part", "id").join(level.select("id", "a", "b", "stop"), "id")
    known = parts.groupBy("part").cogroup(joined.groupBy("part")).applyInArrow(values, _ddl(_VALUE))
    known = known.unionByName(totals.filter(F.col("kind") == WORD).select("kind", "range", "bucket", "keys", F.col("counts").alias("values")))

    def to_cells(want: pa.Table, have: pa.Table) -> pa.Table:
        of = _looked_up(have)
        kind, r = (want.column(c)[0].as_py() for c in ("kind", "range"))
        return _table(_BACK, [(kind, r, cell, k, _blob(of(_keys(k)))) for cell, k in zip(want.column("cell").to_pylist(), want.column("keys").to_pylist(), strict=True)])

    def to_chunks(want: pa.Table, have: pa.Table) -> pa.Table:
        of, kind = _looked_up(have), want.column("kind")[0].as_py()
        return _table(_ANSWER, [(chunk, kind, k, _blob(of(_keys(k)))) for chunk, k in zip(want.column("chunk").to_pylist(), want.column("keys").to_pylist(), strict=True)])

    place, cell = ("kind", "range", "bucket"), ("kind", "range", "cell")
    back = met.select(*place, "cell", "keys").groupBy(*place).cogroup(known.groupBy(*place)).applyInArrow(to_cells, _ddl(_BACK))
    answers = requests.select(*cell, "chunk", "keys").groupBy(*cell).cogroup(back.groupBy(*cell)).applyInArrow(to_chunks, _ddl(_ANSWER))

    room = n_train + vocabulary + 1

    def finish(t: pa.Table, have: pa.Table) -> pa.Table:
        tables = {}
        kinds = have.column("kind").to_pylist()
        for kind in (WORD, GRAM):
            mine = [i for i, k in enumerate(kinds) if k == kind]
            tables[kind] = _sorted([_keys(have.column("keys")[i].as_py()) for i in mine], [_floats(have.column("values")[i].as_py()) for i in mine])
        t = pa.ipc.open_stream(t.column("body")[0].as_buffer()).read_all()
        ids, held = t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks()
        out = []
        for i, j, buf, at in tn.slices(t.column("text"), SLICE_BYTES):
            low, m = tn.LOWER[buf], j - i
            w = tn.words(low, at)
            key, value = tables[WORD]
            u, inverse = np.unique(tn.hashes(low, w.start, w.end), return_inverse=True)
            c = value[np.searchsorted(key, u)] if len(u) else np.zeros(0)
            base = tn.by_doc(np.log10((c + 1) / room)[inverse], w.doc, m) + math.log10((n_end + 1) / room)
            seen = tn.by_doc((c > 0)[inverse], w.doc, m).astype(np.int64) + (n_end > 0)
            key, value = tables[GRAM]
            g, doc = ngrams(low, at)
            # sorted by key, so that neighbours ask for neighbouring entries
            packed = np.sort((g << _U(16)) | doc.astype(np.uint64))
            got = value[np.searchsorted(key, packed >> _U(16))]
            total = tn.by_doc(got, (packed & _U(0xFFFF)).astype(np.int64), m)
            size = np.diff(at)
            out.append(pa.RecordBatch.from_arrays(
                [ids.slice(i, m), held.slice(i, m), pa.array(w.counts() + 1), pa.array(seen), pa.array(np.full(m, n_train)), pa.array(size), pa.array(base), pa.array(total), pa.array(-total * math.log2(10) / np.maximum(size, 1))], schema=_OUT))
        return pa.Table.from_batches(out, schema=_OUT)

    # more tasks than chunks, so that few get several
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size["chunks"])
    texts = asked.filter(F.col("kind") == TEXT).select("chunk", "body").repartition(tasks, "chunk")
    return texts.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(finish, _ddl(_OUT))


def score_documents(docs: DataFrame) -> DataFrame:
    """score() learning from the documents whose crc32 remainder modulo 7 is not 2."""
    return score(docs, remainder(7) == 2)
