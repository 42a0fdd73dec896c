"""Byte-level BPE by batched numpy merge rounds.

All unseen pre-tokens of a batch become one flat symbol array. Each round looks every adjacent
pair up in the sorted pair keys by binary search, finds each word's lowest rank, and merges that
pair wherever it stands in the word, left to right; words without a known pair leave the array.
A very long word has as many rounds as it has different ranks to merge. It goes through the same
rounds by itself, with the lowest rank kept for each block of places, so that a round looks at the
blocks that have it instead of at the whole word.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import textnum as tn

#: The public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept between batches, and the length beyond which one's rounds go by blocks of so many places.
CACHE_WORDS, LONG_WORD, BLOCK = 200_000, 2000, 512
NONE = np.int64(1) << 62
_UNKNOWN = "\ufffd".encode()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a byte-level vocabulary given as tokenizer JSON text."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab = j["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.base = np.array([vocab[c] for c in symbols], np.int64)
        self.wide = max(vocab.values()) + 2
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        keys = np.array([vocab[a] * self.wide + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        added = [(t["content"], t["id"]) for t in j.get("added_tokens", [])]
        self.bytes_of |= {i: t.encode() for t, i in added}
        self.added = dict(added)
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t, _ in sorted(added, key=lambda x: -len(x[0]))) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.fixed = {(t,): (str(i), 1, t.encode()) for t, i in added}
        self.cache, self.older = dict(self.fixed), {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.wide + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list = [None] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= LONG_WORD]
        for k, p in enumerate(pieces):
            if len(p) > LONG_WORD:
                out[k] = self._merge_long(p)
        if not short:
            return out
        size = np.array([len(pieces[k]) for k in short])
        sym = self.base[np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), size)
        rank = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            done = best == NONE
            if done.any():
                for f, c in zip(first[done].tolist(), count[done].tolist(), strict=True):
                    out[short[word[f]]] = sym[f : f + c].tolist()
                keep = np.repeat(~done, count)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                best, count = best[~done], count[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, count))
            if len(at) > 1 and (np.diff(at) == 1).any():  # runs such as aaaa: every second place
                fresh = np.concatenate([[True], np.diff(at) != 1])
                at = at[(at - at[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol has gone for each merge before
            sym, word, rank = sym[keep], word[keep], rank[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = self._ranks(sym, word, near)
        return out

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place, NONE at a word's last symbol."""
        right = np.minimum(at + 1, len(sym) - 1)
        inside = (word[right] == word[at]) & (right > at)
        return np.where(inside, self.rank(sym[at], sym[right]), NONE)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The rounds of one long pre-token. Places stay: a merged pair's right place drops out of the chain of those that follow each other."""
        n = len(piece)
        sym = self.base[np.frombuffer(piece, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there = np.ones(n, bool)
        rank = np.full(-(-n // BLOCK) * BLOCK, NONE)
        rank[: n - 1] = self.rank(sym[:-1], sym[1:])
        blocks = rank.reshape(-1, BLOCK)
        least = blocks.min(axis=1)
        while (best := least.min()) < NONE:
            hit = np.flatnonzero(least == best)
            row, col = np.nonzero(blocks[hit] == best)
            at = hit[row] * BLOCK + col
            chained = after[at[:-1]] == at[1:]
            if chained.any():  # runs such as aaaa: every second place
                fresh = np.concatenate([[True], ~chained])
                number = np.arange(len(at))
                at = at[(number - number[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            sym[at], after[at], there[gone], rank[gone] = self.made[best], after[gone], False, NONE
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            near = np.concatenate([at, before[at]])
            near = np.unique(near[near >= 0])
            right = after[near]
            rank[near] = np.where(right < n, self.rank(sym[near], sym[np.minimum(right, n - 1)]), NONE)
            touched = np.unique(np.concatenate([near, gone]) // BLOCK)
            least[touched] = blocks[touched].min(axis=1)
        return sym[there].tolist()

    def _learn(self, new: list[str]) -> None:
        name, raw = self.name_of, self.bytes_of
        for w, ids in zip(new, self.merge([w.encode() for w in new]), strict=True):
            self.cache[w] = (",".join([name[i] for i in ids]), len(ids), b"".join([raw[i] for i in ids]))

    def encode_many(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text its pre-tokens' (ids joined by commas, number of ids, bytes that the ids decode to)."""
        pieces: list[list] = []
        for t in texts:
            if self.split_added is None or not any(a in t for a in self.added):
                pieces.append(self.pattern.findall(t))
            else:  # an added token stands as a tuple, apart from the same text in a pre-token
                pieces.append([x for part in self.split_added.split(t) for x in ([(part,)] if part in self.added else self.pattern.findall(part))])
        if len(self.cache) > CACHE_WORDS // 2:  # what has not been met since the last time goes
            self.cache, self.older = dict(self.fixed), self.cache
        new = []
        for x in {x for p in pieces for x in set(p)}:
            if x not in self.cache:
                if x in self.older:
                    self.cache[x] = self.older[x]
                else:
                    new.append(x)
        if new:
            self._learn(new)
        get = self.cache.__getitem__
        return [list(map(get, p)) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.encode_many([text])[0] for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of.get(i, _UNKNOWN) for i in ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def load(spec: str) -> Bpe:
    return Bpe(spec)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
SPARK_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_spec(spark: SparkSession, path: str) -> str:
    """The vocabulary's JSON (a few MB, of fixed size), read on the driver and sent with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    for i, j, _, _ in tn.slices(batch.column(1)):
        yield i, j, [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and of the decoded text for every row.

    vocabulary is the path of a tokenizer JSON. A null text counts as empty: no ids, digests of the empty string. Repeated
    rows give a row each, an empty table gives none, other columns are ignored. Texts are encoded whole, very long ones and
    very long words too; memory follows the longest. The vocabulary travels as a broadcast variable; its size is that of the file.
    """
    spark = docs.sparkSession
    tn.small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(spark, vocabulary))

    def run(batches):
        bpe = load(spec.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for i, j, texts in _texts(batch):
                got = bpe.encode_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([sum(x[1] for x in g) for g in got], pa.int64()),
                        pa.array([sha(",".join([x[0] for x in g]).encode()) for g in got], pa.string()),
                        pa.array([sha(b"".join([x[2] for x in g]).decode("utf-8", "replace").encode()) for g in got], pa.string()),
                    ],
                    schema=SCHEMA,
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tn.released(run), SPARK_SCHEMA)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has an empty array."""
    spark = docs.sparkSession
    tn.small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(spark, vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = load(spec.value)
        for batch in batches:
            for i, j, texts in _texts(batch):
                ids = [[int(x) for w in g for x in w[0].split(",")] for g in bpe.encode_many(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tn.released(run), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every (doc_id, ids) row; null ids decode to the empty text, and a null or unknown id
    to the replacement character. Repeated rows give a row each; an empty table gives none."""
    spark = encoded.sparkSession
    tn.small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(spark, vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        bpe = load(spec.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(tn.released(run), "doc_id long, text string")
