"""Word-first language identification with character n-gram backoff.

Known words score by their log frequency in each language. A word that no language knows scores by
its characters: at every place, in each language, the longest n-gram (5 down to 1) that starts there
and that the language knows counts, less a penalty for each step down to it. So a language that must
lean on shorter strings pays for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

UND = "und"
NGRAMS = (5, 4, 3, 2, 1)
#: The classifier is fitted on at most about MAX_TEXTS training texts of a language, and FIT_TEXTS of all languages together, dealt
#: evenly; texts are taken whole, by hash of the id.
MAX_TEXTS, FIT_TEXTS = 2000, 20_000
#: Distinct values of lang beyond which the column can't be one of languages, and fitting fails.
MANY_LANGS = 10_000
#: Fewest training occurrences of a known word or n-gram; logarithm taken off for each step to a shorter n-gram.
MIN_COUNT, STEP = 2, 0.4
#: Places of unknown words times languages that are scored at a time.
_CELLS = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_TAG = {n: np.uint64(n) << np.uint64(58) for n in NGRAMS}


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[tn.Spans, np.ndarray]:
    w = tn.Spans(buf, at, ~_LETTER[buf])
    return w, tn.hashes(buf, w.start, w.end)


def _ngrams(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, place, word index, hash) of the character n-grams of words with a mark at both ends; the last place of a word is its end mark."""
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = code == 10
    word = np.cumsum(edge) - 1
    for n in NGRAMS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
        for j in range(n):
            h = h * _R + code[j : j + m] + np.uint64(1)
            if 0 < j < n - 1:
                inner |= edge[j : j + m]
        if n == 1:
            inner |= edge[:m]
        place = np.flatnonzero(~inner & (word[:m] < len(words)))
        yield n, place, word[place], (tn.mix(h[place]) >> np.uint64(6)) | _TAG[n]


@dataclass
class Table:
    """Log frequencies by key and language, for the languages that have the key."""

    keys: np.ndarray  # sorted
    start: np.ndarray  # where each key's entries begin, and their end
    lang: np.ndarray
    log: np.ndarray

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key of x, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.searchsorted(self.keys, x)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == x

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into at, language, log) of all entries of the keys at these places."""
        many = self.start[at + 1] - self.start[at]
        row = np.repeat(np.arange(len(at)), many)
        e = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[at], many)
        return row, self.lang[e], self.log[e]


@dataclass
class Model:
    langs: list[str]
    words: Table
    word_none: np.ndarray  # by language: log frequency of a word that others know
    grams: Table
    gram_none: np.ndarray  # by language: log frequency of a character that it lacks

    def word_scores(self, h: np.ndarray, words: list[str]) -> np.ndarray:
        """Log score of each distinct word for each language; words: the text of those that are unknown, by place."""
        at, known = self.words.find(h)
        out = np.tile(self.word_none, (len(h), 1))
        here = np.flatnonzero(known)
        row, lang, log = self.words.entries(at[here])
        out[here[row], lang] = log
        new = np.flatnonzero(~known)
        size = np.cumsum([len(words[i]) + 1 for i in new])
        part = size * len(self.langs) // _CELLS if len(new) else size
        for p in np.unique(part):
            mine = new[part == p]
            out[mine] = self._backoff([words[i] for i in mine])
        return out

    def _backoff(self, texts: list[str]) -> np.ndarray:
        """Mean over the places of each word of the log frequency of the longest n-gram that a language knows, less its steps."""
        size = sum(map(len, texts)) + len(texts) + 1
        value = np.full((size, len(self.langs)), np.nan)
        word_of = np.full(size, -1)
        for k, (_, place, word, g) in enumerate(_ngrams(texts)):
            word_of[place] = word
            at, hit = self.grams.find(g)
            place = place[hit]
            row, lang, log = self.grams.entries(at[hit])
            fresh = np.isnan(value[place[row], lang])
            value[place[row[fresh]], lang[fresh]] = log[fresh] - STEP * k
        at = np.flatnonzero(word_of >= 0)
        got = np.where(np.isnan(value[at]), self.gram_none - STEP * len(NGRAMS), value[at])
        count = np.bincount(word_of[at], minlength=len(texts))
        total = np.stack([np.bincount(word_of[at], weights=got[:, j], minlength=len(texts)) for j in range(len(self.langs))], axis=1)
        return total / np.maximum(count, 1)[:, None]

    def predict(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (of equal ones the first by name) and its share, for each lower-cased text; a text without words has share 0."""
        n = len(at) - 1
        w, h = _words(buf, at)
        if not len(h) or not self.langs:
            return np.zeros(n, np.int64), np.zeros(n)
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        _, known = self.words.find(h)
        raw = buf.tobytes()
        words = ["" if k else raw[a:b].decode("utf-8", "replace") for k, a, b in zip(known, w.start[first], w.end[first], strict=True)]
        scores = self.word_scores(h, words)
        total = np.stack([tn.by_doc(scores[inverse, k], w.doc, n) for k in range(len(self.langs))], axis=1)
        total /= np.sqrt(np.maximum(w.counts(), 1))[:, None]
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return best, np.where(w.counts() > 0, share, 0.0)


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def fit(labelled: DataFrame) -> Model:
    """A model from rows (key, text, lang) with no null lang; every language is learned.

    The sample is at most about MAX_TEXTS texts of each language and FIT_TEXTS in all, taken by hash of key, so rows that
    repeat a key are taken together; word and n-gram counts over it are grouped sums, of which those of MIN_COUNT and more
    are sent to the driver. No rows give a model without languages; more than MANY_LANGS values of lang are an error.
    """
    spark = labelled.sparkSession
    tn.small_batches(spark)
    sizes = labelled.groupBy("lang").count().limit(MANY_LANGS + 1).collect()
    if len(sizes) > MANY_LANGS:
        raise ValueError(f"lang has more than {MANY_LANGS} values")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        none = Table(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return Model([], none, np.zeros(0), none, np.zeros(0))
    most = min(MAX_TEXTS, FIT_TEXTS // len(langs))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, most / r["count"]))))
    number = {x: i for i, x in enumerate(langs)}
    sample = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)).select("text", "lang")
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("lang", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = np.array([number[x] for x in b.column(1).to_pylist()])
            texts = _lower(b.column(0))
            for i, j, buf, at in tn.slices(texts):
                w, h = _words(buf, at)
                lang = which[i:j][w.doc]
                raw = buf.tobytes()
                for k in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == k)
                    u, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    words = [raw[a:e].decode("utf-8", "replace") for a, e in zip(w.start[mine[first]], w.end[mine[first]], strict=True)]
                    parts = [(0, u, n)]
                    for _, _, word, g in _ngrams(words):
                        v, inv = np.unique(g, return_inverse=True)
                        parts.append((1, v, np.bincount(inv, weights=n[word]).astype(np.int64)))
                    for kind, key, m in parts:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, np.int32)), pa.array(m.astype(np.int64))], schema=schema)

    counts = sample.mapInArrow(tn.released(count), "kind int, key long, lang int, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    per = counts.groupBy("kind", "key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter(F.col("all") >= MIN_COUNT)
    got = per.select("kind", "key", F.col("by.lang").alias("lang"), F.col("by.n").alias("n")).toArrow().combine_chunks()
    kinds = got.column("kind").to_numpy()
    keys, many = got.column("key").to_numpy().view(np.uint64), pc.list_value_length(got.column("lang")).to_numpy()
    lang, n = (pc.list_flatten(got.column(c)).to_numpy() for c in ("lang", "n"))
    begin = np.cumsum(many) - many

    def table(kind: int) -> tuple[Table, np.ndarray]:
        """Frequencies are smoothed by half a count, and apart for n-grams of each length. Second: the log of none, for words or single characters."""
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(keys[rows])]
        size = many[rows]
        e = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[rows], size)
        length = (keys[rows] >> np.uint64(58)).astype(np.int64) if kind else np.zeros(len(rows), np.int64)
        each = np.repeat(length, size)
        total = np.zeros((max(NGRAMS) + 1, len(langs)))
        np.add.at(total, (each, lang[e]), n[e])
        room = total + 0.5 * np.maximum(np.bincount(length, minlength=len(total)), 1)[:, None]
        log = np.log((n[e] + 0.5) / room[each, lang[e]])
        return Table(keys[rows], np.concatenate([[0], np.cumsum(size)]), lang[e].astype(np.int64), log), np.log(0.5 / room[min(NGRAMS) if kind else 0])

    return Model(langs, *table(0), *table(1))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, from its whole text alone.

    `und` and score 0 if the text is null or has no letter, or if no language was learned. Of languages that score alike the
    first by name is taken. Repeated rows give a row each, an empty table gives none, other columns are ignored, and very
    long texts are read whole.
    """
    spark = docs.sparkSession
    tn.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UND], object)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            for i, j, buf, at in tn.slices(_lower(texts)):
                best, share = m.predict(buf, at)
                ok = letter[i:j] & (share > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names[np.where(ok, best, len(m.langs))], pa.string()), pa.array(np.where(ok, share, 0.0))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tn.released(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder modulo 3 is not 1, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter((remainder(3) != 1) & F.col("lang").isNotNull()).select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "lang"))
    got = detect(docs, model)
    return got.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
