"""Hierarchical empirical Bayes quality classifier.

A document's own evidence is a log-likelihood ratio of a logistic classifier over hashed words and
shape bins. Its prior comes from its site: posteriors
of all documents are summed by path and by host, a path's rate is shrunk toward its host's and a
host's toward the global rate, by strengths fitted from the spread between groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .repetition import SYMBOLS
from .store import written

BITS = 18
BUCKETS = 1 << BITS
SHAPES = 8  # shape features, of up to 16 bins each, in the first buckets
#: Distinct labelled texts that the document classifier is fitted on at most.
FIT_TEXTS = 20_000
#: Which buckets it uses: texts that have them, and the likelihood ratio statistic (G) of their rates in the two classes.
LEAST, SCREEN = 3, 15.0
#: Steps, rate, penalty and settling term of its fit.
STEPS, RATE, PENALTY, SETTLE = 300, 0.1, 5e-5, 1e-4
#: A document is rejected from this posterior of low quality, or of toxicity, on.
REJECT = 0.5
#: Site groups up to which their rates are sent to all executors; more are joined.
SENT_GROUPS = 100_000
HEADS = ("low", "toxic")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?|")] = True


def buckets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of the distinct features of each text: its words, A-Z lowered and without ASCII punctuation, and bins of its shape."""
    n = len(at) - 1
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    count = lambda mask: (c := cum(mask))[at[1:]] - c[at[:-1]]
    low = tn.LOWER[buf]
    gap = (low < 128) & ~((low >= 97) & (low <= 122)) & ~((low >= 48) & (low <= 57))
    w = tn.Spans(buf, at, gap)
    h = tn.hashes(low, w.start, w.end)
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    bucket = np.where(bucket < 16 * SHAPES, bucket + 16 * SHAPES, bucket)
    pair = np.unique(w.doc * BUCKETS + bucket)
    doc, bucket = pair // BUCKETS, pair % BUCKETS
    words = np.maximum(w.counts(), 1)
    chars = np.maximum(count(~tn.SPACE[buf]), 1)
    distinct = np.bincount(doc, minlength=n)
    letters = np.maximum(count((low >= 97) & (low <= 122)), 1)
    same = np.flatnonzero((w.doc[1:] == w.doc[:-1]) & (h[1:] == h[:-1]))
    root = lambda share: np.sqrt(share) * 30  # noqa: E731  a quarter and more is one bin
    shape = [
        root(count(SYMBOLS[buf]) / chars),
        root(count(_UPPER[buf]) / letters / 3),
        root(count(_PUNCT[buf]) / chars),
        root(np.bincount(w.doc[same], minlength=n) / words / 3),
        distinct / words * 15,
        np.log2(words),
        chars / words * 1.2,
        root(count((buf >= 48) & (buf < 58)) / chars),
    ]
    at_bin = np.stack([16 * k + np.clip(x, 0, 15).astype(np.int64) for k, x in enumerate(shape)], axis=1)
    return np.concatenate([doc, np.repeat(np.arange(n), SHAPES)]), np.concatenate([bucket, at_bin.ravel()])


class Evidence:
    """Logistic weights by bucket for each head, given as log-likelihood ratios: without the log odds of the class itself."""

    def __init__(self, feature: np.ndarray, begin: np.ndarray, marks: np.ndarray):
        """feature: buckets of all texts back to back; begin: where each text's begin; marks: (text, head) 0 or 1."""
        n = len(marks)
        self.rate = (marks.sum(axis=0) + 0.5) / (n + 1.0)
        self.weight = np.zeros((BUCKETS, len(HEADS)))
        self.bias = np.zeros(len(HEADS))
        text = np.repeat(np.arange(n), np.diff(np.append(begin, len(feature))))
        for k in range(len(HEADS)):
            if 0 < marks[:, k].sum() < n:
                keep = self._telling(feature, text, marks[:, k])[feature]
                used, mine = np.unique(feature[keep], return_inverse=True)
                self.weight[used, k], self.bias[k] = self._fit(mine, text[keep], marks[:, k].astype(float), len(used))

    @staticmethod
    def _telling(feature: np.ndarray, text: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a bucket stands in LEAST texts and its rate of the class differs from that of all texts by a G of SCREEN: a word that
        few texts have, all of one class, tells too."""
        every = np.bincount(feature, minlength=BUCKETS).astype(float)
        bad = np.bincount(feature, weights=y[text], minlength=BUCKETS)
        rate = y.mean()
        share = lambda n, of: n * np.log(np.maximum(n, 1e-9) / np.maximum(of * every, 1e-9))
        return (every >= LEAST) & (2 * (share(bad, rate) + share(every - bad, 1 - rate)) > SCREEN)

    @staticmethod
    def _fit(feature: np.ndarray, text: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        """Penalised logistic regression by Adam over all rows; the bias starts at, and is reported apart from, the class's log odds."""
        w, m, v = (np.zeros(size + 1) for _ in range(3))
        prior = np.log(y.mean() / (1 - y.mean()))
        for t in range(1, STEPS + 1):
            z = np.bincount(text, weights=w[feature], minlength=len(y)) + w[size] + prior
            wrong = 1 / (1 + np.exp(-z)) - y
            g = np.append(np.bincount(feature, weights=wrong[text], minlength=size), wrong.sum()) / len(y)
            g[:size] += PENALTY * w[:size]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + SETTLE)
        return w[:size], float(w[size])

    def of(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, bucket = buckets(buf, at)
        n = len(at) - 1
        return np.stack([np.clip(tn.by_doc(self.weight[bucket, k], doc, n) + self.bias[k], -20, 20) for k in range(len(HEADS))], axis=1)


def fit(docs: DataFrame, labels: DataFrame) -> Evidence:
    """Fits the document classifier on at most FIT_TEXTS distinct labelled texts (those of the least hashes), whole texts.

    Copies count once, so a large group of copies doesn't teach its incidental words. What reaches the driver is
    bounded by FIT_TEXTS rows of distinct buckets.
    """
    tn.small_batches(docs.sparkSession)
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    picked = hashed.select("doc_id", "h").join(marks, "doc_id").groupBy("h").agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).orderBy("h").limit(FIT_TEXTS)
    schema = pa.schema([("h", pa.int64()), ("low", pa.int32()), ("toxic", pa.int32()), ("buckets", pa.list_(pa.int32()))])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # at most FIT_TEXTS
        for b in batches:
            fresh = []
            for r, h in enumerate(b.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    fresh.append(r)
            b = b.take(pa.array(fresh, pa.int64()))
            for i, j, buf, at in tn.slices(b.column(3)):
                doc, bucket = buckets(buf, at)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(bucket[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(3)] + [lists], schema=schema)

    rows = hashed.select("h", "text").join(F.broadcast(picked), "h").select("h", "low", "toxic", "text")  # FIT_TEXTS rows of three numbers
    got = rows.mapInArrow(tn.released(featured), "h long, low int, toxic int, buckets array<int>").groupBy("h").agg(*(F.first(c).alias(c) for c in ("low", "toxic", "buckets"))).orderBy("h").toArrow().combine_chunks()
    lists = got.column("buckets").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    marks = np.stack([got.column(h).to_numpy() for h in HEADS], axis=1)
    return Evidence(lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()[: len(lists)].astype(np.int64) - lists.offsets[0].as_py(), marks)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, head: str, rate: float) -> float:
    """Prior strength by moments: how far group rates spread beyond what their sizes explain."""
    r = groups.filter("n >= 2").agg(F.count("*").alias("k"), F.avg(F.pow(F.col(f"s_{head}") / F.col("n") - rate, 2)).alias("v"), F.avg(rate * (1 - rate) / F.col("n")).alias("noise")).first()
    if not r["k"] or r["k"] < 2:
        return 100.0
    between = max(r["v"] - r["noise"], 1e-6)
    return float(min(max(rate * (1 - rate) / between - 1, 5.0), 10_000.0))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns to carry, by default all of docs), host, path, llr_low, llr_toxic, host_low, path_low,
    host_toxic, path_toxic, p_low, p_toxic and kept.

    Rows stay as many as they are; repeated rows count, and are judged, as often as they stand. Null and empty texts have
    shape evidence only; a null host is a group of its own, apart from the empty one, and so is a null path of its host.
    Without labels every rate is 0.5 with no evidence, and nothing is rejected; a posterior of just REJECT is kept. A document
    with several labels has the worst of them. An empty table gives no rows; very long texts are read whole; columns of
    docs travel in row, so their names can't clash.
    """
    spark = docs.sparkSession
    evidence = fit(docs, labels)
    sent = spark.sparkContext.broadcast(evidence)
    site = [c.cast("string").alias(n) for c, n in ((host, "host"), (path, "path"))]

    def scored(columns: list[str]) -> DataFrame:
        """Evidence beside the columns, in one pass that holds no rows back."""
        given = docs.select(F.struct(*columns).alias("row"), *site, "text")
        schema = given.drop("text").schema
        for h in HEADS:
            schema = schema.add(f"llr_{h}", "double")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, buf, at in tn.slices(b.column(3)):
                    got = sent.value.of(buf, at)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), *(pa.array(got[:, k]) for k in range(len(HEADS)))], names=schema.names)

        return given.mapInArrow(tn.released(add), schema)

    rates = dict(zip(HEADS, evidence.rate.tolist(), strict=True))
    soft = {h: 1 / (1 + F.exp(-(F.col(f"llr_{h}") + _logit(F.lit(rates[h]))))) for h in HEADS}
    paths = scored([docs.columns[0]]).groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(soft[h]).alias(f"s_{h}") for h in HEADS))
    paths = written(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS))
    shrunk = lambda h, to, m: (F.col(f"s_{h}") + m * to) / (F.col("n") + m)
    strength = {h: (_strength(hosts, h, rates[h]), _strength(paths, h, rates[h])) for h in HEADS}
    hosts = hosts.select("host", *(shrunk(h, F.lit(rates[h]), strength[h][0]).alias(f"host_{h}") for h in HEADS))
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", *(f"host_{h}" for h in HEADS), *(shrunk(h, F.col(f"host_{h}"), strength[h][1]).alias(f"path_{h}") for h in HEADS))
    sites = sites.withColumnsRenamed({"host": "_h", "path": "_p"})
    small = paths.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS
    on = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    rows = scored(docs.columns if carry is None else carry)
    if small:
        rows = rows.join(F.broadcast(sites), on)
    else:  # a hot site is dealt over salts
        salts = 64
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("llr_low", "llr_toxic"), F.lit(salts)))
        rows = rows.join(sites.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), on & (F.col("_s") == F.col("_t"))).drop("_s", "_t")
    clip = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    rows = rows.withColumns({f"p_{h}": 1 / (1 + F.exp(-(F.col(f"llr_{h}") + _logit(clip(F.col(f"path_{h}")))))) for h in HEADS})
    return rows.withColumn("kept", (F.col("p_low") <= REJECT) & (F.col("p_toxic") <= REJECT)).drop("_h", "_p")


def by_source(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """classify() with a document's source as host and its source and language as path: null if either is."""
    return classify(docs, labels, F.col("source"), F.concat("source", F.lit("/"), "lang"), carry)


OUTPUT = ("row.doc_id", "host", "path", "llr_low", "llr_toxic", "host_low", "path_low", "host_toxic", "path_toxic", "p_low", "p_toxic", "kept")
