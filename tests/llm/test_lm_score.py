import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import lm_score


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """A context-tree weighting model with explicit nodes, trained symbol by symbol."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for ctx, x in self.symbols(t):
                for node, bit in self.bits(x):
                    for d in range(depth + 1):
                        self.n[ctx[:d], node][bit] += 1
        self.kids = defaultdict(set)
        for ctx, node in self.n:
            if ctx:
                self.kids[ctx[:-1], node].add(ctx)
        self.memo = {}

    def symbols(self, t):
        b = bytes(c + 32 if 65 <= c < 91 else c for c in t.encode()) + b"\xff"
        for i, x in enumerate(b):
            yield tuple(b[i - j] if i >= j else 0 for j in range(1, self.depth + 1)), x

    @staticmethod
    def bits(x):
        for k in range(8):
            yield (1 << k) | (x >> (8 - k)), x >> (7 - k) & 1

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            own = log_kt(*self.n[ctx, node]) if (ctx, node) in self.n else 0.0
            if len(ctx) < self.depth:
                below = sum(self.weighted(c, node) for c in self.kids.get((ctx, node), ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[ctx, node] = own
        return self.memo[ctx, node]

    def score(self, t):
        total = 0.0
        for ctx, x in self.symbols(t):
            for node, bit in self.bits(x):
                p = None
                for d in range(self.depth, -1, -1):
                    c = self.n[ctx[:d], node] if (ctx[:d], node) in self.n else [0, 0]
                    own = (c[bit] + 0.5) / (sum(c) + 1)
                    if p is None:
                        p = own
                    else:
                        stop = math.exp(log_kt(*c) - self.weighted(ctx[:d], node) - math.log(2)) if sum(c) else 0.5
                        p = stop * own + (1 - stop) * p
                total += math.log10(p)
        return total


def base(text, train):
    tok = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for t in train for w in tok(t))
    room = sum(c.values()) + len(c) + 1
    return sum(math.log10((c[w] + 1) / room) for w in tok(text)), sum(c[w] > 0 for w in tok(text)), sum(c.values())


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_documents(df).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    train = [t or "" for i, t in enumerate(texts) if not held[i]]
    model = Brute(train, lm_score.DEPTH)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, known, n = base(t, train)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len((t or "").encode().split()) + 1, known, n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score == pytest.approx(model.score(t or ""), rel=1e-9)


def test_brute_force(spark, prose):
    check(spark, [prose(20, i) for i in range(20)] + ["", None, "Ünï 日本 A a", "a", "A", "aaaa", "\n \t"])


def test_many_chunks_cells_and_buckets(spark, prose, monkeypatch):
    """The same scores whatever the number of chunks, cells, buckets and parts; repeated rows go wherever they stand."""
    texts = [prose(30, i % 17) for i in range(60)] + ["", "x" * 3000]
    df = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    plain = lambda: sorted((r.doc_id, r.n_bytes, r.n_known, round(r.base_score, 9), round(r.score, 8)) for r in lm_score.score_documents(df).collect())
    want = plain()
    for name, value in (("CHUNK_BYTES", 500), ("SPREAD", 3), ("BUCKET_KEYS", 10), ("PART_KEYS", 20)):
        monkeypatch.setattr(lm_score, name, value)
    assert plain() == want and len(want) == len(texts)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.25, 1e3, 1e7])
    assert lm_score.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def test_bytes_of_a_context_sum_to_one():
    key = lm_score.ngrams(np.frombuffer(b"abracadabra", np.uint8), np.array([0, 11]))[0]
    key, n = np.unique(key, return_counts=True)
    ctx = key[3] >> np.uint64(8) << np.uint64(8)
    every = ctx | np.arange(256, dtype=np.uint64)
    both, count = lm_score._merge([key, every], [n.astype(float), np.zeros(256)])
    ids, a, b, below = lm_score.subtree_tops(both, count)
    two = lm_score.Level(ids, a, b, below)
    one, at = np.unique(lm_score._up(ids), return_inverse=True)
    top = lm_score.Top(one, *(np.bincount(at, weights=x) for x in (a, b, two.weighted)))
    p = 10 ** lm_score.predict(both, count, (ids, a, b, two.stop), top)
    assert p[np.searchsorted(both, every)].sum() == pytest.approx(1.0)


def test_odd_rows(spark, odd, empty):
    got = lm_score.score_documents(odd).collect()
    assert len(got) == odd.count()
    assert all(r.score < 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm_score.score_documents(empty).count() == 0
    nothing = lm_score.score(odd.limit(3), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
