import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import decontam, golay_simhash, graph, merkle, quality_bayes


# ---- SimHash -----------------------------------------------------------------


def test_golay_code_is_perfect():
    syndrome, leader = golay_simhash._tables()
    assert len(set(leader.tolist())) == 2048
    v = np.random.default_rng(1).integers(0, 1 << 23, 2000, dtype=np.uint32)
    c = v ^ leader[golay_simhash._SYNDROME[0][v & 255] ^ golay_simhash._SYNDROME[1][v >> 8 & 255] ^ golay_simhash._SYNDROME[2][v >> 16]]
    assert (np.bitwise_count(v ^ c) <= 3).all()
    assert (golay_simhash.codeword(c) == golay_simhash.codeword(v)).all()


def test_close_fingerprints_share_a_key():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 3000, dtype=np.uint64))
    keys = []
    for x in (a, b):
        row, key = golay_simhash.keys(x)
        sets = defaultdict(set)
        for i, k in zip(row.tolist(), key.tolist(), strict=True):
            sets[i].add(k)
        keys.append(sets)
    assert all(keys[0][i] & keys[1][i] for i in range(3000))
    assert max(map(len, keys[0].values())) <= 16


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = defaultdict(list)
    for n in nodes:
        out[find(n)].append(n)
    return {n: min(g) for g in out.values() for n in g}


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_close_like_all_pairs(spark, monkeypatch, pairwise):
    """Random clusters, with keys resolved by pairs and by points alike."""
    monkeypatch.setattr(golay_simhash, "PAIRWISE", pairwise)
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << r.randrange(64) if r.random() < 0.7 else (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = classes([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], signed)
    got = graph.components(golay_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    roots = {r.node: r.root for r in got.collect()}
    assert {f: roots.get(f, f) for f in signed} == want


def test_fingerprint_by_definition():
    import xxhash

    for text in ("A b C d e", "one two", "one", "", None, "x y z " * 50):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        assert golay_simhash.fingerprint(text) == want


def test_components_of_a_long_chain(spark):
    n = list(range(200))
    random.Random(4).shuffle(n)
    got = graph.components(spark.createDataFrame(list(zip(n, n[1:], strict=False)), "a long, b long")).collect()
    assert len(got) == 200 and {r.root for r in got} == {0}


def test_near_duplicate_rows(spark, odd, empty, prose):
    got = golay_simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[3].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[4].component_id == by[5].component_id == 4
    assert golay_simhash.near_duplicates(empty).count() == 0
    kept = golay_simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert [i for none, i in ids if not none][:2] == [1, 4] and [i for _, i in ids].count(7) == 1
    assert golay_simhash.keep_one(empty).count() == 0


def test_rows_without_id_are_kept_by_text(spark, prose):
    texts = [prose(60, i) for i in range(6)]
    rows = [*((None, x) for x in texts[:4]), (None, texts[0]), (1, texts[4]), (None, texts[4]), (2, texts[5])]
    kept = golay_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([*((0, x) for x in texts[:4]), (1, texts[4]), (2, texts[5])])


def test_keep_one_by_a_shuffle(spark, odd, monkeypatch):
    """More rows to leave out than are sent: the same rows stay."""
    plain = lambda df: sorted(map(repr, df.collect()))
    sent = plain(golay_simhash.keep_one(odd))
    monkeypatch.setattr(golay_simhash, "SENT_KEYS", 0)
    assert plain(golay_simhash.keep_one(odd)) == sent


def test_hashes_of_many_spans():
    import xxhash

    r = random.Random(9)
    buf = np.array([r.randrange(256) for _ in range(3000)], np.uint8)
    start = np.array([r.randrange(2000) for _ in range(500)])
    end = start + np.array([r.choice([0, 1, 3, 4, 7, 8, 9, 31, 32, 33, 63, 64, 65, 999]) for _ in start])
    assert golay_simhash.xxh64(buf, start, end).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(start, end, strict=True)]


def test_tables_go_where_the_cluster_says(spark):
    """Without a shared folder nothing is written on a cluster; tables that are read no more can be dropped."""
    import os
    from types import SimpleNamespace

    from loomdex.llm import store

    bare = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(getConf=lambda: bare, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        store.shared_dir(far)
    got = store.written(spark.range(3))
    at = store._PATHS[got].removeprefix("file://")
    assert os.path.exists(at)
    store.drop(got)
    assert not os.path.exists(at)


# ---- decontamination ---------------------------------------------------------


def test_contained_items_match_brute_force(spark, prose):
    r = random.Random(7)
    items = [(i, prose(r.randrange(3, 60), f"i{i}")) for i in range(40)] + [(90, ""), (91, None), (92, "Two words")]
    docs = []
    for d in range(120):
        words = prose(r.randrange(5, 400), f"d{d}").split()
        for _ in range(r.randrange(3)):
            part = r.choice(items[:40])[1].split()
            part = part[: r.randrange(max(1, len(part) * 7 // 10), len(part) + 1)]
            if r.random() < 0.5 and part:
                part[r.randrange(len(part))] = "changed"
            words[k:k] = part if (k := r.randrange(len(words))) >= 0 else []
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else " ".join(words)))
    docs += [(500, "two WORDS"), (501, ""), (502, None), (503, "two words more")]
    want = set()
    for d, t in docs:
        for i, x in items:
            s = decontam.shingles(x)
            if s and len(s & decontam.shingles(t)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(df, it)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20
    assert {r.doc_id for r in decontam.clean(df, it).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_items_in_blocks(spark, monkeypatch, prose):
    items = spark.createDataFrame([(i, prose(20, f"b{i}")) for i in range(30)], "item_id long, text string")
    docs = items.selectExpr("item_id doc_id", "concat('start ', text, ' end') text")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()) == [(i, i) for i in range(30)]
    assert decontam.clean(docs, items).count() == 0


def test_decontamination_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "same words same words same words"), (None, "null id text with a few words"), (2, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.matches(odd, items).collect())
    assert got == [("11", "1"), ("None", "None")]
    clean = decontam.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert decontam.matches(odd, items.limit(0)).count() == 0 and decontam.matches(empty, items).count() == 0
    assert decontam.clean(odd, items.limit(0)).count() == odd.count()


# ---- quality -----------------------------------------------------------------


def test_quality_held_out(spark):
    """Documents without a label are judged like those with one: recall of low quality and toxicity, and clean documents kept."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_bayes.by_source(docs, labels.filter("doc_id % 4 <> 1"), ["doc_id"]).select("row.doc_id", "kept").join(labels, "doc_id").filter("doc_id % 4 = 1").collect()
    share = lambda rows: sum(rows) / len(rows)
    assert share([r.kept for r in got if r.quality == 1 and r.toxic == 0]) > 0.99
    assert share([not r.kept for r in got if r.quality == 0]) > 0.9
    assert share([not r.kept for r in got if r.toxic == 1]) > 0.9


def test_shrinkage_matches_brute_force(spark, sf_dir):
    """Rates of hosts and paths, their strengths and the posteriors, worked out from the documents' evidence by plain loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, F.lit("")).otherwise(F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = dict(zip(quality_bayes.HEADS, quality_bayes.fit(docs, labels).rate, strict=True))
    rows = quality_bayes.by_source(docs, labels).select(*quality_bayes.OUTPUT).collect()
    logit = lambda p: np.log(p / (1 - p))
    soft = lambda x: 1 / (1 + np.exp(-x))
    for head, rate in rates.items():
        sums = {}
        for r in rows:
            for key in ((r.host,), (r.host, r.path)):
                n, s = sums.get(key, (0, 0.0))
                sums[key] = n + 1, s + soft(r[f"llr_{head}"] + logit(rate))
        assert {(None,), ("",)} <= set(sums) and ("src8", None) in sums

        def strength(size, sums=sums, rate=rate):
            big = [(n, s) for k, (n, s) in sums.items() if len(k) == size and n >= 2]
            between = np.mean([(s / n - rate) ** 2 for n, s in big]) - np.mean([rate * (1 - rate) / n for n, _ in big])
            return min(max(rate * (1 - rate) / max(between, 1e-6) - 1, 5.0), 10_000.0)

        m_host, m_path = strength(1), strength(2)
        for r in rows:
            n, s = sums[r.host,]
            host = (s + m_host * rate) / (n + m_host)
            n, s = sums[r.host, r.path]
            path = (s + m_path * host) / (n + m_path)
            assert (r[f"host_{head}"], r[f"path_{head}"]) == (pytest.approx(host), pytest.approx(path))
            assert r[f"p_{head}"] == pytest.approx(soft(r[f"llr_{head}"] + logit(min(max(path, 1e-6), 1 - 1e-6))))
    assert all(r.kept == (r.p_low <= 0.5 and r.p_toxic <= 0.5) for r in rows)


def test_sites_pull_documents(spark, prose):
    """The same text is judged by its site: many bad neighbours raise the rate that it starts from, and few barely do."""
    junk = lambda i: " ".join(w + "###" for w in prose(40, i).upper().split())
    rows = [(i, junk(i) if i % 2 else prose(40, i), "good") for i in range(200)]
    rows += [(1000 + i, junk(1000 + i), "bad") for i in range(100)] + [(2000, prose(40, 5), "bad"), (2001, prose(40, 5), "good"), (2002, prose(40, 5), "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_bayes.by_source(docs, labels).select(*quality_bayes.OUTPUT).collect()}
    assert got[2000].path_low > got[2002].path_low and got[2000].host_low > got[2001].host_low
    assert got[2000].p_low > got[2001].p_low
    assert got[2002].path_low < got[2000].path_low


def test_quality_rows(spark, odd, empty, labels):
    got = quality_bayes.by_source(odd, labels)
    assert got.count() == odd.count()
    assert got.select("row.*").columns == odd.columns
    assert quality_bayes.by_source(empty, labels).count() == 0
    none = quality_bayes.by_source(odd, labels.limit(0)).collect()
    assert len(none) == odd.count() and all(r.kept for r in none)


def test_many_sites_are_joined(spark, odd, labels, monkeypatch):
    a = sorted((str(r.doc_id), round(r.p_low, 9)) for r in quality_bayes.by_source(odd, labels).select("row.doc_id", "p_low").collect())
    monkeypatch.setattr(quality_bayes, "SENT_GROUPS", 1)
    b = sorted((str(r.doc_id), round(r.p_low, 9)) for r in quality_bayes.by_source(odd, labels).select("row.doc_id", "p_low").collect())
    assert a == b


# ---- Merkle ------------------------------------------------------------------


def test_audit_finds_all_differences(spark):
    left = spark.range(5000).selectExpr("id number", "id * 20 offset", "concat('record ', id) record", "'x' hash", "id digest", "id node")
    right = left.filter("number <> 77").withColumn("record", F.when(F.col("number").isin(5, 4095), F.lit("x")).otherwise(F.col("record")))
    right = right.withColumn("offset", F.when(F.col("number") == 300, F.col("offset") + 1).otherwise(F.col("offset"))).select("number", "offset", "record")
    right = right.union(spark.createDataFrame([(-3, 0, "new"), (9000, 0, "new")], "number long, offset long, record string"))
    got = {r.number: r.status for r in merkle.audit(left, right).collect()}
    assert got == {5: "corrupt", 4095: "corrupt", 77: "missing", 300: "moved", -3: "extra", 9000: "extra"}
    assert merkle.audit(left, left).count() == 0


def test_offsets_are_in_every_hash_above(spark):
    left = spark.range(600).selectExpr("id number", "id * 20 offset", "'same' record")
    right = left.withColumn("offset", F.col("offset") + F.when(F.col("number") >= 590, 3).otherwise(0))
    for depth in range(4):
        x, y = (merkle.tree(merkle.leaves(t), depth)[depth].toPandas().set_index("node").hash for t in (left, right))
        assert sorted((x != y)[lambda d: d].index) == sorted({n // 16**depth for n in range(590, 600)})


def test_audit_of_small_and_repeated_records(spark):
    schema = "number long, offset long, record string"
    one = spark.createDataFrame([(0, 0, "a")], schema)
    assert merkle.audit(one, one.limit(0)).count() == 1 and merkle.audit(one.limit(0), one.limit(0)).count() == 0
    many = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (0, 0, "b")], schema)
    fewer = spark.createDataFrame([(0, 0, "a"), (0, 0, "a"), (0, 0, "b")], schema)
    assert merkle.audit(many, many.orderBy(F.desc("record"))).count() == 0
    assert [r.status for r in merkle.audit(many, fewer).collect()] == ["corrupt"]
    none = spark.createDataFrame([(None, None, None), (None, 5, "a"), (1, None, None)], schema)
    assert merkle.audit(none, none).count() == 0
    assert [r.status for r in merkle.audit(none, none.filter("number is null")).collect()] == ["missing"]


def test_warc_records_of_null_pages(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (2, None, "h" * 10_000), (2, None, "h" * 10_000)], "page_id long, url string, html string")
    got = merkle.warc_records(pages)
    assert got.count() == 4 and got.filter("record is null").count() == 0
    assert all("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n" in r.record for r in got.collect())
    assert [r.status for r in merkle.audit(got, got.filter("number >= 0")).collect()] == ["missing"]
