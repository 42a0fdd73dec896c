import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import bpe, lang_id, licenses, repetition, secrets
from loomdex.llm import textnum as tn
from loomdex.llm.queries import vocabulary

VOCABULARY = vocabulary()


# ---- shared primitives -------------------------------------------------------


def test_words_and_hashes_match_python():
    r = random.Random(2)
    texts = ["".join(r.choice("ab \n\tñ日") for _ in range(r.randrange(30))) for _ in range(300)] + ["", None]
    for most in (7, 64, 1 << 20):
        seen = []
        for i, _, buf, at in tn.slices(pa.array(texts), most):
            w = tn.words(buf, at)
            h = tn.hashes(buf, w.start, w.end)
            raw = buf.tobytes()
            seen += [(i + d, raw[a:b], x) for d, a, b, x in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), h.tolist(), strict=True)]
        assert [(d, w) for d, w, _ in seen] == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
        by = {}
        for _, w, x in seen:
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)


# ---- language ----------------------------------------------------------------


def test_language_of_unseen_words(spark):
    r = random.Random(1)
    en = lambda: " ".join("".join(r.choice(("th", "er", "ing", "on")) for _ in range(r.randrange(1, 4))) for _ in range(30))
    fr = lambda: " ".join("".join(r.choice(("eau", "ou", "ière", "ç")) for _ in range(r.randrange(1, 4))) for _ in range(30))
    rows = [(i, f() if i % 9 else None, name) for i in range(240) for f, name in (((en, "en") if i % 2 else (fr, "fr")),)]
    rows += [(1000, "123 ... 456", "en"), (1001, "ingthonering", None), (1002, "eauière", None), (1003, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == (lang if t else "und") for i, t, lang in rows[:240])
    assert (got[1000].lang_pred, got[1000].score) == ("und", 0.0)
    assert got[1001].lang_pred == "en" and got[1002].lang_pred == "fr"
    assert got[1003].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())


def brute_language(train, texts):
    """(language, share) of each text by plain dictionaries: words first, then the longest n-gram that a language knows."""
    import math
    import re
    from collections import Counter

    langs = sorted({x for _, x in train})
    split = lambda t: [w for w in re.findall(r"[a-z\u0080-\U0010ffff]+", t.lower())]

    def places(w):
        w = f"\n{w}\n"
        for i in range(len(w)):
            yield [w[i : i + n] for n in (5, 4, 3, 2, 1) if i + n <= len(w) and w[i : i + n] != "\n"]

    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in train:
        for w in split(t):
            words[x][w] += 1
            grams[x].update(g for p in places(w) for g in p)
    kept = lambda counts: {k for k, n in sum(counts.values(), Counter()).items() if n >= 2}
    known, shown = kept(words), kept(grams)
    room_w = {x: sum(n for w, n in words[x].items() if w in known) + 0.5 * len(known) for x in langs}
    room_g = {(x, k): sum(n for g, n in grams[x].items() if len(g) == k and g in shown) + 0.5 * max(1, sum(len(g) == k for g in shown)) for x in langs for k in range(1, 6)}

    def unknown(w, x):
        got = []
        for p in places(w):
            if p:
                hit = next((g for g in p if g in shown and grams[x][g]), None)
                got.append(math.log(0.5 / room_g[x, 1]) - 0.4 * 5 if hit is None else math.log((grams[x][hit] + 0.5) / room_g[x, len(hit)]) - 0.4 * (5 - len(hit)))
        return sum(got) / len(got)

    for t in texts:
        ws = split(t)
        total = {x: sum(math.log((words[x][w] + 0.5) / room_w[x]) if w in known else unknown(w, x) for w in ws) / math.sqrt(max(1, len(ws))) for x in langs}
        best = max(langs, key=total.get)
        yield best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_matches_brute_force(spark, monkeypatch):
    r = random.Random(5)
    parts = {"aa": ("th", "er", "ing", "on", "日"), "bb": ("eau", "ou", "ière", "on"), "cc": ("sch", "ei", "ung", "er")}
    make = lambda x: " ".join("".join(r.choice(parts[x]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 25)))
    train = [(make(x), x) for x in parts for _ in range(30)]
    texts = [make(x) for x in parts for _ in range(25)] + ["zzz", "th", "thschou eau", "日本 x", "ou " * 40]
    model = lang_id.fit(spark.createDataFrame([(i, *t) for i, t in enumerate(train)], "key long, text string, lang string"))
    want = list(brute_language(train, texts))
    for cells in (1 << 22, 50):
        monkeypatch.setattr(lang_id, "_CELLS", cells)
        got = lang_id.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
        assert [(r.lang_pred, pytest.approx(r.score)) for r in got] == want
    apart = lambda x: x - x[:, :1]
    mild = apart(model._backoff(texts))
    monkeypatch.setattr(lang_id, "STEP", 5.0)  # the penalty tells languages apart
    assert np.abs(apart(model._backoff(texts)) - mild).max() > 1


def test_many_languages_are_all_learned(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}word " * 3, f"l{i % 676:03d}") for i in range(1352)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(df.withColumnRenamed("doc_id", "key"))
    assert len(model.langs) == 676
    assert all(r.lang_pred == rows[r.doc_id][2] for r in lang_id.detect(df, model).collect())
    tie = spark.createDataFrame([(0, "same text", "b"), (1, "same text", "a"), (1, "same text", "a"), (0, "same text", "b")], "key long, text string, lang string")
    assert {r.lang_pred for r in lang_id.detect(tie.withColumnRenamed("key", "doc_id"), lang_id.fit(tie)).collect()} == {"a"}
    monkeypatch.setattr(lang_id, "MANY_LANGS", 5)
    with pytest.raises(ValueError):
        lang_id.fit(df.withColumnRenamed("doc_id", "key"))


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_odd_rows(spark, odd, empty):
    assert lang_id.identify(odd).count() == odd.count()
    assert lang_id.identify(empty).count() == 0
    got = lang_id.identify(odd.withColumn("lang", odd.lang.substr(9, 1))).collect()
    assert {r.lang_pred for r in got} <= {"", "und"}


def test_language_ignores_lang_source_and_id_in_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    model = lang_id.fit(docs.selectExpr("doc_id key", "text", "lang"))
    a = [(r.lang_pred, round(r.score, 12)) for r in lang_id.detect(docs, model).collect()]
    b = [(r.lang_pred, round(r.score, 12)) for r in lang_id.detect(docs.selectExpr("doc_id + 5 doc_id", "text"), model).collect()]
    assert a == b


# ---- repetition --------------------------------------------------------------


def test_repetition_rows(spark, odd, empty):
    got = {r.doc_id: r for r in repetition.repetition_rules(odd).collect()}
    assert repetition.repetition_rules(odd).count() == odd.count()
    assert got[2].base_failed and not got[2].kept and got[2].n_words == 0
    assert got[11].n_repeat_words == 800 and not got[11].kept
    assert got[4].kept and got[4].n_words == 30_000
    assert repetition.repetition_rules(empty).count() == 0


def test_repetition_brute_force():
    r = random.Random(3)
    for _ in range(200):
        ws = [r.choice("abc") for _ in range(r.randrange(40))]
        got = repetition.measure(*tn.flat(pa.array([" ".join(ws)])))
        for n in repetition.MAX_COVERED:
            g = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
            inside = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + n)}
            assert got[f"dup_chars_{n}"][0] == len(inside)


def test_equal_lines():
    got = repetition.measure(*tn.flat(pa.array(["a b\nc\na b\n\n\na b\n a b", None])))
    assert got["n_dup_lines"].tolist() == [2, 0] and got["dup_line_chars"].tolist() == [4, 0]


def test_repeated_passages_below_the_base_rule():
    own = [f"word{i}" for i in range(130)]
    again = own[:60] + own[40:50] + own[60:]  # ten words twice
    phrases = [w for x in own[:30] for w in ("alpha", "beta", "gamma", x)]
    got = repetition.measure(*tn.flat(pa.array([" ".join(x) for x in (own, again, phrases)])))
    assert got["base_failed"].tolist() == [False] * 3 and got["kept"].tolist() == [True, False, False]


# ---- secrets -----------------------------------------------------------------

KEY = "AKIA" + "Q7" * 8
BARE = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in secrets.secret_scan(df).collect()}


def test_weak_parts_need_a_complement(spark):
    far = " word" * 60
    got = scan(spark, f"id {KEY} then {BARE}", BARE, f"{KEY}{far} {BARE}", "see https://db.example.org/x", "token=abcdef123 at https://db.example.org/x", "user: bob", "user: bob password: hunter22")
    kinds = lambda i: [x.split(":")[0] for x in got[i].spans.split(",") if x]
    assert kinds(0) == ["access", "key40"] and kinds(1) == [] and kinds(2) == ["access"]
    assert kinds(3) == [] and kinds(4) == ["assign", "endpoint"] and kinds(5) == [] and kinds(6) == ["user", "assign"]


def test_failing_matches_are_dropped_after_matching(spark):
    got = scan(spark, "secret: token: abcdefg", "😀 API_KEY = 'abcdef'", "a" * 24 + " " + "b" * 23, "", None)
    assert [got[i].n_assign for i in range(5)] == [0, 1, 0, 0, 0] and got[2].n_hex == 1
    assert got[1].spans == "assign:2:19"
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"hex:0:24").hexdigest()


def test_many_matches(spark):
    text = " ".join(f"token=abc{i:05d}" for i in range(3000))
    got = scan(spark, text)[0]
    assert got.n_assign == 3000 and got.spans.endswith(f"assign:{len(text) - 14}:{len(text)}")


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, f"é {KEY} token=abcdef{'0' * 24} end", "x"), (1, f"é {KEY} token=abcdef{'0' * 24} end", "y"), (2, "clean", None), (3, None, "n")], "doc_id long, text string, h1 string")
    got = sorted(map(tuple, secrets.redact(df).collect()))
    assert got == [(1, "é [SECRET] [SECRET] end", "x"), (1, "é [SECRET] [SECRET] end", "y"), (2, "clean", None), (3, None, "n")]
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == odd.count()
    assert secrets.redact(empty).count() == 0 and secrets.secret_scan(empty).count() == 0
    assert secrets.secret_scan(odd).count() == odd.count()


def test_many_secrets_are_rewritten(spark):
    text = "é😀 " + " ".join(f"token=abc{i:05d} plain{i} {KEY}{'0' * 24}" if i % 7 else "word " * 300 for i in range(3000)) + " end"
    spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in scan(spark, text)[0].spans.split(",")))
    want, at = "", 0
    for a, b in spans:
        if a >= at:
            want += text[at:a] + secrets.MARK
        at = max(at, b)
    want += text[at:]
    got = secrets.redact(spark.createDataFrame([(0, text), (0, text), (1, "token=abcdefg")], "doc_id long, text string")).collect()
    assert len(spans) > 5000 and sorted((r.doc_id, r.text) for r in got) == [(0, want), (0, want), (1, secrets.MARK)]


def test_rewriting_by_a_shuffle(spark, odd, monkeypatch):
    """More spans than are sent: the same texts."""
    df = odd.unionByName(spark.createDataFrame([(20, f"PassWord = hunter22 é {KEY} {BARE}"), (20, f"PassWord = hunter22 é {KEY} {BARE}"), (21, "the password"), (None, "a" * 30)], "doc_id long, text string"), allowMissingColumns=True)
    plain = lambda: sorted(map(repr, secrets.redact(df).collect()))
    sent = plain()
    assert sum("[SECRET]" in x for x in sent) == 3
    monkeypatch.setattr(secrets, "SENT_SPANS", 0)
    assert plain() == sent


def test_native_plan(spark, odd):
    for made in (secrets.secret_scan(odd), secrets.redact(odd)):
        plan = made._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "monotonically"))


# ---- BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_same_ids_as_the_library(library):
    r = random.Random(4)
    chars = "aab e'st\n\t ñ日😀  0129.,!’ ​\x1c\x85"
    texts = ["".join(r.choice([*chars, "<|endoftext|>"]) for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(r.choice(x) for _ in range(r.randrange(2000, 9000))) for x in ("ab", "aaab", "thein", "日本a", "=", ".!", "etaoinshrdlu") for _ in range(4)]
    texts += ["a" * 5000, "ab" * 3000 + "<|endoftext|>" * 2 + " x", "", " ", "I'll'LL don't <|endoftext|", "".join(r.choice("etaoin") for _ in range(4000))]
    mine = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [mine.encode(t) if t else [] for t in texts] == want
    assert [mine.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_broken_utf8_decodes_like_the_library(library):
    mine = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    ids = library.encode("日本😀", add_special_tokens=False).ids
    for k in range(len(ids)):
        assert mine.decode(ids[k:]) == library.decode(ids[k:], skip_special_tokens=False)


def test_unknown_ids_decode(spark):
    df = spark.createDataFrame([(1, [64, 999_999, None]), (2, None), (None, []), (1, [64, 999_999, None])], "doc_id long, ids array<int>")
    a = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read()).decode([64])
    assert sorted((r.doc_id or 0, r.text) for r in bpe.bpe_decode(df, VOCABULARY).collect()) == [(0, ""), (1, a + "\ufffd" * 2), (1, a + "\ufffd" * 2), (2, "")]


def test_digests_and_round_trip(spark, odd, empty, library):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.bpe_digests(odd, VOCABULARY).collect()}
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id, len(ids)]
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(odd, VOCABULARY), VOCABULARY)
    assert sorted(((r.doc_id or 0), r.text) for r in back.collect()) == sorted(((r.doc_id or 0), r.text or "") for r in odd.collect())
    assert bpe.bpe_digests(empty, VOCABULARY).count() == 0


# ---- licences ----------------------------------------------------------------


def edit_search(notice, text):
    """Least edits of the notice against any substring of text."""
    prev = np.zeros(len(text) + 1, int)
    for i, c in enumerate(notice, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d)))
        prev = row
    return min(prev)


def test_fuzzy_labels_match_brute_force():
    r = random.Random(6)
    finder = licenses.Finder()
    for _ in range(150):
        notice = r.choice(list(licenses.NOTICES))
        s = list(notice)
        for _ in range(r.randrange(5)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice(["", "q", s[k] + "z"])
        norm = " ".join(("filler words " + "".join(s) + " more").split())
        want = {label for n, label in licenses.NOTICES.items() if edit_search(n, norm) <= licenses.parts(n)[0]}
        assert {x[2] for x in finder.fuzzy(norm)} == want


def test_phrases():
    got = licenses.Finder().scan("Cc-By cc by! All rights RESERVED; xcc by")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"], got["score"]) == (9, 3, 0, 4, "cc-by,reserved", 1.0)
    none = licenses.Finder().scan("")
    assert (none["n_words"], none["first_word"], none["labels"], none["score"]) == (0, None, "", 0.0)


def holds(notice, k, norm, spans, a, b):
    """Whether spans (start, end, edits) of one notice are, within norm[a:b], a best match, and so on in the stretches on both of its sides."""
    least = edit_search(notice, norm[a:b])
    if not spans:
        return least > k
    start, end, edits = min(spans, key=lambda x: (x[2], x[0]))
    left, right = [x for x in spans if x[1] <= start], [x for x in spans if x[0] >= end]
    return least == edits == edit_search(notice, norm[start:end]) and len(left) + len(right) + 1 == len(spans) and holds(notice, k, norm, left, a, start) and holds(notice, k, norm, right, end, b)


def test_every_span_is_reported():
    """Notices side by side, near ones beside exact ones, against dynamic programming."""
    r = random.Random(8)
    finder = licenses.Finder()
    assert finder.scan("all right reserved all rights reserved")["spans"] == "reserved:0:18,reserved:19:38"
    for _ in range(60):
        parts = []
        for notice in [r.choice(list(licenses.NOTICES))] * r.randrange(1, 4) + [r.choice(list(licenses.NOTICES))]:
            s = list(notice)
            for _ in range(r.randrange(6)):
                k = r.randrange(len(s))
                s[k : k + 1] = list(r.choice(["", "q", s[k] + "z"]))
            parts += ["".join(s), *(["filler"] * r.randrange(3))]
        norm = " ".join(" ".join(parts).split())
        for one in finder.notices:
            alone = licenses.Finder.__new__(licenses.Finder)
            alone.notices = [one]
            spans = [(a, b, round((1 - score) * len(one[0]))) for a, b, _, score in alone.fuzzy(norm)]
            assert holds(one[0], one[2], norm, spans, 0, len(norm))
        got = finder.scan(norm)
        words = norm.split()
        base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (got["n_words"], got["n_base"]) == (len(words), len(base))
        assert (got["first_word"], got["last_word"]) == (min((i for i, _ in base), default=None), max((i for i, _ in base), default=None))
        assert got["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert got["score"] == (1.0 if base else max((x[3] for x in finder.fuzzy(norm)), default=0.0))


def test_license_rows(spark, odd, empty):
    assert licenses.license_scan(odd).count() == odd.count()
    assert licenses.license_scan(empty).count() == 0
    text = "All rights reserved, CC-BY; " * 3
    rows = [(1, None), (2, " \n"), (3, text), (3, text), (None, "cc by")]
    got = [tuple(r)[:8] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    none = (0, 0, None, None, "", "", 0.0)
    assert sorted(got, key=repr) == sorted([(1, *none), (2, *none), *[(3, 15, 6, 0, 13, "cc-by,reserved", "cc-by,reserved", 1.0)] * 2, (None, 2, 1, 0, 0, "cc-by", "cc-by", 1.0)], key=repr)
