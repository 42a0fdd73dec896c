"""Repetition coverage: characters inside duplicated word n-grams and lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum as tn

#: n-gram length: largest share of a text's word characters inside n-grams of that length that occur twice or more; those of 5 and 8
#: words lie below the fifth of a text's words that fails it anyway.
MAX_COVERED = {3: 0.60, 4: 0.60, 5: 0.15, 8: 0.12}
#: Largest share of word characters inside lines equal to an earlier line.
MAX_LINE_COVERED = 0.20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("dup_line_chars", pa.int64())]
    + [(f"dup_chars_{n}", pa.int64()) for n in MAX_COVERED]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
SPARK_SCHEMA = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in SCHEMA)


def _twice(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice within its doc."""
    salted = tn.mix(key + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    order = np.sort(salted)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    at = np.searchsorted(again, salted)
    at[at == len(again)] = 0
    return again[at] == salted if len(again) else np.zeros(len(key), bool)


def covered(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in an n-gram that occurs twice or more in its text (first occurrence included)."""
    out = np.zeros(len(h) + 1, np.int64)
    g, at = tn.grams(h, doc, n)
    hit = at[_twice(g, doc[at])] if len(g) else at
    np.add.at(out, hit, 1)
    np.add.at(out, hit + n, -1)
    return np.cumsum(out)[:-1] > 0


def _lines(buf: np.ndarray, at: np.ndarray, w: tn.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that hold a word and equal an earlier one of their text: doc, start, end."""
    lines = tn.Spans(buf, at, buf == 10)
    has = np.zeros(len(lines.start), bool)
    has[np.searchsorted(lines.start, w.start, side="right") - 1] = True
    start, end, doc = lines.start[has], lines.end[has], lines.doc[has]
    key = tn.mix(tn.hashes(buf, start, end) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return doc[later], start[later], end[later]


def measure(buf: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n = len(at) - 1
    w = tn.words(buf, at)
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    chars = cum(tn.LEAD[buf] & ~tn.SPACE[buf])
    symbols = cum(SYMBOLS[buf])
    size = (chars[w.end] - chars[w.start]).astype(np.int64)
    h = tn.hashes(buf, w.start, w.end)
    out = {"n_words": w.counts(), "word_chars": chars[at[1:]] - chars[at[:-1]], "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}
    doc, start, end = _lines(buf, at, w)
    out["n_dup_lines"] = np.bincount(doc, minlength=n)
    out["dup_line_chars"] = tn.by_doc(chars[end] - chars[start], doc, n).astype(np.int64)
    for k in MAX_COVERED:
        inside = covered(h, w.doc, k)
        out[f"dup_chars_{k}"] = tn.by_doc(size * inside, w.doc, n).astype(np.int64)
        if k == 5:
            out["n_repeat_words"] = tn.by_doc(inside, w.doc, n).astype(np.int64)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    over = out["dup_line_chars"] > MAX_LINE_COVERED * out["word_chars"]
    for k, most in MAX_COVERED.items():
        over |= out[f"dup_chars_{k}"] > most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~over
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with repetition counts and a verdict.

    A null or empty text has no words, so base_failed is true and kept false. Repeated rows give a
    row each; other columns are ignored. Texts are whole; a text is never split over tasks.
    """
    tn.small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tn.per_row(measure, SCHEMA), SPARK_SCHEMA)


def oracle(table: str = "documents") -> str:
    """The same rows as DuckDB SQL."""
    dup = "\n".join(
        f""", g{n} as (select doc_id, i, count(*) over (partition by doc_id, g) > 1 dup from
      (select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and {n - 1} following) g from w) where len(g) = {n})
    , c{n} as (select w.doc_id, w.i, w.w, coalesce(bool_or(dup) over (partition by w.doc_id order by w.i rows between {n - 1} preceding and current row), false) inside from w left join g{n} using (doc_id, i))
    , s{n} as (select doc_id, sum(length(w)) filter (where inside)::bigint ch, count(*) filter (where inside) nw from c{n} group by 1)"""
        for n in MAX_COVERED
    )
    return f"""
    with d as (select doc_id, coalesce(text, '') text from {table})
    , a as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') ws, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols from d)
    , w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from a)
    , l as (select doc_id, line, row_number() over (partition by doc_id, line order by i) k from
        (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]'))
    , ld as (select doc_id, count(*) n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')))::bigint dup_line_chars from l where k > 1 group by 1)
    {dup}
    , m as (select a.doc_id, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, n_symbols::bigint n_symbols,
        coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(s5.nw, 0)::bigint n_repeat_words, coalesce(dup_line_chars, 0)::bigint dup_line_chars,
        {", ".join(f"coalesce(s{n}.ch, 0)::bigint dup_chars_{n}" for n in MAX_COVERED)}
        from a left join ld using (doc_id) {" ".join(f"left join s{n} on s{n}.doc_id = a.doc_id" for n in MAX_COVERED)})
    , b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
    select *, not base_failed and dup_line_chars <= {MAX_LINE_COVERED}::double * word_chars
      {" ".join(f"and dup_chars_{n} <= {x}::double * word_chars" for n, x in MAX_COVERED.items())} kept from b
    """
