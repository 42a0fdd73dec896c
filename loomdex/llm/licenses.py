"""Fuzzy search for short licence notices.

Each notice may hold k edits, so of k + 1 parts at least one stands unchanged (pigeonhole). Parts
are exact seeds found by str.find; around each hit the regex library's bounded-error match
verifies the notice and gives its span. Bounds go up from no edit to k: what matches within a bound
is taken from left to right, and the next bound is tried on the stretches between, so a better match
hides none that stands beside it.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textnum as tn

#: Phrases and labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices and labels of the method.
NOTICES = {
    "licensed under the apache license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "this work is licensed under": "licensed",
    "all rights reserved": "reserved",
    "dedicated to the public domain": "public-domain",
}
#: Characters of a notice for each edit that it may hold.
CHARS_PER_EDIT = 10

_KEEP = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def parts(notice: str) -> tuple[int, list[tuple[int, str]]]:
    """Edits allowed, and the k + 1 seeds with their offsets."""
    k = len(notice) // CHARS_PER_EDIT
    cut = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Finder:
    def __init__(self):
        self.notices = []
        for notice, label in NOTICES.items():
            k, seeds = parts(notice)
            plain = regex.escape(notice, literal_spaces=True)
            self.notices.append((notice, label, k, seeds, [regex.compile(f"(?:{plain}){{e<={e}}}") for e in range(k + 1)]))

    @staticmethod
    def windows(norm: str, size: int, k: int, seeds: list[tuple[int, str]]) -> list[list[int]]:
        """Stretches around the seeds, joined where they touch; every match within k edits lies in one of them."""
        places = set()
        for offset, seed in seeds:
            at = norm.find(seed)
            while at >= 0:
                places.add(at - offset)
                at = norm.find(seed, at + 1)
        out: list[list[int]] = []
        for p in sorted(places):  # a notice that has this seed in place starts within k of p
            a, b = max(0, p - k), min(len(norm), p + size + 2 * k)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return out

    def fuzzy(self, norm: str) -> list[tuple[int, int, str, float]]:
        """Spans (start, end, label, score) of every notice within its number of edits. Of one notice's matches that overlap,
        the one of fewer edits is reported, of equal ones the leftmost; matches that overlap no reported one are all reported."""
        out = set()
        for notice, label, k, seeds, patterns in self.notices:
            gaps = [(a, b) for a, b in self.windows(norm, len(notice), k, seeds) if patterns[k].search(norm, a, b)]
            for edits, pattern in enumerate(patterns):
                left = []
                for a, b in gaps:
                    for m in pattern.finditer(norm, a, b):
                        out.add((m.start(), m.end(), label, 1 - edits / len(notice)))
                        left.append((a, m.start()))
                        a = m.end()
                    left.append((a, b))
                gaps = [(a, b) for a, b in left if b - a >= len(notice) - k]
        return sorted(out)

    def scan(self, text: str) -> dict:
        words = text.encode().lower().translate(_KEEP).split()
        norm = b" ".join(words).decode("utf-8", "replace")
        padded = f" {norm} "
        places = []
        for phrase, label in PHRASES.items():
            number, seen, at = 0, 0, padded.find(f" {phrase} ")
            while at >= 0:
                number, seen = number + padded.count(" ", seen, at), at
                places.append((number, label))
                at = padded.find(f" {phrase} ", at + 1)
        spans = self.fuzzy(norm)
        base = {x for _, x in places}
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((i for i, _ in places), default=None),
            "last_word": max((i for i, _ in places), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[2] for s in spans})),
            "score": 1.0 if places else max((s[3] for s in spans), default=0.0),
            "spans": ",".join(f"{label}:{a}:{b}" for a, b, label, _ in spans),
        }


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
SPARK_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: exact phrases by word, and fuzzy notices with spans (code points of the normalised text: words joined by spaces).

    A null text counts as empty, and a blank one is like it: no words, no labels, null first_word and last_word, score 0.
    score is 1 where an exact phrase stands, else the best 1 - edits / length of a fuzzy notice. Repeated rows give a row
    each, an empty table gives none, other columns are ignored, and texts of any length are searched whole. Sets the
    session's Arrow batch to textnum.ARROW_ROWS rows.
    """
    tn.small_batches(docs.sparkSession)

    def run(batches):
        finder = Finder()
        for batch in batches:
            got = [finder.scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[f.name] for g in got], f.type) for f in list(SCHEMA)[1:])], schema=SCHEMA)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(tn.released(run), SPARK_SCHEMA)
