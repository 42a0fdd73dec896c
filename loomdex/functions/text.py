"""Tokenisers and the stemmer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)

#: Whole runs of ASCII letters and digits, with word boundaries as in Unicode.
TERM = r"(?U)\b[a-zA-Z0-9]{2,}\b"
#: Words of the spelling lexicon: no boundary, so long runs are cut.
SPELL_WORD = "[a-z]{2,32}"
#: Words of a spelling query.
QUERY_WORD = r"(?U)\b[a-zA-Z]{2,32}\b"


def terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Lower-cased search terms of a text in order, without stop words; null gives an empty array."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(every, lambda t: ~t.isin(*stop_words))


def distinct_terms(text: Column, stop_words=STOP_WORDS) -> Column:
    """Distinct terms in order of first occurrence."""
    return F.array_distinct(terms(text, stop_words))


def spell_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SPELL_WORD), F.lit(0))


def white_words(text: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def normal_text(text: Column) -> Column:
    """Lower-cased with each run of other than ASCII letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


# ---- Porter stemmer ----------------------------------------------------------

_VOWELS = frozenset("aeiou")
# Forms that the common extension of the algorithm maps as a whole.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes and replacements of the published steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i > 0 and out[i - 1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or just vowel, consonant."""
    s = _shape(word)
    return (len(word) >= 3 and s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # -ed and -ing
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        root = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)
        if root is not None and "v" in _shape(root):
            w = root
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    # final y
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _derived(w)
    for suffix, new in STEP3:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
            break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _derived(w[:-2])
    for suffix, new in STEP2:
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            return root + new if _measure(w[:-3] if suffix == "logi" else root) > 0 else w
    return w


@F.pandas_udf(T.StringType())
def stem_udf(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of a column; each term of a batch is stemmed once."""
    for s in words:
        yield s.map({w: stem(w) for w in s.dropna().unique()}, na_action="ignore")


def stem_prefix(stemmed: str) -> str:
    """What every term with this stem begins with: stemming changes a term's end alone, and puts back two letters at most."""
    return stemmed[:1] if stemmed in IRREGULAR.values() else stemmed[: max(1, len(stemmed) - 2)]
