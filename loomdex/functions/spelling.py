"""Edit distance, trigram similarity, deletions and letter case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def osa(s: str, t: str, most: int = 2) -> int | None:
    """Optimal string alignment distance (insert, delete, substitute, swap neighbours), None above most."""
    s, t = s.strip().lower(), t.strip().lower()
    if abs(len(s) - len(t)) > most:
        return None
    older: list[int] = []
    prev = list(range(len(t) + 1))
    for i in range(1, len(s) + 1):
        row = [i]
        for j in range(1, len(t) + 1):
            best = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (s[i - 1] != t[j - 1]))
            if i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, prev = prev, row
    return prev[-1] if prev[-1] <= most else None


@F.pandas_udf(T.IntegerType())
def osa_udf(s: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else osa(a, b) for a, b in zip(s, t, strict=True)], dtype="Int32")


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a word padded with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams (a, b: arrays of distinct trigrams)."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")


def deletes(word: Column) -> Column:
    """The word and all distinct strings with up to two characters removed; strings under two characters aren't shortened."""
    cut = lambda w: F.when(F.length(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w)))))
    once = cut(word)
    twice = F.flatten(F.transform(once, cut))
    return F.array_sort(F.array_distinct(F.concat(once, twice)))


def like_case(token: Column, new: Column) -> Column:
    """new in the case of token: all upper, first upper and the rest lower, or as it is."""
    capital = F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, 2, 1 << 30)))
    lettered = F.upper(token) != F.lower(token)
    head, tail = F.substring(token, 1, 1), F.substring(token, 2, 1 << 30)
    first = (head != F.lower(head)) & (tail == F.lower(tail)) & (tail != F.upper(tail))
    return F.when(lettered & (token == F.upper(token)), F.upper(new)).when(first, capital).otherwise(new)
