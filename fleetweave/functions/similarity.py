"""Similarity of texts: levels of edit distance and Jaro-Winkler."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    matched = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (ch for j, ch in enumerate(b) if not free[j]))) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def winkler(a: str, b: str, weight: float = 0.1, boost_from: float = 0.7) -> float:
    """Jaro similarity raised by a common beginning of up to four characters."""
    s = jaro(a, b)
    if s <= boost_from:
        return s
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return s + same * weight * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity from 0 to 1, null if a side is null. Repeated pairs of a batch are worked out once."""
    known: dict = {}

    def one(x, y):
        if x is None or y is None:
            return None
        k = (x, y)
        if k not in known:
            known[k] = winkler(x, y)
        return known[k]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="object").astype("float64")


def level_exact(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), -1).when(a == b, 1).otherwise(0)


def level_edits(a: Column, b: Column, thresholds: tuple[int, ...]) -> Column:
    """-1 if a side is null, the highest level if equal, one less per threshold of edits, else 0."""
    top = len(thresholds) + 1
    out = F.when(a.isNull() | b.isNull(), -1).when(a == b, top)
    for i, t in enumerate(sorted(thresholds)):
        out = out.when(F.levenshtein(a, b, int(t)) >= 0, top - 1 - i)
    return out.otherwise(0)


def level_similarity(a: Column, b: Column, thresholds: tuple[float, ...]) -> Column:
    top = len(thresholds) + 1
    out = F.when(a.isNull() | b.isNull(), -1).when(a == b, top)
    for i, t in enumerate(sorted(thresholds, reverse=True)):
        out = out.when(jaro_winkler(a, b) >= t, top - 1 - i)
    return out.otherwise(0)
