"""String and vector similarity columns; pandas UDFs only where dynamic programming needs them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters; null for two empty strings."""
    x, y = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.array_distinct(F.filter(F.split(b, ""), lambda c: c != ""))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def quick_ratio(a: Column, b: Column) -> Column:
    """2 x common characters, counted with their repetitions, / length of both."""
    x, y = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    common = F.aggregate(F.transform(F.array_distinct(x), lambda c: F.least(F.size(F.filter(x, lambda d: d == c)), F.size(F.filter(y, lambda d: d == c)))), F.lit(0), lambda s, n: s + n)
    return F.try_divide(common * 2.0, F.length(a) + F.length(b))


def _lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    y = np.array(list(b))
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for ch in a:
        take = row[:-1] + (y == ch)
        row[1:] = np.maximum.accumulate(np.maximum(take, row[1:]))
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; null if either is null."""
    return pd.Series([None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring."""

    def one(x: str, y: str) -> int:
        best, row, v = 0, np.zeros(len(y) + 1, dtype=np.int32), np.array(list(y))
        for ch in x:
            new = np.zeros_like(row)
            if len(y):
                new[1:] = np.where(v == ch, row[:-1] + 1, 0)
                best = max(best, int(new.max()))
            row = new
        return best

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_ratio(a: Column, b: Column) -> Column:
    """Similarity with substitutions of cost 2: twice the common subsequence / length of both."""
    return F.try_divide(2.0 * common_subsequence(a, b), F.length(a) + F.length(b))


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        reach = max(max(len(x), len(y)) // 2 - 1, 0)
        used, left = [False] * len(y), []
        for i, ch in enumerate(x):
            for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if not used[j] and y[j] == ch:
                    used[j] = True
                    left.append(ch)
                    break
        right = [ch for ch, u in zip(y, used, strict=True) if u]
        m = len(left)
        if not m:
            return 0.0
        jaro = (m / len(x) + m / len(y) + (m - sum(p != q for p, q in zip(left, right, strict=True)) / 2) / m) / 3
        prefix = next((i for i, (p, q) in enumerate(zip(x[:4], y[:4], strict=False)) if p != q), min(4, len(x), len(y)))
        return jaro + prefix * 0.1 * (1 - jaro)

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarities of two strings by name; ``register`` adds more.
LEXICAL: dict[str, Callable[[Column, Column], Column]] = {
    "jaccard": jaccard, "quick": quick_ratio, "edit": edit_ratio, "jaro_winkler": jaro_winkler, "substring": lambda a, b: F.try_divide(common_substring(a, b), F.greatest(F.length(a), F.length(b))),
    "levenshtein": lambda a, b: 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))),
}


def register(name: str, f: Callable[[Column, Column], Column]) -> None:
    """Adds a named similarity; a taken name is an error."""
    if name in LEXICAL:
        raise ValueError(f"{name} is taken")
    LEXICAL[name] = f


def lexical(name: str, a: Column, b: Column) -> Column:
    if name not in LEXICAL:
        raise ValueError(f"no similarity {name}; there are {', '.join(sorted(LEXICAL))}")
    return LEXICAL[name](a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def triangle_sector(a: Column, b: Column) -> Column:
    """Triangle area x sector area of two vectors, with the angle in degrees plus ten."""
    theta = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))) + 10
    triangle = norm(a) * norm(b) * F.sin(F.radians(theta)) / 2
    reach = euclidean(a, b) + F.abs(norm(a) - norm(b))
    return triangle * F.lit(np.pi) * reach * reach * theta / 360


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("score", T.DoubleType())])))
def fuzzy_places(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Where a pattern stands in a text with at most a third of its characters different; every place is tried."""

    def one(t: str, p: str) -> list[dict]:
        k, v, w = len(p), np.array(list(t)), np.array(list(p))
        if not k or len(t) < k:
            return []
        same = np.lib.stride_tricks.sliding_window_view(v, k) == w
        score = same.mean(axis=1)
        return [{"begin": int(i), "score": float(score[i])} for i in np.flatnonzero(score > 2 / 3)]

    return pd.Series([None if t is None or p is None else one(t, p) for t, p in zip(text, pattern, strict=True)])
