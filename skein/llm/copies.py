"""Duplicates hidden by formatting differences: canonical form, 128-bit hash, counts with map-side combining.

Rows are aggregated by two independent 64-bit hashes of the canonical form; a third hash and the length in the key are the
collision check: forms that share 128 bits but differ there stay apart. The aggregation buffers hold numbers only, so the
map side combines in place. Keys of very many copies are joined back by broadcast, the others by shuffle.

Edge cases: a null text (all of several columns null) is no record; texts of only white space and punctuation are one group; repeated ids count once each
as rows but give distinct pairs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.normal import fixed_column
from skein.session import lookup

KEY = ["h1", "h2", "check"]


def canonical(c: Column) -> Column:
    """Lower case without white space, punctuation, signs and control characters."""
    return F.regexp_replace(F.lower(c), r"[\p{P}\p{Sm}\p{Sk}\p{Z}\p{C}]+", "")


def keyed(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the key of each record. Of several columns the order doesn't count: their canonical forms are sorted."""
    have = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    df = df.where(have).select(*keep, *[F.col(c).alias(f"_text{i}") for i, c in enumerate(columns)])
    for i in range(len(columns)):
        df = fixed_column(df, f"_text{i}")
    forms = [F.coalesce(canonical(F.col(f"_text{i}")), F.lit("")) for i in range(len(columns))]
    form = forms[0] if len(forms) == 1 else F.array_join(F.array_sort(F.array(*forms)), "\x01")
    df = df.withColumn("_form", form)
    check = F.hash("_form").cast("long") * 1_000_003 + F.length("_form")
    return df.select(*keep, F.xxhash64("_form").alias("h1"), F.xxhash64(F.reverse("_form"), F.lit(17)).alias("h2"), check.alias("check"))


def groups(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(h1, h2, check, first, copies): one row per distinct record with its smallest id and the number of its rows."""
    return keyed(df, columns, [id]).groupBy(*KEY).agg(F.min(id).alias("first"), F.count(F.lit(1)).alias("copies"))


def copies(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(first, copy): each further id of a group with the group's smallest id."""
    several = groups(df, id, columns).where("copies > 1")
    return lookup(keyed(df, columns, [id]), several, KEY, "copies").where(F.col(id) != F.col("first")).select("first", F.col(id).alias("copy")).distinct()
