"""Visually identical text with different characters: script-aware repair.

The dominant script of each token decides; look-alike letters are replaced only in mixed-script tokens (and in tokens made
only of look-alikes, in a text without any other word of that script) and only when the result exists in the vocabulary of
the corpus. Width, composition, invisible characters, spaces, imitated ideographs and styled letters need no vocabulary.

Only texts that hold a suspicious character reach Python; the test for that runs in the JVM.

Edge cases: null text -> no row in ``repair`` (nothing to change); empty text -> unchanged; a joiner next to an emoji stays;
very long texts take one pass; repeated rows are repaired alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import chars
from skein.session import cut, ship, small

_WORD = "[a-z\\u00c0-\\u024f]+|[\\u0430-\\u045f]+|[\\u03b1-\\u03c9]+"


def texts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, text), one row per non-null text."""
    return df.select(F.col(key).alias("key"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns]))).where("text is not null")


def _first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        done = [chars.certain(t) for t in pdf["text"]]
        pairs = [chars.lookalikes(t) for t, _ in done]
        yield pd.DataFrame({
            "key": pdf["key"], "field": pdf["field"], "fixed": [t for t, _ in done], "hit": [h for _, h in done],
            "pairs": [[{"token": a, "to": b} for a, b in p] for p in pairs],
        })


def _second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        fixed, hit = [], []
        for t, h, pairs, known in zip(pdf["fixed"], pdf["hit"], pdf["pairs"], pdf["known"], strict=True):
            known = set(known if known is not None else ())
            ok = {p["token"]: p["to"] for p in (pairs if pairs is not None else ()) if p["to"].lower() in known}
            fixed.append(chars.substitute(t, ok))
            hit.append(bool(h or ok))
        yield pd.DataFrame({"key": pdf["key"], "field": pdf["field"], "fixed": fixed, "hit": hit})


def repair(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, fixed, hit): the texts that hold a suspicious character, in their consistent form; hit says whether anything had to be changed."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = texts(df, key, columns)
    first = rows.where(F.col("text").rlike(chars.SUSPICIOUS)).mapInPandas(_first, f"key {kind}, field string, fixed string, hit boolean, pairs array<struct<token:string,to:string>>")
    first = cut(first)
    wanted = first.select("key", "field", F.explode("pairs").alias("p")).select("key", "field", F.lower("p.to").alias("word"))
    # the vocabulary is asked only for the words wanted, so what is shuffled follows their number, not the corpus
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("word"))
    vocabulary = words.join(small(wanted.select("word").distinct()), "word", "left_semi").distinct()
    known = wanted.join(vocabulary, "word").groupBy("key", "field").agg(F.collect_set("word").alias("known"))
    return first.join(known, ["key", "field"], "left").mapInPandas(_second, f"key {kind}, field string, fixed string, hit boolean")


def fixed_column(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns folded to their consistent form for comparisons; only texts with suspicious characters are folded in Python."""
    ship(df.sparkSession)
    suspicious = {f"_odd_{i}": F.coalesce(F.col(c).rlike(chars.SUSPICIOUS), F.lit(False)) for i, c in enumerate(columns)}

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(chars.folded, na_action="ignore")

    # texts without a suspicious character go to Python as nulls, so every text is tested once and few are moved
    odd = df.withColumns(suspicious).withColumns({f"_new_{i}": fold(F.when(F.col(f"_odd_{i}"), F.col(c))) for i, c in enumerate(columns)})
    return odd.withColumns({c: F.when(F.col(f"_odd_{i}"), F.col(f"_new_{i}")).otherwise(F.col(c)) for i, c in enumerate(columns)}).drop(*suspicious, *[f"_new_{i}" for i in range(len(columns))])
