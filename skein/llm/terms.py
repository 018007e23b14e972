"""How distinctive a term is per record: graph-of-words weighting.

Per record, terms within ``window`` places of each other are linked; a term's degree is the number of distinct other terms
it is linked with. The score is degree x ln(records / records that hold the term), so a term common to all counts nothing
and a rare, well connected one much. Each column is a collection by itself.

A record's graph is built from its own array in the JVM; only (record, term) and (term, count) rows are shuffled. Arrays of
more than ``LONG`` terms are exploded instead of being scanned once per distinct term. Terms that very many records hold
are joined by broadcast.

Edge cases: null arrays, and null or blank terms, hold nothing; terms are compared as written; a record of one term has
degree 0; repeated ids give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import lookup, small

WINDOW, LONG = 3, 400


def record_terms(df: DataFrame, id: str, columns: list[str], window: int = WINDOW, long: int = LONG) -> DataFrame:
    """(id, field, term, tf, degree): the distinct terms of each record."""
    words = lambda c: F.filter(F.col(c), lambda x: x.isNotNull() & (F.trim(x) != ""))
    rows = df.select(F.col(id).alias("id"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), words(c).alias("a")) for c in columns]))).where("size(a) > 0")
    near = lambda a, i: F.slice(a, F.greatest(i - window, F.lit(1)), F.least(i, F.lit(window + 1)) + window)
    n = F.size("a")

    def of(t):
        at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("a", i) == t)
        around = F.array_distinct(F.flatten(F.transform(at, lambda i: near(F.col("a"), i))))
        return F.struct(t.alias("term"), F.size(at).alias("tf"), (F.size(around) - 1).alias("degree"))

    short = rows.where(n <= long).select("id", "field", F.inline(F.transform(F.array_distinct("a"), of)))
    spread = rows.where(n > long).withColumn("row", F.monotonically_increasing_id()).select("id", "field", "row", "a", F.posexplode("a").alias("i", "term"))
    pairs = spread.select("id", "field", "row", "term", "i", F.explode(near(F.col("a"), F.col("i") + 1)).alias("other"))
    big = pairs.groupBy("id", "field", "row", "term").agg(F.count_distinct("i").cast("int").alias("tf"), (F.count_distinct("other") - 1).cast("int").alias("degree")).drop("row")
    return short.unionByName(big)


def scores(df: DataFrame, id: str, columns: list[str], window: int = WINDOW, least_tf: int = 1) -> DataFrame:
    """(id, field, term, tf, df, score) of the terms that stand at least ``least_tf`` times in their record's list."""
    words = lambda c: F.array_distinct(F.filter(F.col(c), lambda x: x.isNotNull() & (F.trim(x) != "")))
    held = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), words(c).alias("a")) for c in columns]))).select("field", F.explode("a").alias("term"))
    counts = held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    totals = df.agg(F.count(F.lit(1)).alias("records"))
    terms = record_terms(df, id, columns, window).where(F.col("tf") >= least_tf)
    return lookup(terms, counts, ["field", "term"], "df").join(small(totals), how="cross").select("id", "field", "term", "tf", "df", F.round(F.col("degree") * F.ln(F.col("records") / F.col("df")), 6).alias("score"))
