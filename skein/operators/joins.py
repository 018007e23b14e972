"""Joins on closeness that become equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_edits(df: DataFrame, column: str, k: int) -> DataFrame:
    """(a, b, distance): pairs a < b of distinct strings with at most k edits.

    Of k + 1 pieces into which the shorter string is cut, one survives k edits unchanged, moved by at most k places. So each
    string's pieces are joined by equality with the substrings of that length and about that place of strings up to k longer;
    strings too short to be cut into k + 1 pieces meet by length alone, of which there are few.
    """
    s = F.col("s")
    base = df.select(F.col(column).alias("s")).where("s is not null").distinct().withColumn("n", F.length("s"))
    piece = F.floor(F.col("n") / (k + 1)).cast("int")
    cut = base.where(F.col("n") > k).select(
        F.col("s").alias("x"), F.col("n").alias("nx"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), F.substring(s, (i * piece + 1).cast("int"), piece).alias("p")))))
    # what a string offers to strings m = 0..k shorter: substrings as long as their pieces, near the pieces' places
    offers = base.select("s", "n", F.explode(F.sequence(F.greatest(F.col("n") - k, F.lit(k + 1)), F.greatest(F.col("n"), F.lit(k + 1)))).alias("m")).where("m <= n")
    offers = offers.withColumn("piece", F.floor(F.col("m") / (k + 1)).cast("int")).select("s", "n", "m", "piece", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i"))
    offers = offers.select(F.col("s").alias("y"), F.col("m").alias("nx"), "i", "piece", F.explode(F.sequence(F.greatest(F.col("i") * F.col("piece") - k, F.lit(0)), F.col("i") * F.col("piece") + k)).alias("at"), "n")
    offers = offers.where("at + piece <= n").select("y", "nx", "i", F.substring("y", (F.col("at") + 1).cast("int"), F.col("piece")).alias("p")).distinct()
    met = cut.join(offers, ["nx", "i", "p"]).where("x <> y").select("x", "y")
    tiny = base.where(F.col("n") <= k)
    met = met.unionByName(tiny.select(F.col("s").alias("x"), F.col("n").alias("nx")).join(base.where(F.col("n") <= 2 * k).select(F.col("s").alias("y"), F.col("n").alias("ny")), F.col("ny").between(F.col("nx"), F.col("nx") + k)).where("x <> y").select("x", "y"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", k)).where("distance >= 0")


def sharing(df: DataFrame, column: str, least: float) -> DataFrame:
    """(a, b): pairs a < b of distinct strings whose sets of characters have a Jaccard similarity of at least ``least`` > 0, and perhaps some more.

    Sets this similar share one of the rarest n - least * n + 1 of their n characters, so only those are joined by equality,
    and their sizes differ by at most that factor. Nulls and empty strings have no partner.
    """
    base = df.select(F.col(column).alias("s")).where("s is not null").distinct()
    chars = base.select("s", F.explode(F.array_distinct(F.filter(F.split("s", ""), lambda c: c != ""))).alias("c"))
    ranked = chars.join(chars.groupBy("c").agg(F.count(F.lit(1)).alias("f")), "c").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("r")).withColumn("n", F.size("r"))
    rare = ranked.select("s", "n", F.explode(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("r")).select("s", "n", F.col("r.c").alias("c"))
    met = rare.select(F.col("s").alias("a"), F.col("n").alias("na"), "c").join(rare.select(F.col("s").alias("b"), F.col("n").alias("nb"), "c"), "c").where("a < b")
    return met.where((F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)).select("a", "b").distinct()
