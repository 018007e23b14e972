"""Word vectors joined to texts: pooling, weights of terms, similarities of pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.similarity import cosine
from skein.session import small


def looked_up(df: DataFrame, id: str, tokens: str, vectors: DataFrame, dimension: int) -> DataFrame:
    """(id, pos, word, known, vector): each token with its vector of (word, vector), zeros where it has none. A dictionary of checked size is broadcast."""
    words = df.where(F.col(tokens).isNotNull()).select(F.col(id).alias("id"), F.posexplode(tokens).alias("pos", "word")).where("word is not null and trim(word) <> ''")
    j = words.join(small(vectors.select("word", "vector"), 20_000), "word", "left")
    return j.select("id", "pos", "word", F.col("vector").isNotNull().alias("known"), F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(0.0), dimension)).alias("vector"))


def pooled(tokens: DataFrame, weight: Column | None = None) -> DataFrame:
    """(id, vector): of (id, vector, ...), the sum of the weighted vectors over the number of weights that aren't zero. Summed by position, with map-side combining."""
    w = F.lit(1.0) if weight is None else weight
    x = tokens.select("id", w.alias("w"), F.posexplode("vector").alias("i", "x"))
    by = x.groupBy("id", "i").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.count_if(F.col("w") != 0), F.lit(0))).alias("x"))
    return by.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def term_distances(tokens: DataFrame) -> DataFrame:
    """(id, word, weight): one minus the cosine of a word and the mean of its text; 1 for a text of one word, 0 for a word without a vector."""
    mean = pooled(tokens).withColumnRenamed("vector", "mean")
    n = tokens.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    j = tokens.select("id", "word", "known", "vector").dropDuplicates(["id", "word"]).join(mean, "id").join(n, "id")
    return j.select("id", "word", F.when(F.col("n") == 1, 1.0).when(~F.col("known"), 0.0).otherwise(1 - F.coalesce(cosine(F.col("vector"), F.col("mean")), F.lit(1.0))).alias("weight"))
