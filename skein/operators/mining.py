"""Mining of words and phrases: thresholds by order, filters of candidates, Bloom filters, back-off probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import small


def kept_grams(counted: DataFrame, least: dict[int, float]) -> DataFrame:
    """(gram, n, pmi): grams whose natural-log information, the least over their splits, reaches the threshold of their length; lengths without one are left out."""
    by_length = counted.withColumn("k", F.length("gram"))
    totals = by_length.groupBy("k").agg(F.sum("n").alias("total"))  # one row per length
    p = by_length.join(F.broadcast(totals), "k").select("gram", "n", "k", (F.col("n") / F.col("total")).alias("p"))
    splits = p.where(F.col("k").isin(list(least))).select("gram", "n", "k", "p", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i")).select("gram", "n", "k", "p", F.expr("substring(gram, 1, i)").alias("l"), F.expr("substring(gram, i + 1)").alias("r"))
    left, right = p.select(F.col("gram").alias("l"), F.col("p").alias("pl")), p.select(F.col("gram").alias("r"), F.col("p").alias("pr"))
    pmi = splits.join(left, "l").join(right, "r").groupBy("gram", "n", "k").agg(F.min(F.ln(F.col("p") / (F.col("pl") * F.col("pr")))).alias("pmi"))
    bound = F.coalesce(*[F.when(F.col("k") == k, F.lit(v)) for k, v in least.items()])
    return pmi.where(F.col("pmi") >= bound).select("gram", "n", "pmi")


def without_known_parts(grams: DataFrame, gram: str, words: DataFrame, word: str) -> DataFrame:
    """Candidates none of whose substrings of two or more characters is a dictionary word. Substrings are joined by equality."""
    subs = grams.select(F.col(gram), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length(gram)), lambda i: F.transform(F.sequence(F.lit(1), F.length(gram) - i + 1), lambda n: F.substring(F.col(gram), i, n))))).alias("_w")).where("length(_w) > 1")
    known = subs.join(small(words.select(F.col(word).alias("_w")).where("_w is not null").distinct()), "_w", "left_semi").select(gram).distinct()
    return grams.join(known, gram, "left_anti")


def phrases(df: DataFrame, tokens: str, words: DataFrame, word: str, least: int = 5, bad_ends: str = "的了吗呢是在和有也都就") -> DataFrame:
    """(phrase, n): neighbouring words that stand together at least ``least`` times: Chinese, more than one character each side together, no function word at an end, not in the dictionary."""
    w = F.filter(F.col(tokens), lambda t: t.isNotNull() & (F.trim(t) != ""))
    pairs = df.where(F.col(tokens).isNotNull()).select(w.alias("w")).where("size(w) > 1").select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, b))).alias("phrase"))
    n = pairs.where(F.col("phrase").rlike(r"^[\x{4e00}-\x{9fff}]{2,}$") & ~F.col("phrase").rlike(f"^[{bad_ends}]|[{bad_ends}]$")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.join(small(words.select(F.col(word).alias("phrase")).where("phrase is not null").distinct()), "phrase", "left_anti")


def backed_off(bigrams: DataFrame, pairs: DataFrame, weight: float = 0.4) -> DataFrame:
    """(w1, w2, n1, n12, p): of (w1, w2), the conditional probability of w2 after w1; unseen pairs back off to ``weight`` times w2's own share; frequencies of unseen words are 0."""
    ones = bigrams.groupBy(F.col("w2").alias("w")).agg(F.sum("n").alias("n"))
    total = ones.agg(F.sum("n").alias("total"))
    firsts = bigrams.groupBy("w1").agg(F.sum("n").alias("n1"))
    j = pairs.select("w1", "w2").distinct().join(bigrams, ["w1", "w2"], "left").join(firsts, "w1", "left").join(ones.select(F.col("w").alias("w2"), F.col("n").alias("n2")), "w2", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("w1", "w2", zero("n1").alias("n1"), zero("n").alias("n12"), F.when(zero("n") > 0, F.col("n") / F.col("n1")).otherwise(weight * zero("n2") / F.col("total")).alias("p"))


def _places(key: Column, bits: int, hashes: int) -> Column:
    """Bit numbers of a key by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(99))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.pmod(a, F.lit(bits)) + i * F.pmod(b, F.lit(bits)), F.lit(bits)))


def bloom_filter(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(bucket, bitmap): the filter as bitmaps of 32,768 bits each, or-ed on the map side."""
    at = df.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), bits, hashes)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def maybe_in(df: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """df with ``maybe``: False only for keys that aren't in the filter. Bit numbers meet the bitmaps by their bucket; the filter is broadcast below its checked size."""
    at = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().select("_k", F.explode(_places(F.col("_k"), bits, hashes)).alias("at")).withColumns({"bucket": F.bitmap_bucket_number("at"), "p": F.bitmap_bit_position("at")})
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("p") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, F.pmod("p", F.lit(8)).cast("int")), F.lit(0))
    found = at.join(small(bloom, 2_000), "bucket", "left").groupBy("_k").agg((F.min(hit) == 1).alias("maybe"))
    return df.join(found.withColumnRenamed("_k", key), key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
