"""Tabular features: cleaned numbers, ages, flags, limits, one-hot blocks, cohorts, samples, rule-filtered scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import small

#: First-tier and second-tier towns of the synthetic tables.
BIG_TOWNS, SECOND_TOWNS = ["青岬", "丹墀"], ["望溪", "云栈", "石漪"]


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.S"))


def elapsed_days(begin: Column, end: Column, most: int = 18_000) -> Column:
    """Whole elapsed days, rounded down; unknown, or more than ``most``, is 0."""
    days = F.floor((F.unix_timestamp(end) - F.unix_timestamp(begin)) / 86_400)
    return F.when(days.isNull() | (days > most), F.lit(0)).otherwise(days).cast("long")


def vital(c: Column, average: float, faithful: bool = False) -> Column:
    """A vital sign as a number. Chinese characters and signs are stripped; nothing readable gives the average, one character 0.1; of two decimal points only the whole part is kept.

    ``faithful`` also strips the decimal point, as a range in the original's character class does.
    """
    s = F.regexp_replace(c, r"[\x{4e00}-\x{9fff}]", "")
    s = F.regexp_replace(s, r"[^0-9]" if faithful else r"[^0-9.]", "")
    s = F.when(s.rlike(r"\..*\."), F.regexp_extract(s, r"^([0-9]*)", 1)).otherwise(s)
    return F.when(c.isNull() | (c == "nan") | (F.trim(c) == ""), F.lit(average)).when(F.length(s) <= 1, F.lit(0.1)).otherwise(F.coalesce(s.try_cast("double"), F.lit(average)))


def limits(breeds: DataFrame) -> DataFrame:
    """(name, low, high): numeric weight limits over both sexes; a single number is both ends."""
    part = lambda c, i: F.try_element_at(F.split(c, r"\|"), F.lit(i)).try_cast("double")
    ends = [F.coalesce(part(c, i), part(c, 1)) for c in ("male_weight", "female_weight") for i in (1, 2)]
    return breeds.select("name", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))


def weight_class(weight: Column, low: Column, high: Column) -> Column:
    """0 within the limits, 1 below, 2 unknown, 3 above."""
    return F.when(weight.isNull() | low.isNull(), 2).when(weight < low, 1).when(weight > high, 3).otherwise(0)


def town_class(c: Column) -> Column:
    name = F.replace(c, F.lit("市"), F.lit(""))
    return F.when(name.isin(BIG_TOWNS), 1).when(name.isin(SECOND_TOWNS), 2).otherwise(3)


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """One 0/1 column per stated value: the training schema is fixed, so values missing in the data give zeros and no distinct scan is needed."""
    return df.withColumns({f"{prefix}_{i}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for i, v in enumerate(values)})


def cohort(visits: DataFrame, pet: str, symptom: str, disease: str) -> DataFrame:
    """(pet, label): pets that ever had the disease are positive; the others with any diagnosis negative. A semi and an anti join by pet."""
    ever = visits.where(F.coalesce(F.col(symptom).contains(disease), F.lit(False))).select(pet).where(f"{pet} is not null").distinct()
    others = visits.where(F.col(symptom).isNotNull()).select(pet).where(f"{pet} is not null").distinct().join(ever, pet, "left_anti")
    return ever.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))


def balance(df: DataFrame, label: str, id: str, seed: int = 7) -> DataFrame:
    """As many negatives as positives, chosen by hash; the threshold of the hash comes from two counts, so nothing is sorted globally."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = n.agg(F.max(F.when(F.col(label) == 1, F.col("n"))).alias("p"), F.max(F.when(F.col(label) == 0, F.col("n"))).alias("q")).select(F.least(F.lit(1.0), F.col("p") / F.col("q")).alias("share"))
    u = (F.xxhash64(F.col(id), F.lit(seed)) / F.lit(2.0**64)) + 0.5
    return df.join(F.broadcast(share)).where((F.col(label) == 1) | (u < F.col("share"))).drop("share")


def draw_with_replacement(df: DataFrame, id: str, n: int, seed: int = 7) -> DataFrame:
    """n draws with replacement: draw numbers are hashed onto dense row numbers and joined by equality."""
    from skein.operators.windows import dense_ids

    rows = dense_ids(df, [F.asc(id)], "_place")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    draws = df.sparkSession.range(n).join(F.broadcast(total)).where("_n > 0").select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_n")).alias("_place"))
    return draws.join(rows, "_place").drop("_place")


def multi_hot(df: DataFrame, row: str, column: str, value: str, columns: DataFrame) -> DataFrame:
    """(row, weights): one array per row with the largest value of each of the stated columns in order of name, 0 where there is none.

    The columns are a dictionary: their names come to every row in one broadcast array.
    """
    names = columns.select(F.col(column).alias("c")).where("c is not null").distinct().agg(F.array_sort(F.collect_list("c")).alias("_names"))
    mine = df.groupBy(row, column).agg(F.max(value).alias("v")).groupBy(row).agg(F.map_from_entries(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(column), F.col("v"))))).alias("_m"))
    return mine.join(F.broadcast(names)).select(row, F.transform("_names", lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0))).alias("weights"))


def rescaled(c: Column, mean: float, threshold: float) -> Column:
    """A vital sign as a number; one above the threshold was typed without its decimal point and is divided by ten."""
    v = vital(c, mean)
    return F.when(v > threshold, v / 10).otherwise(v)


def age_class(months: Column) -> Column:
    """1 young (up to 12 months), 2 grown, 3 old (over 96); null where unknown."""
    return F.when(months.isNull(), None).when(months > 96, 3).when(months > 12, 2).otherwise(1)


def sex_class(c: Column) -> Column:
    return F.when(c.isin("公", "雄", "M"), 1).when(c.isin("母", "雌", "F"), 2)


def kind_class(c: Column) -> Column:
    """1 dog, 2 cat; null for anything else."""
    return F.when(c.rlike("犬|DOG"), 1).when(c.rlike("猫|CAT"), 2)


def attributes(visits: DataFrame, disease: str, parts: dict[str, Column], least: float = 0.9) -> DataFrame:
    """(disease, *parts): for each part the one class that holds at least ``least`` of the disease's visits with a known class, else null. Counted with map-side combining."""
    out = None
    for name, c in parts.items():
        n = visits.where(F.col(disease).isNotNull()).select(F.col(disease).alias("disease"), c.alias("v")).where("v is not null").groupBy("disease", "v").agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("disease").agg(F.max_by("v", F.struct("n", F.negative("v"))).alias("v"), (F.max("n") / F.sum("n")).alias("share")).select("disease", F.when(F.col("share") >= least, F.col("v")).alias(name))
        out = top if out is None else out.join(top, "disease", "full_outer")
    return out


def diagnose_filtered(relation: DataFrame, requests: DataFrame, attributes: DataFrame, given: DataFrame, parts: list[str], k: int = 5) -> DataFrame:
    """(request, disease, probability, rank): as ``diagnose``, but a disease one of whose known attributes differs from the request's known one gets no probability.

    ``given`` has one row per request with its attributes; diseases without attributes pass. Requests all of whose diseases are ruled out have no rows.
    """
    scored = diagnosis_scores(relation, requests).join(small(attributes), "disease", "left").join(given.select("request", *[F.col(p).alias(f"_{p}") for p in parts]), "request", "left")
    for p in parts:
        scored = scored.where(F.col(p).isNull() | F.col(f"_{p}").isNull() | (F.col(p) == F.col(f"_{p}")))
    return ranked_diseases(scored.select("request", "disease", "score"), k)


def diagnosis_scores(relation: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, disease, score): the product of the weights of the symptoms asked about, as exp of a sum of logs."""
    r = relation.where("disease is not null and symptom is not null and weight > 0").groupBy("disease", "symptom").agg(F.max("weight").alias("weight"))
    return requests.distinct().join(small(r), "symptom").groupBy("request", "disease").agg(F.exp(F.sum(F.ln("weight"))).alias("score"))


def ranked_diseases(scored: DataFrame, k: int = 5) -> DataFrame:
    from pyspark.sql.window import Window as W

    p = scored.withColumn("probability", F.try_divide("score", F.sum("score").over(W.partitionBy("request"))))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("request").orderBy(F.desc(F.round("probability", 9)), "disease"))).where(F.col("rank") <= k).select("request", "disease", "probability", "rank")


def diagnose(relation: DataFrame, requests: DataFrame, k: int = 5) -> DataFrame:
    """(request, disease, probability, rank) for (request, symptom) rows: scores divided by the request's sum, the best ``k``."""
    return ranked_diseases(diagnosis_scores(relation, requests), k)
