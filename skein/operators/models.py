"""Trained models with Spark's own library: classifiers on features and text, word vectors, principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.session import cut


def text_classifier(df: DataFrame, id: str, text: str, label: str, seed: int = 18) -> DataFrame:
    """(id, label, prediction): logistic regression on hashed words, trained on a hashed three quarters."""
    rows = df.where(f"{text} is not null and {label} is not null").select(id, tokens(F.col(text)).alias("words"), F.col(label).cast("double").alias("label"))
    train = rows.where(F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(4)) > 0)
    model = Pipeline(stages=[HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 14), LogisticRegression(maxIter=10, regParam=0.01)]).fit(train)
    return model.transform(rows).select(id, "label", "prediction")


def tree_classifier(df: DataFrame, id: str, features: list[str], label: str, kind: str = "forest", seed: int = 18) -> DataFrame:
    """(id, label, prediction) by a random forest or gradient-boosted trees."""
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.withColumn("label", F.col(label).cast("double")).select(id, "label", *features).fillna(0, features))
    model = (RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed) if kind == "forest" else GBTClassifier(maxIter=10, maxDepth=4, seed=seed)).fit(rows)
    return model.transform(rows).select(id, "label", "prediction")


def word_vectors(df: DataFrame, words: str, size: int = 32, least: int = 5, seed: int = 18) -> DataFrame:
    """(word, vector)."""
    model = Word2Vec(vectorSize=size, minCount=least, windowSize=5, seed=seed, inputCol="w", outputCol="v", maxIter=1).fit(df.where(F.col(words).isNotNull()).select(F.filter(words, lambda t: t.isNotNull()).alias("w")))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def without_first_component(df: DataFrame, id: str, vector: str, faithful: bool = False) -> DataFrame:
    """(id, vector) less the projection on the first principal component; ``faithful`` multiplies by its squared entries instead."""
    rows = df.select(id, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    u = [float(x) for x in PCA(k=1, inputCol="v", outputCol="p").fit(rows).pc.toArray()[:, 0]]
    a, c = F.col(vector).cast("array<double>"), F.array(*map(F.lit, u))
    if faithful:
        return df.select(id, F.zip_with(a, c, lambda x, y: x - x * y * y).alias("vector"))
    along = F.aggregate(F.zip_with(a, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.select(id, a.alias("a"), along.alias("along")).select(id, F.zip_with("a", c, lambda x, y: x - F.col("along") * y).alias("vector"))


def diagnosis_forest(df: DataFrame, id: str, text: str, disease: str, symptoms: DataFrame, symptom: str, seed: int = 18) -> DataFrame:
    """(id, disease, prediction): a forest on which symptoms a text names, trained on a hashed three quarters, for all rows.

    The features are the symptoms in order of name; their number is that of the dictionary, which is collected (checked: up to 2,000).
    """
    names = [r[0] for r in symptoms.select(symptom).where(F.col(symptom).isNotNull()).distinct().orderBy(symptom).limit(2001).collect()]
    if len(names) > 2000:
        raise ValueError("more than 2,000 symptoms; choose a subset of the dictionary")
    has = F.array(*[F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(n)).cast("double") for n in names])
    rows = df.select(F.col(id).alias("id"), F.col(disease).alias("disease"), array_to_vector(has).alias("features"))
    index = StringIndexer(inputCol="disease", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    rows = index.transform(rows)
    model = RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed).fit(rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)) > 0))
    names_of = F.array(*map(F.lit, index.labels))
    return model.transform(rows).select("id", "disease", F.element_at(names_of, (F.col("prediction") + 1).cast("int")).alias("prediction"))


def classification_metrics(df: DataFrame, label: str, prediction: str, classes: list[int]) -> DataFrame:
    """One row: accuracy, macro precision and recall, F1 weighted by the classes' sizes. One pass with map-side combining; a class never predicted or never present counts 0."""
    n = lambda c: F.count_if(c).cast("double")
    y, p = F.col(label), F.col(prediction)
    parts = df.agg(*[x for k in classes for x in (n((y == k) & (p == k)).alias(f"t{k}"), n(p == k).alias(f"p{k}"), n(y == k).alias(f"y{k}"))])
    pr, re = ([F.coalesce(F.try_divide(F.col(f"t{k}"), F.col(f"{x}{k}")), F.lit(0.0)) for k in classes] for x in "py")
    f1 = [F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0)) for a, b in zip(pr, re, strict=True)]
    total = lambda c: sum((F.col(f"{c}{k}") for k in classes), F.lit(0.0))
    weighted = sum((F.col(f"y{k}") * f for k, f in zip(classes, f1, strict=True)), F.lit(0.0))
    values = {"accuracy": F.try_divide(total("t"), total("y")), "precision": sum(pr, F.lit(0.0)) / len(classes), "recall": sum(re, F.lit(0.0)) / len(classes), "weighted_f1": F.try_divide(weighted, total("y"))}
    return parts.select(*[F.round(v, 6).alias(k) for k, v in values.items()])


def _ridge(x: np.ndarray, n: np.ndarray, pos: np.ndarray, reg: float) -> np.ndarray:
    """Probability of each row of x, of which ``n`` copies exist and ``pos`` of them are positive, by the logistic model of least loss: ``reg`` / 2 times the squares of the coefficients of the standardised columns is added to the mean loss, the intercept is free."""
    total = n.sum()
    if pos.sum() in (0, total):
        return np.full(len(x), float(pos.sum() > 0))
    mean = (n @ x) / total
    std = np.sqrt(n @ (x - mean) ** 2 / max(total - 1, 1))
    z = np.hstack([np.where(std > 0, (x - mean) / np.where(std > 0, std, 1), 0), np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], reg), 0.0)
    b = np.append(np.zeros(x.shape[1]), np.log(pos.sum() / (total - pos.sum())))
    loss = lambda b: (n * np.logaddexp(0, z @ b) - pos * (z @ b)).sum() / total + (ridge * b * b).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ b)))
        grad = z.T @ (n * p - pos) / total + ridge * b
        if np.abs(grad).max() < 1e-12:
            break
        step = np.linalg.lstsq((z.T * (n * p * (1 - p))) @ z / total + np.diag(ridge), grad, rcond=None)[0]
        t, was = 1.0, loss(b)
        while t > 1e-6 and loss(b - t * step) > was + 1e-15:
            t /= 2
        b = b - t * step
    return 1 / (1 + np.exp(-(z @ b)))


def risks(features: DataFrame, diagnoses: DataFrame, id: str, columns: list[str], over: int = 100, bound: int = 500, kinds: int = 5000, places: int = 6) -> DataFrame:
    """(id, disease, risk rounded): for every disease with more than ``over`` rows one logistic model on the features, applied to all rows. Each is a model of its own.

    Where the features have at most ``kinds`` different rows, these are counted once for all diseases and every model is fitted
    to the counts, to its optimum; the result is one join. Else each model is fitted by Spark, in twenty steps over all rows,
    and more than ``bound`` of them are an error.
    """
    joined = features.join(diagnoses, id, "left").select(id, *columns, "disease")
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    found = features.select(*columns).distinct().select(*columns, valid.alias("valid")).limit(kinds + 1).collect()
    counts = 0 < len(found) <= kinds and all(r["valid"] for r in found)
    bound = 5_000_000 // len(found) if counts else bound
    common = [r["disease"] for r in diagnoses.where("disease is not null").groupBy("disease").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over).orderBy("disease").limit(bound + 1).collect()]
    if len(common) > bound:
        raise ValueError(f"more than {bound} diseases have over {over} rows; raise the bound or the gate")
    if common and counts:
        spark = features.sparkSession
        of = {tuple(r[c] for c in columns): i for i, r in enumerate(found)}
        n, pos = np.zeros(len(of)), {d: np.zeros(len(of)) for d in common}
        counted = joined.groupBy(*columns, F.when(F.col("disease").isin(common), F.col("disease")).alias("disease")).agg(F.count(F.lit(1)).alias("n"))
        for r in counted.toLocalIterator():
            i = of[tuple(r[c] for c in columns)]
            n[i] += r["n"]
            if r["disease"] is not None:
                pos[r["disease"]][i] += r["n"]
        x = np.array(list(of), dtype=np.float64).reshape(len(of), len(columns))
        p = np.array([_ridge(x, n, pos[d], 0.01) for d in common])
        names = [f"_{i}" for i in range(len(columns))]
        kinds_of = ", ".join(f"{a} {features.schema[c].dataType.simpleString()}" for a, c in zip(names, columns, strict=True))
        table = spark.createDataFrame([(*k, [float(v) for v in p[:, i]]) for k, i in of.items()], f"{kinds_of}, r array<double>")
        on = None
        for a, c in zip(names, columns, strict=True):
            on = (F.col(a) == F.col(c)) if on is None else on & (F.col(a) == F.col(c))
        every = F.arrays_zip(F.array(*[F.lit(d) for d in common]).alias("disease"), F.transform("r", lambda v: F.round(v, places)).alias("risk"))
        return joined.select(id, *columns).join(F.broadcast(cut(table.select(*names, every.alias("every")))), on).select(id, F.inline("every"))
    rows = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(joined)
    out = None
    for d in common:
        mine = rows.withColumn("label", F.coalesce((F.col("disease") == d).cast("double"), F.lit(0.0)))
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(mine)
        part = model.transform(mine).select(id, F.lit(d).alias("disease"), F.round(F.element_at(vector_to_array("probability"), 2), places).alias("risk"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(id, F.col("disease"), F.lit(0.0).alias("risk")).limit(0)
