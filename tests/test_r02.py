"""What the second round of review found."""

import pytest
from conftest import rows

from skein.plans import queries as core


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables of a test's own and gives their folder."""

    def write(**tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_snippets_where_a_query_has_no_term(spark, folder):
    d = folder(qa=([(0, "aaa 呕吐 bbb", ["呕吐"]), (20, "ccc", []), (40, "ddd", [None]), (60, "eee", None)], "qa_index long, answer string, question_fine_cut array<string>"))
    assert rows(core.QUERIES["q_snippets_of_search"](spark, d)) == [(0, 0, "aaa <em>呕吐</em> bbb")]


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("k", [1, 7])
def test_best_documents_are_those_of_all_pairs(spark, weighted, k):
    import random

    from pyspark.sql import functions as F

    from skein.operators import retrieve

    r = random.Random(5)
    data = [(i * 7 % 1009, [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice((2, 5, 26))]) for _ in range(r.randrange(8))] + r.choice(([], [" "], [None]))) for i in range(600)] + [(5000, None)]
    df = spark.createDataFrame(data, "id long, t array<string>").repartition(3)
    qs = df.where("id % 4 = 0")
    if weighted:
        everything = retrieve.bm25(df, "id", "t", qs, "id", "t", None)
    else:
        wanted = qs.select(F.col("id").alias("qid"), F.explode(F.array_distinct("t")).alias("term"))
        everything = retrieve.top(retrieve.postings(df, "id", "t").join(wanted, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).cast("double").alias("score")), None)
    cols = ["qid", "id", F.round("score", 8).alias("score"), "rank"]
    got = retrieve.top(retrieve.best(df, "id", "t", qs, "id", "t", k, weighted, block=50, most=100), k)
    assert rows(got.select(*cols)) == rows(everything.where(F.col("rank") <= k).select(*cols))


def test_limited_search_makes_no_pairs(spark):
    """Fails where every pair of query and document becomes a row: then the largest operator has 400 x 2,000 rows."""
    from skein.operators import retrieve

    df = spark.range(2000).selectExpr("id", "array('a', 'b', concat('c', id % 50)) as t")
    plan = retrieve.bm25(df, "id", "t", df.where("id % 5 = 0"), "id", "t", 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_two_fields_make_no_pairs(spark, folder):
    row = "qa_index long, question string, question_fine_cut array<string>, question_rough_cut array<string>"
    d = folder(qa=([(i, "x", ["a", f"b{i % 9}"], ["a", f"c{i % 7}"]) for i in range(60)], row))
    df = core.QUERIES["q_two_fields"](spark, d)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    got = rows(df)
    assert len(got) == 30 and all(sum(r[0] == q for r in got) == 10 for q in (0, 20, 40))


def test_modes_make_no_pairs(spark):
    from skein.operators import retrieve

    df = spark.createDataFrame([(i, "x", ["a", f"b{i % 9}"]) for i in range(60)], "id long, s string, t array<string>")
    got = retrieve.by_mode(df, "id", "s", "t", df.where("id % 20 = 0"), ("well", "part"))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert got.where("mode = 'part' and qid = 20").select("id", "score").orderBy("rank").limit(8).collect() == [(i, 2.0) for i in range(2, 60, 9)] + [(0, 1.0)]


def test_risks_of_many_diseases_equal_sparks_models(spark):
    from skein.operators import models

    data = [(str(i), float(i % 3), float(i % 7 == 0), f"d{(i * i + i // 5) % 4}" if i % 11 else None) for i in range(900)]
    f = spark.createDataFrame([r[:3] for r in data], "id string, a double, b double")
    v = spark.createDataFrame([(r[0], r[3]) for r in data], "id string, disease string")
    got = {(r[0], r[1]): r[2] for r in models.risks(f, v, "id", ["a", "b"], over=10, bound=2).collect()}  # more diseases than jobs are allowed
    by_spark = {(r[0], r[1]): r[2] for r in models.risks(f, v, "id", ["a", "b"], over=10, kinds=-1).collect()}
    assert got.keys() == by_spark.keys() and len(got) == 900 * len({r[3] for r in data if r[3]})
    assert max(abs(got[k] - by_spark[k]) for k in got) < 1e-4


def test_viterbi_words_broadcast_nothing(spark, sf):
    plan = core.QUERIES["q_viterbi_words"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
