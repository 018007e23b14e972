"""Small literal cases for text, similarity, features, joins, windows and graphs."""

import itertools

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.operators import counts, graph, joins, retrieve, tagging, windows
from skein.operators import features as ft
from skein.session import lookup, small


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).head()[0]


def test_clean_and_width(spark):
    assert one(spark, "ＡＢＣ１２３，。", tx.half_width) == "ABC123,。"
    assert one(spark, "我家猫拉稀了， 怎么办", tx.clean) == "我家猫拉稀了怎么办"
    assert one(spark, "狗（哈士奇（二哈））发烧(急)", tx.without_brackets) == "狗发烧"
    assert one(spark, "好。行！吗？对", tx.sentences) == ["好。", "行！", "吗？", "对"]
    assert one(spark, None, tx.clean) is None


def test_nonsense(spark):
    assert [one(spark, s, tx.nonsense) for s in ("", "abc123", "哈哈", "?!", "猫发烧")] == [True, True, True, True, False]


def test_numerals():
    assert [tx.numerals(n) for n in (0, 10, 15, 20, 105, 1010, 10000, 20050, 123456)] == ["零", "十", "十五", "二十", "一百零五", "一千零一十", "一万", "二万零五十", "十二万三千四百五十六"]


def test_segment(spark):
    words = spark.createDataFrame([("哈士奇",), ("细小病毒",), ("病毒",), (None,)], "w string")
    df = spark.createDataFrame([("哈士奇得细小病毒abc 12",), (None,), ("",)], "s string")
    assert [r[0] for r in tx.segment(df, "s", words, "w").select("tokens").collect()] == [["哈士奇", "得", "细小病毒", "abc", "12"], None, []]


def test_edit_measures(spark):
    df = spark.createDataFrame([("哈士奇", "哈士骑"), ("kitten", "sitting"), ("abc", "acb"), ("", ""), (None, "a")], "a string, b string")
    got = df.select(sim.common_subsequence("a", "b"), F.round(sim.edit_ratio(F.col("a"), F.col("b")), 3)).collect()
    assert [tuple(r) for r in got] == [(2, 0.667), (4, 0.615), (2, 0.667), (0, None), (None, None)]
    assert df.limit(1).select(F.round(sim.jaccard(F.col("a"), F.col("b")), 3)).head()[0] == 0.5
    assert spark.createDataFrame([("martha", "marhta")], "a string, b string").select(F.round(sim.jaro_winkler("a", "b"), 4)).head()[0] == 0.9611


def test_hamming(spark):
    got = spark.createDataFrame([(x,) for x in (0, 8, 10, 12, 14, 15)], "x int").select(F.bit_count(F.col("x").bitwiseXOR(F.lit(15)))).collect()
    assert [r[0] for r in got] == [4, 3, 2, 2, 1, 0]


def test_vitals(spark):
    cases = ["38.5", "3.84/", "8", "", "nan", "12..5", "正常", None]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert [r[0] for r in df.select(ft.vital(F.col("s"), 38.0)).collect()] == [38.5, 3.84, 0.1, 38.0, 38.0, 12.0, 0.1, 38.0]
    assert df.limit(1).select(ft.vital(F.col("s"), 38.0, True)).head()[0] == 385.0


def test_elapsed_days(spark):
    df = spark.createDataFrame([("2020-02-28 23:00:00.0", "2020-03-01 01:00:00.0"), (None, "2020-03-01 01:00:00.0")], "a string, b string")
    assert [r[0] for r in df.select(ft.elapsed_days(ft.timestamp(F.col("a")), ft.timestamp(F.col("b")))).collect()] == [1, 0]


def test_limits_are_numbers(spark):
    b = spark.createDataFrame([("x", "9.5|10.2", None), ("y", "7", "6|8"), ("z", None, None)], "name string, male_weight string, female_weight string")
    assert rows(ft.limits(b)) == [("x", 9.5, 10.2), ("y", 6.0, 8.0), ("z", None, None)]


def test_sharing_finds_all_similar_pairs(spark):
    r = np.random.default_rng(2)
    words = sorted({"".join(r.choice(list("abcdefgh"), r.integers(0, 7))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    for least in (0.5, 0.6):
        got = {(a, b) for a, b in rows(joins.sharing(df, "w", least))}
        want = {(a, b) for a, b in itertools.combinations(words, 2) if set(a) & set(b) and len(set(a) & set(b)) >= least * len(set(a) | set(b))}
        assert want <= got


def test_synonyms_that_begin_differently(spark, tmp_path):
    from skein.plans.language_queries import q_synonyms

    spark.createDataFrame([("美国短毛猫", ["美短"]), ("英国短毛猫", ["国短毛猫", None, ""]), (None, None)], "name string, alias array<string>").write.parquet(str(tmp_path / "entity_alias.parquet"))
    spark.createDataFrame([(["猫", "狗"],)], "question_rough_cut array<string>").write.parquet(str(tmp_path / "qa.parquet"))
    got = rows(q_synonyms(spark, str(tmp_path)).where("method = 'characters'").select("x", "y", "similarity"))
    assert got == [("国短毛猫", "美国短毛猫", 0.8), ("国短毛猫", "英国短毛猫", 0.8), ("美国短毛猫", "英国短毛猫", 0.666667)]


def test_corrections_of_two_characters(spark, tmp_path):
    from skein.plans.language_queries import q_corrections

    spark.createDataFrame([(["口水", "流口水", "关节肿", "节肿"],)], "question_fine_cut array<string>").write.parquet(str(tmp_path / "qa.parquet"))
    got = rows(q_corrections(spark, str(tmp_path)).select("word", "candidate"))
    assert got == [("关节肿", "节肿"), ("口水", "流口水"), ("流口水", "口水"), ("节肿", "关节肿")]


def test_within_edits(spark):
    r = np.random.default_rng(1)
    words = sorted({"".join(r.choice(list("abc"), r.integers(0, 9))) for _ in range(150)})
    got = {(a, b): d for a, b, d in rows(joins.within_edits(spark.createDataFrame([(w,) for w in words] + [(None,)], "w string"), "w", 2))}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    assert got == {(a, b): d for a, b in itertools.combinations(words, 2) if (d := lev(a, b)) <= 2}


def test_dense_ids_and_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 10).alias("g"))
    assert rows(windows.dense_ids(df, [F.desc("v")], "n").select("v", "n")) == sorted([(v, 999 - v) for v in range(1000)], key=repr)
    assert rows(windows.average_ranks(df, "g", "r")) == [(g, g * 100 + 50.5) for g in range(10)]


def test_lookup_with_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1), (3, 1)], "k int, x int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 3")
    assert lookup(left, right, ["k"], "n", hot=100).count() == 501
    assert small(left, 10) is left


def test_mentions_against_brute_force(spark):
    texts = ["狗得了犬细小病毒感染" * 40, "细小", "", None, "abc细小病毒"]
    words = ["细小病毒", "细小", "犬细小病毒感染", "c细", "没有", "犬细小病毒感染狗得了犬细小病毒", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows(tagging.mentions(df, "i", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w").distinct())
    assert got == sorted([(i, w) for i, t in enumerate(texts) if t for w in words if w and w in t], key=repr)


def test_longest_mention_and_order(spark):
    alias = spark.createDataFrame([("西伯利亚哈士奇犬", ["哈士奇", "二哈"], "dog"), ("血尿", ["尿血", None, ""], "SYMPTOMS"), ("尿", None, "SYMPTOMS")], "name string, alias array<string>, type string")
    got = tagging.link(spark.createDataFrame([(1, "哈士奇尿血怎么办")], "i int, t string"), "i", "t", alias)
    assert rows(got) == [(1, "血尿", "SYMPTOMS", 1), (1, "西伯利亚哈士奇犬", "DOG", 2)]


def test_bigrams_keep_pairs_apart(spark):
    df = spark.createDataFrame([(["ab", "c"],), (["a", "bc"],), (None,), ([None, "x"],)], "t array<string>")
    got = {(a, b): n for a, b, n in rows(counts.bigrams(df, "t"))}
    assert got["ab", "c"] == got["a", "bc"] == 1 and got["<SOS>", "x"] == 1


def test_graph(spark):
    e = spark.createDataFrame([("A", "r1", "B"), ("B", "r2", "C"), ("D", "n", "A"), ("D", "r2", "E")], "src string, rel string, dst string")
    start = spark.createDataFrame([("A",)], "name string")
    assert rows(graph.one_hop(e, start)) == [("A", "r1", "B")]
    assert rows(graph.two_hops(e, start)) == [("A", "r1|r2", "C")]
    assert rows(graph.siblings(e, start)) == [("A", "n|r2", "E")]
    c = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 5.0), ("a", "b", 1.0), ("b", "t", 1.0)], "src string, dst string, cost double")
    assert dict(rows(graph.shortest_paths(c, "s"))) == {"s": 0.0, "a": 2.0, "b": 3.0, "t": 4.0}
    cyclic = c.select("src", "dst").unionByName(spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string"))
    names = cyclic.select(F.col("src").alias("name")).union(cyclic.select("dst")).distinct()
    assert dict(rows(graph.topological_levels(names, cyclic))) == {"s": 0, "a": 1, "b": 2, "t": 3}


def test_nearest_in_blocks(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(4)
    got = rows(retrieve.nearest(df, "i", "v", df.where("i < 7"), "i", "v", 3, block=2).select("qid", "id", "rank"))
    n = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == sorted([(q, int(i), k + 1) for q in range(7) for k, i in enumerate(np.argsort(-(n[q] @ n.T))[:3])], key=repr)


def test_readings_and_codes(spark):
    from skein.operators import suggest

    d = spark.createDataFrame([("诊", "zhen"), ("症", "zheng"), ("瘦", "shou"), ("嗽", "sou")], "ch string, reading string")
    w = spark.createDataFrame([("病症",), ("病诊",), ("瘦",), ("嗽",), (None,)], "w string")
    assert rows(suggest.homophones(w, "w", d)) == sorted([("嗽", "瘦"), ("瘦", "嗽"), ("病症", "病诊"), ("病诊", "病症")], key=repr)
    same = spark.createDataFrame([("4G02080043A", "4G02080043A"), ("4G02080043A", "3F13191154B")], "a string, b string").select(F.round(suggest.code_similarity(F.col("a"), F.col("b")), 3)).collect()
    assert [r[0] for r in same] == [1.0, 0.068]


def test_viterbi_words(spark):
    from skein.operators import suggest

    s = [[-1.0, -9.0, -9.0, -9.0], [-9.0, -1.0, -9.0, -9.0], [-1.0, -9.0, -9.0, -9.0]]
    df = spark.createDataFrame([("犬瘟热", s), ("", []), (None, None)], "t string, s array<array<double>>")
    assert [r[0] for r in df.select(suggest.viterbi_words("t", "s")).collect()] == [["犬瘟", "热"], [], None]


def test_templates(spark):
    from skein.operators import suggest

    q = ["select ?x where { <犬瘟热> <症状> ?x . }", "select ?x where { ?x <症状> <发热> . }", "select ?y where { <猫> <疾病> ?x . ?x <症状> ?y . }", "x"]
    e, t = suggest.template_of(F.col("q"))
    got = spark.createDataFrame([(x,) for x in q], "q string").select(e, t).collect()
    assert [r[1] for r in got] == ["1a", "1b", "2a", "other"] and got[0][0] == ["犬瘟热"] and got[1][0] == ["发热"]
