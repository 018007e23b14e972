import pytest
from conftest import rows
from pyspark.sql import functions as F
from skein.functions import prepare as pr
from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.operators import features as ft
from skein.operators import graph, mining, models, retrieve, suggest, vectors
from skein.sources import tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()[0]


def test_numerals_of_any_length():
    assert [tx.numerals(n) for n in (10, 100_000_000, 123_456_789, 100_000_010)] == ["十", "一亿", "一亿二千三百四十五万六千七百八十九", "一亿零一十"]


def test_spoken_numbers(spark):
    assert one(spark, "电话12345678901234567号，共10只", tx.spoken_numbers) == "电话一二三四五六七八九零一二三四五六七号，共十只"
    assert one(spark, None, tx.spoken_numbers) is None


@pytest.mark.parametrize(("text", "want"), [("a（b（c（d）e）f）g", "ag"), ("（）", ""), ("a)b(", "a)b("), ("", ""), (None, None)])
def test_brackets_of_any_depth(spark, text, want):
    assert one(spark, text, tx.without_brackets) == want


def test_blocks_and_abstract(spark):
    text = "先看。再喂！\n最后休息"
    got = one(spark, text, pr.blocks)
    assert [(x["begin"], x["block"]) for x in got] == [(0, "先看。"), (3, "再喂！"), (6, "\n"), (7, "最后休息")]
    assert all(text[b : b + len(x)] == x for b, x in got) and one(spark, "", pr.blocks) == [] and one(spark, None, pr.blocks) is None
    ask = lambda q, t: spark.createDataFrame([(text, q, t)], "c string, q string, t array<string>").select(pr.abstract(F.col("c"), F.col("q"), F.col("t"))).head()[0]
    assert ask("再喂", None) == "<em>再喂</em>！" and ask("没有", ["喂", "休息", None]) == "最后<em>休息</em>" and ask(None, None) == text


def test_hashes_and_distances(spark):
    assert [one(spark, x, pr.fnv) for x in ("", "a", "foobar", None)] == [2166136261, 0xE40C292C, 0xBF9CF968, None]
    assert one(spark, "犬", lambda c: pr.byte_distance(c, F.lit("猫"))) == 2


def test_named_similarities(spark):
    assert one(spark, "哈士奇", lambda c: sim.lexical("levenshtein", c, F.lit("哈士骑"))) == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="no similarity"):
        sim.lexical("x", F.lit("a"), F.lit("b"))
    with pytest.raises(ValueError, match="taken"):
        sim.register("jaccard", sim.jaccard)


def test_diagnosis_filter(spark):
    r = spark.createDataFrame([("a", "s", 4), ("b", "s", 1), ("c", "s", 5), ("c", "s", 5), (None, "s", 9), ("d", None, 9), ("e", "s", None)], "disease string, symptom string, weight int")
    q = spark.createDataFrame([("1", "s"), ("2", "s"), ("3", "t"), ("1", "s")], "request string, symptom string")
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "disease string, sex int")
    g = spark.createDataFrame([("1", 2), ("2", None)], "request string, sex int")
    assert rows(ft.diagnose_filtered(r, q, a, g, ["sex"])) == [("1", "b", pytest.approx(1 / 6), 2), ("1", "c", pytest.approx(5 / 6), 1), ("2", "a", pytest.approx(0.4), 2), ("2", "b", pytest.approx(0.1), 3), ("2", "c", pytest.approx(0.5), 1)]
    assert rows(ft.diagnose_filtered(r.limit(0), q, a, g, ["sex"])) == []


def test_graph_templates(spark):
    e = spark.createDataFrame([("A", "r1", "B"), ("B", "r2", "C"), ("D", "中文名", "A"), ("D", "r2", "E"), ("D", "self", "D"), ("F", "中文名", "B"), ("F", "r4", "G")], "src string, rel string, dst string")
    a = spark.createDataFrame([("A",)], "name string")
    assert rows(graph.hop_back(e, a, "中文名")) == [("A", "r1|中文名|r4", "G"), ("A", "r1|中文名|中文名", "B")]
    assert rows(graph.named_loop(e, a, "中文名")) == [("A", "中文名|self|r2", "E"), ("A", "中文名|self|中文名", "A")]
    assert rows(graph.templates({"1a": graph.one_hop(e, a), "2ab": graph.hop_back(e, a, "中文名")}, 1)) == [("A", "1a", "r1", "B")]
    chain = spark.createDataFrame([(f"v{i}", f"v{i + 1}", 1.0) for i in range(5)], "src string, dst string, cost double")
    with pytest.raises(ValueError, match="more than"):
        graph.shortest_paths(chain, "v0", 2)
    with pytest.raises(ValueError, match="deeper"):
        graph.topological_levels(spark.createDataFrame([(f"v{i}",) for i in range(6)], "name string"), chain, 3)


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,)], "key string")
    other = spark.createDataFrame([(f"o{i}",) for i in range(300)], "key string")
    b = mining.bloom_filter(keys, "key", 40_000, 7)
    got = mining.maybe_in(keys.unionByName(other), "key", b, 40_000, 7).collect()
    assert all(r["maybe"] for r in got if r["key"] and r["key"][0] == "k") and sum(r["maybe"] for r in got if r["key"] and r["key"][0] == "o") < 5
    assert not any(r["maybe"] for r in mining.maybe_in(other, "key", b.limit(0), 40_000, 7).collect())


def test_pooling(spark):
    df = spark.createDataFrame([(1, ["a", "b", None, ""]), (2, ["x"]), (3, None), (4, [])], "k long, w array<string>")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vector array<double>")
    t = vectors.looked_up(df, "k", "w", v, 2)
    assert rows(vectors.pooled(t)) == [(1, (0.5, 1.5)), (2, (0.0, 0.0))]
    assert rows(vectors.pooled(t, F.when(F.col("word") == "a", 2.0).otherwise(0.0))) == [(1, (2.0, 0.0)), (2, (None, None))]
    assert [(i, w) for i, w, _ in rows(vectors.term_distances(t))] == [(1, "a"), (1, "b"), (2, "x")]


def test_suspects_and_corrections(spark):
    df = spark.createDataFrame([(1, ["狗", "发烧"])] * 3 + [(2, ["狗", "发绕", None]), (3, None), (4, [])], "k long, w array<string>")
    n = spark.createDataFrame([("<SOS>", "狗", 4), ("狗", "发烧", 3), ("发烧", "<EOS>", 3), ("狗", "发绕", 1)], "w1 string, w2 string, n long")
    words = spark.createDataFrame([("狗",), ("发烧",)], "w string")
    marked = suggest.suspects(df.distinct(), "k", "w", n, words, "w")
    assert {(r["id"], r["word"]): (r["begin"], r["end"], round(r["score"], 6)) for r in marked.collect()} == {(1, "狗"): (0, 1, 0.0), (1, "发烧"): (1, 3, 0.0), (2, "狗"): (0, 1, 0.4), (2, "发绕"): (1, 3, 2.6)}
    best = spark.createDataFrame([("发绕", "发烧"), ("狗", "猫")], "word string, candidate string")
    assert rows(suggest.corrected(marked, best, 1.0)) == [(1, "狗发烧", 0), (2, "狗发烧", 1)]


def test_metrics_and_modes(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    assert rows(models.classification_metrics(df, "y", "p", [0, 1])) == [(0.75, round((2 / 3 + 1) / 2, 6), 0.75, round((2 * 0.8 + 2 * 2 / 3) / 4, 6))]
    with pytest.raises(ValueError, match="unknown mode"):
        retrieve.by_mode(df, "y", "y", "p", df, ("x",))


def test_stored_tables(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    path = str(tmp_path / "t.parquet")
    assert tables.cached(spark, path, build).count() == 3 and tables.cached(spark, path, build).count() == 3 and made == [1]
    tables.copy_tables(spark, str(tmp_path), str(tmp_path / "o"), ["t"])
    tables.copy_tables(spark, str(tmp_path), str(tmp_path / "o"), ["t"])
    assert spark.read.parquet(str(tmp_path / "o/t.parquet")).count() == 6
    (tmp_path / "idf.json").write_text('{"犬": 1.5, "猫": 2}\n')
    assert rows(tables.idf_json(spark, str(tmp_path / "idf.json"))) == [("犬", 1.5), ("猫", 2.0)]
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    assert rows(tables.statistics(df)) == [("a", 2, 0, 1), ("b", 2, 1, 1)]


def test_phrases_and_parts(spark):
    df = spark.createDataFrame([(["皮肤", "发红"],)] * 5 + [(["皮肤", "的"],)] * 5 + [(None,), ([],)], "w array<string>")
    words = spark.createDataFrame([("发红",), (None,)], "word string")
    p = mining.phrases(df, "w", words, "word")
    assert rows(p) == [("皮肤发红", 5)] and rows(mining.without_known_parts(p, "phrase", words, "word")) == []
