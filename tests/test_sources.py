from conftest import rows

from skein.sources import tables as t
from skein.streaming.incremental import append_new


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,猫\n2,狗\n", "utf-8")
    assert rows(t.csv_positional(spark, str(tmp_path / "a.csv"), ["p", "q"])) == [("1", "猫"), ("2", "狗")]
    (tmp_path / "p.txt").write_text("a||b||0.5\nc||d\n", "utf-8")
    assert rows(t.sentence_pairs(spark, str(tmp_path / "p.txt"))) == [("a", "b", 0.5), ("c", "d", None)]
    (tmp_path / "v.txt").write_text("2 3\n猫 1 2 3\n狗 0.5 0 1\n", "utf-8")
    assert rows(t.word_vectors(spark, str(tmp_path / "v.txt"))) == [("狗", (0.5, 0.0, 1.0)), ("猫", (1.0, 2.0, 3.0))]
    (tmp_path / "d.txt").write_text("行\txing hang\n", "utf-8")
    assert rows(t.char_dictionary(spark, str(tmp_path / "d.txt"))) == [("行", ("xing", "hang"))]
    (tmp_path / "r.toml").write_text('[SPECIES]\nname = "DOG"\ncontain = ["狗", "犬"]\n[[AGE]]\nname = "幼"\ncontain = ["幼犬"]\n', "utf-8")
    assert rows(t.keyword_rules(spark, str(tmp_path / "r.toml"))) == [("AGE", "幼", "幼犬", True), ("SPECIES", "DOG", "犬", False), ("SPECIES", "DOG", "狗", False)]


def test_lines_without_repetition(spark, tmp_path):
    t.write_lines(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "s string"), "s", str(tmp_path / "o"))
    assert rows(t.lines(spark, str(tmp_path / "o"))) == [("a",), ("b",)]


def test_incremental_keeps_the_mark(spark):
    new = spark.createDataFrame([(3,), (5,), (6,)], "k long")
    assert rows(t.incremental(new, spark.createDataFrame([(4,), (3,)], "k long"), "k")) == [(5,), (6,)]
    assert rows(t.incremental(new, new.limit(0), "k")) == [(3,), (5,), (6,)]


def test_stream_appends_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, s string").write.parquet(src)
    append_new(spark, src, "k long, s string", out, "k", cp)
    spark.createDataFrame([(2, "b"), (3, "c")], "k long, s string").write.mode("append").parquet(src)
    append_new(spark, src, "k long, s string", out, "k", cp)
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b"), (3, "c")]
