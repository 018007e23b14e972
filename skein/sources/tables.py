"""Readers and writers: parquet tables, positional CSV, TSV folders, line corpora, TOML rules, vector files, store-like upserts."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find(df: DataFrame, condition: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Document-store scan: equality, ``$in``, ``$gt``, ``$gte``, ``$lt``, ``$ne`` conditions become pushed-down filters, columns a pruned projection."""
    ops = {"$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v))}
    for name, want in (condition or {}).items():
        for op, v in want.items() if isinstance(want, dict) else [("$eq", want)]:
            df = df.where(ops[op](F.col(name), v) if op in ops else F.col(name) == v)
    return df.select(*columns) if columns else df


def update_where(df: DataFrame, changes: dict[str, tuple]) -> tuple[DataFrame, Column]:
    """Conditional update ``{column: (old, new)}``: rows in which all old values hold get all new ones. Returns the table and the match condition."""
    hit = F.lit(True)
    for c, (old, _) in changes.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(old))
    return df.withColumns({c: F.when(hit, F.lit(new)).otherwise(F.col(c)) for c, (_, new) in changes.items()}), hit


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Keeps the rows for which the condition isn't true; unknown counts as not matching."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").parquet(path)


def csv_positional(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A CSV whose header is replaced by position; every column is read as string, so nothing is inferred."""
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).option("enforceSchema", True).option("sep", sep).csv(path)


def tsv_folder(spark: SparkSession, path: str, schema: str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """TSV files with their file name as a column; malformed lines are skipped."""
    df = spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df if fraction is None else df.sample(fraction, seed)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Plain-text sink without repeated lines."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def char_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``char<TAB>reading reading ...`` lines as (char, readings)."""
    p = F.split("line", "\t")
    return lines(spark, path).select(p[0].alias("char"), F.split(F.try_element_at(p, F.lit(2)), " ").alias("readings"))


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``a||b||label`` lines."""
    p = F.split("line", r"\|\|")
    return lines(spark, path).select(p[0].alias("a"), F.try_element_at(p, F.lit(2)).alias("b"), F.expr("try_cast(try_element_at(split(line, '\\\\|\\\\|'), 3) as double)").alias("label"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text vectors, ``word v1 v2 ...`` per line; a header line with two numbers is skipped."""
    p = F.split(F.trim("line"), " ")
    return lines(spark, path).where(F.size(p) > 2).select(p[0].alias("word"), F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x.cast("float")).alias("vector"))


def keyword_rules(spark: SparkSession, path: str) -> DataFrame:
    """TOML rules ``scenario -> {name, contain}`` or ``scenario -> [{name, contain}]`` as (scenario, name, keyword, many)."""
    rows = []
    for scenario, body in tomllib.loads(Path(path).read_text("utf-8")).items():
        for rule in body if isinstance(body, list) else [body]:
            rows += [(scenario, rule.get("name"), k, isinstance(body, list)) for k in rule.get("contain", [])]
    return spark.createDataFrame(rows, "scenario string, name string, keyword string, many boolean")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at ``path``; built and stored first where there is none. A write that was broken off has no success mark and is done again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Appends tables of one folder to those of another."""
    for n in names:
        append(table(spark, source, n), os.path.join(target, f"{n}.parquet"))


def idf_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, idf) of JSON objects {word: idf}, one per line."""
    m = F.from_json("value", "map<string,double>")
    return spark.read.text(path).select(F.explode(m).alias("word", "idf"))


def statistics(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct) of every column, in one pass; distinct numbers are approximate."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(F.col(c)).alias("distinct")).alias(f"_{i}") for i, c in enumerate(df.columns)]
    return df.agg(*parts).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def incremental(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows at or above the high-water mark that aren't stored yet; an anti join keeps a row whose id equals the mark."""
    mark = seen.agg(F.coalesce(F.max(key), F.lit(-1)).alias("mark"))
    return new.join(F.broadcast(mark), F.col(key) >= F.col("mark")).drop("mark").join(seen.select(key), key, "left_anti")
