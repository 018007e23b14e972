"""The registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import boilerplate, copies, encode, leaks, normal, pairs, privacy, terms, toxic
from skein.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
with t as (select qa_index, 'question_fine_cut' as field, unnest(question_fine_cut) as term from qa
           union all select qa_index, 'question_rough_cut', unnest(question_rough_cut) from qa),
     c as (select qa_index, field, term, count(*) as tf from t where term is not null and trim(term) <> '' group by all),
     d as (select field, term, count(*) as df from c group by all)
select qa_index, field, term from c join d using (field, term) where tf >= 2 and df between 2 and 8""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that stand at least twice in their record and that few records share."""
    s = terms.scores(table(spark, d, "qa"), "qa_index", ["question_fine_cut", "question_rough_cut"], least_tf=2)
    return s.where("df between 2 and 8").select(F.col("id").alias("qa_index"), "field", "term").distinct()


@query("""
with t as (select qa_index, 'question_fine_cut' as field, unnest(question_fine_cut) as term, unnest(range(1, len(question_fine_cut) + 1)) as pos from qa
           union all select qa_index, 'question_rough_cut', unnest(question_rough_cut), unnest(range(1, len(question_rough_cut) + 1)) from qa),
     p as (select qa_index, field, term, row_number() over (partition by qa_index, field order by pos) as i from t where term is not null and trim(term) <> ''),
     g as (select a.qa_index, a.field, a.term, count(distinct a.i) as tf, count(distinct b.term) - 1 as degree
           from p a join p b on a.qa_index = b.qa_index and a.field = b.field and abs(a.i - b.i) <= 3 group by all),
     d as (select field, term, count(*) as df from (select distinct qa_index, field, term from p) group by all)
select qa_index, field, term, round(degree * ln((select count(*) from qa) / df), 6) as score from g join d using (field, term)""")
def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every term of every record."""
    s = terms.scores(table(spark, d, "qa"), "qa_index", ["question_fine_cut", "question_rough_cut"])
    return s.select(F.col("id").alias("qa_index"), "field", "term", "score")


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold characters which only look like the ordinary ones."""
    return normal.repair(table(spark, d, "qa"), "qa_index", ["question", "answer"]).where("hit").select(F.col("key").alias("qa_index"), "field").distinct()


@query(r"""
with l as (select qa_index, coalesce(site, chr(0)) as site, unnest(string_split(answer, chr(10))) as raw, unnest(range(1, len(string_split(answer, chr(10))) + 1)) as line_no from qa where answer is not null),
     t as (select qa_index, site, line_no, trim(raw, ' ' || chr(9) || chr(13)) as line from l),
     n as (select site, line, count(distinct qa_index) as documents from t where regexp_matches(line, '\S') group by all),
     s as (select coalesce(site, chr(0)) as site, count(*) as records from qa group by all)
select qa_index, line_no from t join n using (site, line) join s using (site) where documents >= 5 and documents >= 0.03 * records""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the answers of one site share."""
    return boilerplate.flagged(table(spark, d, "qa"), "qa_index", "site", "answer").where("repeated").select(F.col("id").alias("qa_index"), "line_no").distinct()


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of a question in another format, with the first of its group."""
    return copies.copies(table(spark, d, "qa"), "qa_index", ["question"]).select(F.col("first").alias("qa_index_first"), F.col("copy").alias("qa_index_copy"))


@query()
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document in the vocabulary byte_bpe_50k."""
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 40 consecutive characters of a test item."""
    found = leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return toxic.scored(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "text").where("score > 0").select(F.col("id").alias("doc_id")).distinct()


@query()
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents per source."""
    documents = table(spark, d, "documents")
    return toxic.rates(toxic.scored(documents, table(spark, d, "labels"), "doc_id", "text"), documents, "doc_id", "source")


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective question and answer pairs with their defect."""
    return pairs.defects(table(spark, d, "qa"), "qa_index", "site", "question", "answer").select(F.col("id").alias("qa_index"), "defect").distinct()


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Text fields of visits with personal information, by kind."""
    found = privacy.personal(table(spark, d, "visits"), "id", ["chief_complaint", "present_history", "doctor_advice"], "pet_name")
    return found.select("id", "field", F.explode("kinds").alias("kind")).distinct()
