"""Queries over text: cleaning, sentences, tokens, character classes, prefixes, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.plans.registry import query
from skein.sources.tables import delete_where, find, incremental, table, update_where

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_CLEAN = rf"regexp_replace(lower(translate(question, '{_WIDE}', '{_HALF}')), '[^0-9a-z\x{{00e0}}-\x{{024f}}\x{{4e00}}-\x{{9fff}}]+', '', 'g')"


@query("select qa_index, question from qa where site in ('pawwiki.example', 'maoqiu.test') and qa_index > 100 and breed_name is not null")
def q_find(spark: SparkSession, d: str) -> DataFrame:
    """Store scan with an IN list, a greater-than and a not-null filter, and a projection."""
    return find(table(spark, d, "qa"), {"site": {"$in": ["pawwiki.example", "maoqiu.test"]}, "qa_index": {"$gt": 100}}).where("breed_name is not null").select("qa_index", "question")


@query("select id, pet_kindof, case when dt = '2021-01-01' and pet_kindof = '犬' then '狗' else pet_kindof end as updated from visits")
def q_store_update(spark: SparkSession, d: str) -> DataFrame:
    """Conditional update of all rows whose old values match."""
    v = table(spark, d, "visits").withColumn("updated", F.col("pet_kindof"))
    new, _ = update_where(v.select("id", "dt", "pet_kindof", "updated"), {"dt": ("2021-01-01", "2021-01-01"), "updated": ("犬", "狗")})
    return new.select("id", "pet_kindof", "updated")


@query("select qa_index from qa where not coalesce(site like '%.test', false)")
def q_store_delete(spark: SparkSession, d: str) -> DataFrame:
    return delete_where(table(spark, d, "qa"), F.col("site").endswith(".test")).select("qa_index")


@query("select doc_id from documents where doc_id >= (select max(doc_id) from labels) and doc_id not in (select doc_id from labels where doc_id is not null)")
def q_incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Documents at or above the high-water mark that aren't stored yet."""
    return incremental(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("select id, city from visits where city is not null and regexp_matches(pet_kindof, '犬|猫') and regexp_matches(coalesce(chief_complaint, ''), '呕吐|拉稀')")
def q_regex_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visits").where(F.col("city").isNotNull() & F.col("pet_kindof").rlike("犬|猫") & F.coalesce("chief_complaint", F.lit("")).rlike("呕吐|拉稀")).select("id", "city")


@query("select qa_index, question from qa where length(question) between 12 and 30")
def q_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where(F.length("question").between(12, 30)).select("qa_index", "question")


@query("select qa_index from qa where question is not null and not regexp_matches(question, '^(请问|求助|急)') and not (question like '%吗？' or question like '%吗')")
def q_exclude_prefixes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return table(spark, d, "qa").where(q.isNotNull() & ~q.rlike("^(请问|求助|急)") & ~(q.endswith("吗？") | q.endswith("吗"))).select("qa_index")


@query("select p_partkey, case when p_partkey between 101 and 200 or p_partkey between 501 and 700 then true else false end as flagged from part")
def q_positional_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags by ranges of position."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (k.between(101, 200) | k.between(501, 700)).alias("flagged"))


@query("select qa_index from qa anti join (select word from sensitive_words where word is not null) s on contains(qa.question, s.word) where question is not null")
def q_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Questions without any listed word: substrings of the words' lengths are joined by equality, not by containment."""
    from skein.operators.tagging import mentions

    qa = table(spark, d, "qa").where("question is not null")
    return qa.join(mentions(qa, "qa_index", "question", table(spark, d, "sensitive_words"), "word").select("qa_index"), "qa_index", "left_anti").select("qa_index")


@query(f"select qa_index, {_CLEAN} as cleaned from qa")
def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").select("qa_index", tx.clean(F.col("question")).alias("cleaned"))


@query(r"select qa_index, cast(len(list_filter(string_split(regexp_replace(answer, '([。！？!?])', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')) as int) as sentences from qa where answer is not null")
def q_sentence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("answer is not null").select("qa_index", F.size(tx.sentences(F.col("answer"))).alias("sentences"))


@query("select qa_index, regexp_extract_all(question, '“[^”]*”') as passages from qa where question is not null")
def q_quoted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("question is not null").select("qa_index", tx.quoted(F.col("question")).alias("passages"))


@query("select qa_index, regexp_replace(regexp_replace(question, '[（(][^（()）]*[)）]', '', 'g'), '[（(][^（()）]*[)）]', '', 'g') as plain from qa")
def q_brackets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").select("qa_index", tx.without_brackets(F.col("question")).alias("plain"))


@query(r"""select term, regexp_full_match(term, '[\x{4e00}-\x{9fff}]+') as is_chinese, regexp_full_match(term, '[0-9]+') as is_number, regexp_full_match(term, '[A-Za-z]+') as is_alphabet,
  regexp_full_match(term, '[0-9A-Za-z]+') as is_alnum, not regexp_matches(term, '[0-9A-Za-z\x{4e00}-\x{9fff}]') as is_other
from (select distinct unnest(question_fine_cut) as term from qa) where term is not null""")
def q_char_classes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "qa").select(F.explode("question_fine_cut").alias("term")).where("term is not null").distinct()
    return t.select("term", *[c.alias(n) for n, c in tx.classes(F.col("term")).items()])


@query(rf"""with t as (select qa_index, {_CLEAN} as s from qa where question is not null)
select qa_index, (s = '' or regexp_matches(s, '^[0-9a-z]+$') or regexp_matches(s, '^[{tx.PARTICLES}]+$') or not regexp_matches(s, '[\x{{4e00}}-\x{{9fff}}]')) as nonsense from t""")
def q_nonsense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("question is not null").select("qa_index", tx.nonsense(F.col("question")).alias("nonsense"))


@query(f"select qa_index, list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> '' and t not in ({_STOP})) as terms from qa where question_fine_cut is not null")
def q_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("question_fine_cut is not null").select("qa_index", tx.without_stop_words(F.col("question_fine_cut")).alias("terms"))


@query("""select sub_query, part, list_sort(list(question)) as suggestions from
  (select question, part, substring(question, 1, i) as sub_query from (select question, part, unnest(range(1, least(length(question), 6) + 1)) as i from (select question, min(qa_index) // 10000 as part from qa where length(question) between 3 and 40 group by question)))
  where not regexp_matches(sub_query, '^[《「【(（“]') group by sub_query, part""")
def q_prefix_suggest(spark: SparkSession, d: str) -> DataFrame:
    """For every prefix of up to six characters the questions that begin with it, in parts by number, so no list has more than ten thousand."""
    q = table(spark, d, "qa").where(F.length("question").between(3, 40)).groupBy("question").agg(F.expr("min(qa_index) div 10000").alias("part"))
    p = q.select("question", "part", F.explode(tx.prefixes(F.col("question"))).alias("sub_query"))
    return p.where(~F.col("sub_query").rlike("^[《「【(（“]")).groupBy("sub_query", "part").agg(F.array_sort(F.collect_list("question")).alias("suggestions"))


@query("select qa_index, split_part(replace(answer, '编辑：', '【编】'), '【编】', 1) as body from qa where answer is not null")
def q_marker_cut(spark: SparkSession, d: str) -> DataFrame:
    """The text before a marker, after the marker's other spelling was unified."""
    return table(spark, d, "qa").where("answer is not null").select("qa_index", F.split_part(F.replace("answer", F.lit("编辑："), F.lit("【编】")), F.lit("【编】"), F.lit(1)).alias("body"))


@query("""select qa_index, case when position(disease_name in answer) > 0 then
  substring(answer, greatest(position(disease_name in answer) - 24, 1), position(disease_name in answer) - greatest(position(disease_name in answer) - 24, 1)) || '<em>' || disease_name || '</em>'
  || substring(answer, position(disease_name in answer) + length(disease_name), 24) else substring(answer, 1, 48) end as snippet
from qa where answer is not null and disease_name is not null and disease_name <> ''""")
def q_snippet(spark: SparkSession, d: str) -> DataFrame:
    """The answer's passage around the disease asked about, marked."""
    q = table(spark, d, "qa").where("answer is not null and disease_name is not null and disease_name <> ''")
    return q.select("qa_index", tx.snippet(F.col("answer"), F.col("disease_name")).alias("snippet"))


@query(rf"""select qa_index, coalesce({', '.join(f"case when position('{w}' in question) > 0 then '{w}' end" for w in tx.QUESTION_WORDS)}) as word,
  cast(regexp_matches(question, '[0-9]') as int) as has_number, cast(regexp_matches(question, '[A-Za-z]') as int) as has_latin, cast(regexp_matches(question, '[（(《【]') as int) as has_special, cast(length(question) as int) as length
from qa where question is not null""")
def q_surface_features(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    flag = lambda p: q.rlike(p).cast("int")
    return table(spark, d, "qa").where("question is not null").select("qa_index", tx.question_word(q).alias("word"), flag("[0-9]").alias("has_number"), flag("[A-Za-z]").alias("has_latin"), flag("[（(《【]").alias("has_special"), F.length(q).alias("length"))


_PAIRS = """with a as (select distinct name from entity_alias where name is not null), x as (select name, substring(name, 1, 1) as k from a),
p as (select l.name as a, r.name as b from x l join x r on l.k = r.k and l.name < r.name)"""


def names_and_aliases(spark: SparkSession, d: str) -> DataFrame:
    """(name): all different names and aliases."""
    e = table(spark, d, "entity_alias")
    return e.select("name").unionByName(e.select(F.explode("alias").alias("name"))).where("name is not null and trim(name) <> ''").distinct()


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different names that share their first character."""
    x = table(spark, d, "entity_alias").where("name is not null").select("name", F.substring("name", 1, 1).alias("k")).distinct()
    return x.select(F.col("name").alias("a"), "k").join(x.select(F.col("name").alias("b"), "k"), "k").where("a < b").select("a", "b")


@query(_PAIRS + """ select a, b, round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))), 6) as jaccard from p""")
def q_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).select("a", "b", F.round(sim.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query()
def q_string_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Edit ratio, quick ratio, Jaro-Winkler and longest common substring of all pairs of names and aliases that share a character."""
    from skein.operators.joins import sharing

    a, b = F.col("a"), F.col("b")
    return sharing(names_and_aliases(spark, d), "name", 1e-6).select("a", "b", F.round(sim.edit_ratio(a, b), 6).alias("edit_ratio"), F.round(sim.quick_ratio(a, b), 6).alias("quick_ratio"), F.round(sim.jaro_winkler(a, b), 6).alias("jaro_winkler"), sim.common_substring(a, b).alias("common_substring"))


@query("""with n as (select distinct p_name as s from part) select l.s as a, r.s as b, cast(levenshtein(l.s, r.s) as int) as distance from n l join n r on l.s < r.s and abs(length(l.s) - length(r.s)) <= 3 where levenshtein(l.s, r.s) <= 3""")
def q_edit_distance_join(spark: SparkSession, d: str) -> DataFrame:
    """Names within three edits: one of four pieces of the shorter name must stand in the other, so pieces are joined by equality."""
    from skein.operators.joins import within_edits

    names = table(spark, d, "part").select(F.col("p_name").alias("s")).distinct()
    return within_edits(names, "s", 3)


@query("select p_partkey, cast(bit_count(xor(p_partkey, 15)) as int) as hamming from part")
def q_hamming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.bit_count(F.col("p_partkey").bitwiseXOR(F.lit(15))).alias("hamming"))


@query()
def q_fuzzy_places(spark: SparkSession, d: str) -> DataFrame:
    """Near matches of the breed's name in the question itself."""
    q = table(spark, d, "qa").where("question is not null and breed_name is not null and length(breed_name) > 2")
    return q.select("qa_index", F.explode(sim.fuzzy_places(F.col("question"), F.col("breed_name"))).alias("m")).select("qa_index", "m.begin", F.round("m.score", 6).alias("score"))


@query()
def q_spoken_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").select("qa_index", tx.spoken_numbers(F.col("question")).alias("spoken"))


@query()
def q_segment(spark: SparkSession, d: str) -> DataFrame:
    """Segmentation by the alias dictionary, longest word first."""
    a = table(spark, d, "entity_alias")
    words = a.select(F.col("name").alias("word")).unionByName(a.select(F.explode("alias").alias("word"))).where("length(word) > 1")
    return tx.segment(table(spark, d, "qa"), "question", words, "word").select("qa_index", "tokens")


@query("select qa_index, cast(length(question) as int) as n, printf('%.2f%%', round(length(question) / 7.0, 2)) as percent, substring(cast(created_at as varchar), 1, 7) as month from qa where question is not null and created_at is not null")
def q_formats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qa").where("question is not null and created_at is not null")
    return q.select("qa_index", F.length("question").alias("n"), F.format_string("%.2f%%", F.round(F.length("question") / 7.0, 2)).alias("percent"), F.date_format("created_at", "yyyy-MM").alias("month"))


@query("select qa_index, url_encode(question) as quoted from qa where question is not null")
def q_url_quote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("question is not null").select("qa_index", tx.url_quoted(F.col("question")).alias("quoted"))


@query("""with a as (select name, unnest(string_split(regexp_replace(coalesce(chinese_alias, ''), '[，,/]', '|', 'g'), '|')) as alias from breed_info) select distinct name, trim(alias) as alias from a where trim(alias) <> ''""")
def q_alias_extract(spark: SparkSession, d: str) -> DataFrame:
    """Aliases from a delimited field."""
    b = table(spark, d, "breed_info").select("name", F.explode(F.split(F.regexp_replace(F.coalesce("chinese_alias", F.lit("")), "[，,/]", "|"), r"\|")).alias("alias"))
    return b.select("name", F.trim("alias").alias("alias")).where("alias <> ''").distinct()


@query("""with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line from documents where text is not null)
select doc_id, line, length(line) as n from l where regexp_matches(line, '^# ')""")
def q_headings(spark: SparkSession, d: str) -> DataFrame:
    """Marked-up headings of documents."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.col("line").rlike("^# ")).select("doc_id", "line", F.length("line").cast("long").alias("n"))


@query("""select qa_index, breed_name, row_number() over (partition by breed_name order by length(question) desc, qa_index) as rank from qa where breed_name is not null and question is not null
qualify row_number() over (partition by breed_name order by length(question) desc, qa_index) <= 3""")
def q_topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("breed_name").orderBy(F.length("question").desc(), "qa_index")
    return table(spark, d, "qa").where("breed_name is not null and question is not null").select("qa_index", "breed_name", "question").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("qa_index", "breed_name", "rank")
