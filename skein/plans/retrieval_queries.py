"""Search queries: exact, BM25, vectors, fusion, re-ranking, entities, rules, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.operators import counts, retrieve, tagging
from skein.plans.registry import query
from skein.sources.tables import table

#: A small rule dictionary (scenario, name, keyword).
RULES = [("PART", "皮肤", "皮肤"), ("PART", "耳朵", "耳道"), ("PART", "眼睛", "眼角"), ("AGE", "幼年", "断奶期"), ("AGE", "幼年", "刚满月"), ("AGE", "成年", "成年"), ("AGE", "老年", "老年"), ("HEALTHY", "消化", "拉稀"), ("HEALTHY", "消化", "呕吐"), ("HEALTHY", "消化", "便秘"), ("HEALTHY", "皮毛", "掉毛"), ("HEALTHY", "皮毛", "皮屑"), ("FOOD", "奶", "羊奶"), ("FOOD", "肉", "牛肉"), ("FOOD", "肉", "鸡胸肉")]
_RULES = "rules(scenario, name, keyword) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES) + ")"
_DOCS = r"docs as (select doc_id as id, list_filter(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[0-9a-z\x{00e0}-\x{024f}]+'), lambda t: true) as t from documents where text is not null)"
_QUERIES = "queries as (select qa_index as qid, list_distinct(list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> '')) as t from qa where qa_index % 20 = 0 and question_fine_cut is not null)"
_POST = "post as (select id, term, len(t) as dl, count(*) as tf from (select qa_index as id, list_filter({c}, lambda t: t is not null and trim(t) <> '') as t, unnest(list_filter({c}, lambda t: t is not null and trim(t) <> '')) as term from qa where {c} is not null) group by all), st as (select count(*) as n, avg(len(list_filter({c}, lambda t: t is not null and trim(t) <> ''))) as avgdl from qa where {c} is not null)"
_BM = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"


def _qa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose number is divisible by 20."""
    return _qa(spark, d).where("qa_index % 20 = 0")


@query(f"""with {_POST.format(c='question_fine_cut')}, {_QUERIES}, q as (select qid, unnest(t) as term from queries), df as (select term, count(*) as df from post group by term),
s as (select qid, id, {_BM} as score from post join q using (term) join df using (term), st group by qid, id),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s) select qid, id, round(score, 6) as score, cast(rank as int) as rank from r where rank <= 10""")
def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best questions for each query by BM25 of the fine segmentation."""
    r = retrieve.bm25(_qa(spark, d), "qa_index", "question_fine_cut", _queries(spark, d), "qa_index", "question_fine_cut")
    return r.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_POST.format(c='question_fine_cut')}, df as (select term, count(*) as df from post group by term), q as (select distinct qa_index as qid, unnest(question_fine_cut) as term from qa where qa_index % 20 = 0),
f as (select qid, id, {_BM} as score from post join q using (term) join df using (term), st group by qid, id),
{_POST.format(c='question_rough_cut').replace('post as', 'post2 as').replace('st as', 'st2 as')}, df2 as (select term, count(*) as df from post2 group by term), q2 as (select distinct qa_index as qid, unnest(question_rough_cut) as term from qa where qa_index % 20 = 0),
g as (select qid, id, {_BM} as score from post2 join q2 using (term) join df2 using (term), st2 group by qid, id),
s as (select qid, id, max(score) as score from (select * from f union all select * from g) group by qid, id), r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s)
select qid, id, round(score, 6) as score from r where rank <= 10""")
def q_two_fields(spark: SparkSession, d: str) -> DataFrame:
    """Best of two fields."""
    qa, qs = _qa(spark, d), _queries(spark, d)
    parts = [retrieve.bm25(qa, "qa_index", c, qs, "qa_index", c).select("qid", "id", "score") for c in ("question_fine_cut", "question_rough_cut")]
    best = parts[0].unionByName(parts[1]).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return retrieve.top(best, 10).select("qid", "id", F.round("score", 6).alias("score"))


@query("""with c as (select qa_index as id, question as k, 1 as c from qa where question <> '' union all select qa_index, array_to_string(question_fine_cut, ' '), 2 from qa union all select qa_index, array_to_string(question_rough_cut, ' '), 3 from qa)
select q.id as qid, x.id, count(distinct x.c)::double as score from c x join c q on x.k = q.k and x.c = q.c and q.id % 20 = 0 where x.k is not null and x.k <> '' group by all""")
def q_exact(spark: SparkSession, d: str) -> DataFrame:
    """Disjunctive exact search over question and both segmentations."""
    both = lambda c: (F.array_join(c, " "), F.array_join(c, " "))
    return retrieve.exact(_qa(spark, d), "qa_index", [(F.col("question"), F.col("question")), both("question_fine_cut"), both("question_rough_cut")], _queries(spark, d), "qa_index")


@query("""with q as (select vec_id as qid, embedding::double[] as q from embeddings where vec_id % 20 = 0), s as (select qid, vec_id as id, list_cosine_similarity(q, embedding::double[]) as score from q, embeddings),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s) select qid, id, round(score, 6) as score, cast(rank as int) as rank from r where rank <= 10""")
def q_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    r = retrieve.nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return r.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("""with q as (select vec_id as qid, embedding::double[] as q from embeddings where vec_id % 20 = 0), s as (select qid, vec_id as id, -list_distance(q, embedding::double[]) as score from q, embeddings),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s) select avg(case when qid = id then 1.0 else 0.0 end) as recall from r where rank = 1""")
def q_self_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of vectors that find themselves first."""
    e = table(spark, d, "embeddings")
    r = retrieve.nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding", 1, "euclidean")
    return r.agg(F.avg(F.when(F.col("qid") == F.col("id"), 1.0).otherwise(0.0)).alias("recall"))


@query("""with p as (select a.vec_id as a, b.vec_id as b, a.embedding::double[] as x, b.embedding::double[] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
m as (select a, b, list_cosine_similarity(x, y) as c, list_distance(x, y) as e, sqrt(list_dot_product(x, x)) as nx, sqrt(list_dot_product(y, y)) as ny from p), t as (select *, degrees(acos(c)) + 10 as th from m)
select a, b, round(c, 6) as cosine, round(e, 6) as euclidean, round(nx * ny * sin(radians(th)) / 2 * pi() * pow(e + abs(nx - ny), 2) * th / 360, 3) as triangle_sector from t""")
def q_vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """Cosine, Euclidean and triangle-sector similarity of neighbouring vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    return p.select("a", "b", F.round(sim.cosine(x, y), 6).alias("cosine"), F.round(sim.euclidean(x, y), 6).alias("euclidean"), F.round(sim.triangle_sector(x, y), 3).alias("triangle_sector"))


@query(f"""with {_POST.format(c='question_fine_cut')}, {_QUERIES}, q as (select qid, unnest(t) as term from queries), df as (select term, count(*) as df from post group by term),
s as (select qid, id, {_BM} as score from post join q using (term) join df using (term), st group by qid, id), r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s),
e as (select a.qa_index as qid, b.qa_index as id from qa a join qa b on a.question = b.question where a.qa_index % 20 = 0 and a.question <> ''),
f as (select qid, id, 1 as route from e union all select qid, id, 2 from r where rank <= 10), u as (select qid, id, min(route) as route from f group by qid, id),
j as (select u.*, a.question as x, b.question as y, string_split(b.tag_species, '|') as ts, string_split(a.tag_species, '|') as tq from u join qa a on a.qa_index = qid join qa b on b.qa_index = id),
k as (select qid, id, route, len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) + case when contains(y, x) then 1 else 0 end as score from j
  where x is not null and y is not null and (tq is null or (ts is not null and list_has_any(ts, tq)))),
z as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from k) select qid, id, route, round(score, 6) as score, cast(rank as int) as rank from z where rank <= 10""")
def q_search(spark: SparkSession, d: str) -> DataFrame:
    """End to end: exact and term route, fusion, tag filter before the limit, re-ranking by similarity with a boost, limit."""
    qa, qs = _qa(spark, d), _queries(spark, d)
    same = retrieve.exact(qa, "qa_index", [(F.col("question"), F.col("question"))], qs, "qa_index").withColumn("rank", F.lit(1))
    terms = retrieve.bm25(qa, "qa_index", "question_fine_cut", qs, "qa_index", "question_fine_cut")
    fused = retrieve.fuse([(1, same), (2, terms)])
    side = lambda k, p: qa.select(F.col("qa_index").alias(k), F.col("question").alias(p), F.split("tag_species", r"\|").alias(f"{p}_tags"))
    j = fused.join(side("qid", "x"), "qid").join(side("id", "y"), "id").where("x is not null and y is not null").where(retrieve.passes_filter(F.col("y_tags"), F.col("x_tags")))
    score = sim.jaccard(F.col("x"), F.col("y")) + F.when(F.contains("y", F.col("x")), 1).otherwise(0)
    return retrieve.top(j.select("qid", "id", "route", score.alias("score")), 10).select("qid", "id", "route", F.round("score", 6).alias("score"), "rank")


@query("select qa_index, question from qa where qa_index in (1, 2, 3, 5, 8)")
def q_hot(spark: SparkSession, d: str) -> DataFrame:
    """Hot questions: an IN list that reaches the scan."""
    return _qa(spark, d).where(F.col("qa_index").isin(1, 2, 3, 5, 8)).select("qa_index", "question")


_ALIAS = "al as (select distinct m as mention, name, upper(type) as type from (select name, type, unnest(list_append(coalesce(alias, []), name)) as m from entity_alias where name is not null) where m is not null and trim(m) <> '')"


@query(f"""with {_ALIAS}, h as (select distinct qa_index, mention from qa join (select distinct mention from al) on contains(question, mention)),
k as (select * from h x where not exists (select 1 from h y where y.qa_index = x.qa_index and y.mention <> x.mention and contains(y.mention, x.mention)))
select qa_index, name as entity, type, cast(row_number() over (partition by qa_index order by case type when 'DISEASE' then 2 when 'SYMPTOMS' then 1 else 0 end desc, name, type) as int) as rank from (select distinct qa_index, name, type from k join al using (mention))""")
def q_entity_link(spark: SparkSession, d: str) -> DataFrame:
    """Entities named by each question, longest mention only."""
    return tagging.link(_qa(spark, d), "qa_index", "question", table(spark, d, "entity_alias"))


@query("select doc_id, word from documents join (select distinct word from sensitive_words where word is not null and word <> '') on contains(text, word)")
def q_sensitive(spark: SparkSession, d: str) -> DataFrame:
    """Listed words in documents."""
    return tagging.mentions(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "sensitive_words"), "word").distinct()


@query(f"with {_RULES}, t as (select distinct qa_index, unnest(question_fine_cut) as keyword from qa) select qa_index, scenario, list_sort(list(distinct name)) as names from t join rules using (keyword) group by all")
def q_tag_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "scenario string, name string, keyword string")
    return tagging.tags(_qa(spark, d), "qa_index", "question_fine_cut", rules)


@query(f"""with {_ALIAS}, t as (select qa_index, question, regexp_replace(lower(question), '[^0-9a-z\\x{{00e0}}-\\x{{024f}}\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') as s, exists (select 1 from sensitive_words w where w.word <> '' and contains(question, w.word)) as bad, exists (select 1 from al where contains(question, mention)) as known from qa where not regexp_matches(coalesce(question, ''), '[\\x{{ff01}}-\\x{{ff5e}}\\x{{3000}}]') or true)
select qa_index, case when question is null or trim(question) = '' then 'chitchat' when bad then 'sensitive' when known then 'pet_qa' when s = '' or regexp_matches(s, '^[0-9a-z]+$') or not regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}]') then 'chitchat' else 'unknown' end as intent from t""")
def q_intent(spark: SparkSession, d: str) -> DataFrame:
    """Rule cascade; the flags come from two dictionary joins."""
    qa = _qa(spark, d)
    bad = tagging.mentions(qa, "qa_index", "question", table(spark, d, "sensitive_words"), "word").select("qa_index").distinct().withColumn("bad", F.lit(True))
    known = tagging.mentions(qa, "qa_index", "question", tagging.aliases(table(spark, d, "entity_alias")), "mention").select("qa_index").distinct().withColumn("known", F.lit(True))
    j = qa.select("qa_index", "question").join(bad, "qa_index", "left").join(known, "qa_index", "left")
    return j.select("qa_index", tagging.intent(F.col("question"), F.coalesce("bad", F.lit(False)), F.coalesce("known", F.lit(False))).alias("intent"))


@query("""with w as (select w as word, count(*) as n from (select unnest(question_fine_cut) as w from qa) where length(w) >= 2 and regexp_full_match(w, '[\\x{4e00}-\\x{9fff}]+') group by w),
p as (select x.word, y.word as candidate, y.n, length(x.word) as k from w x join w y on length(x.word) = length(y.word) and x.word <> y.word and x.n < y.n where len(list_filter(range(1, length(x.word) + 1), lambda i: x.word[i] <> y.word[i])) = 1),
r as (select *, row_number() over (partition by word order by n desc, candidate) as rank from p) select word, candidate, n from r where rank = 1""")
def q_spell_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Best correction of each word: the most frequent word with one other character in one place. Words with a place masked are joined by equality."""
    w = counts.word_counts(_qa(spark, d), "question_fine_cut").where(F.col("word").rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"))
    masked = w.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("_"), F.substring(F.col("word"), i + 1, F.length("word"))))).alias("mask"))
    other = masked.select(F.col("word").alias("candidate"), F.col("n").alias("m"), "mask")
    p = masked.join(other, "mask").where("word <> candidate and n < m")
    best = p.groupBy("word").agg(F.max("m").alias("m"))
    tied = p.join(best.select("word", "m"), ["word", "m"]).groupBy("word", "m").agg(F.min("candidate").alias("candidate"))
    return tied.select("word", "candidate", F.col("m").alias("n"))


@query()
def q_snippets_of_search(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of the best BM25 hit's answer around the query's longest term."""
    hits = q_bm25(spark, d).where("rank = 1")
    terms = _queries(spark, d).select(F.col("qa_index").alias("qid"), F.get(F.sort_array(F.transform(F.filter("question_fine_cut", lambda t: t.isNotNull()), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), False), 0)["t"].alias("term")).where("term is not null")
    return hits.join(terms, "qid").join(_qa(spark, d).select(F.col("qa_index").alias("id"), "answer"), "id").where("answer is not null").select("qid", "id", tx.snippet(F.col("answer"), F.col("term")).alias("snippet"))


@query("with t as (select qa_index, unnest(question_fine_cut) as term from qa), w as (select term, count(*) as n from t where term is not null and trim(term) <> '' group by term), x as (select distinct qa_index, term from t where term is not null and trim(term) <> '') select qa_index, term, round(1 - n / max(n) over (partition by qa_index), 6) as weight from x join w using (term)")
def q_term_weight(spark: SparkSession, d: str) -> DataFrame:
    """How much rarer a query's term is than its commonest."""
    qa = _qa(spark, d)
    w = counts.word_counts(qa, "question_fine_cut")
    x = qa.select("qa_index", F.explode("question_fine_cut").alias("word")).where("word is not null and trim(word) <> ''").distinct()
    return x.join(w, "word").select("qa_index", F.col("word").alias("term"), F.round(1 - F.col("n") / F.max("n").over(W.partitionBy("qa_index")), 6).alias("weight"))
