"""Search assembly, answering over the graph, tagging and corpus building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.operators import counts, graph, models, retrieve, suggest, tagging
from skein.plans import feature_queries as fq
from skein.plans import language_queries as lq
from skein.plans import retrieval_queries as rq
from skein.plans.registry import query
from skein.sources.tables import table

_FINE = f"""{rq._POST.format(c='question_fine_cut')}, {rq._QUERIES}, q as (select qid, unnest(t) as term from queries), df as (select term, count(*) as df from post group by term),
s as (select qid, id, {rq._BM} as score from post join q using (term) join df using (term), st group by qid, id)"""
_TOP = "r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s), hits as (select qid, id, score, rank from r where rank <= 10)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa")
    return retrieve.bm25(qa, "qa_index", "question_fine_cut", qa.where("qa_index % 20 = 0"), "qa_index", "question_fine_cut")


# ---- search assembly


@query(f"""with {_FINE}, e as (select a.qa_index as qid, b.qa_index as id, 1.0 as score from qa a join qa b on a.question = b.question and a.qa_index % 20 = 0 and a.question <> ''),
p as (select qid, id, count(*)::double as score from post join q using (term) group by qid, id),
u as (select 'best' as mode, qid, id, score + 2 as score from e union all select 'well', qid, id, score from s union all select 'part', qid, id, score from p),
o as (select *, row_number() over (partition by mode, qid order by round(score, 9) desc, id) as rank from u) select mode, qid, id, round(score, 6) as score, cast(rank as int) as rank from o where rank <= 10""")
def q_modes(spark: SparkSession, d: str) -> DataFrame:
    """The three modes of search, each with its own score and limit: the same question (two points more), BM25, common terms."""
    qa = table(spark, d, "qa")
    rows = retrieve.by_mode(qa, "qa_index", "question", "question_fine_cut", qa.where("qa_index % 20 = 0"), ("best", "well", "part"))
    return rows.select("mode", "qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_FINE}, {_TOP}, j as (select h.*, a.question as x, b.question as y from hits h join qa a on a.qa_index = qid join qa b on b.qa_index = id where a.question <> '' and b.question <> ''),
c as (select *, list_distinct(string_split(x, '')) as cx, list_distinct(string_split(y, '')) as cy from j)
select qid, id, round(score + len(list_intersect(cx, cy)) / len(list_distinct(list_concat(cx, cy))) + 2.0 * list_sum(list_transform(cx, lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / (length(x) + length(y)), 6) as score from c""")
def q_combined(spark: SparkSession, d: str) -> DataFrame:
    """Hits re-ranked by the sum of their score and several named similarities of the questions."""
    side = lambda k, n: table(spark, d, "qa").where("question <> ''").select(F.col("qa_index").alias(k), F.col("question").alias(n))
    j = _hits(spark, d).join(side("qid", "x"), "qid").join(side("id", "y"), "id")
    return j.select("qid", "id", F.round(F.col("score") + sum((sim.lexical(n, F.col("x"), F.col("y")) for n in ("jaccard", "quick")), F.lit(0.0)), 6).alias("score"))


@query(f"with {_FINE}, {_TOP}, l as (select qid, list(round(score, 6) order by rank) as l from hits group by qid) select qid, round(list_reduce(l, lambda a, x: (a + x) / 2), 6) as average from l")
def q_running_average(spark: SparkSession, d: str) -> DataFrame:
    """The running average of a query's scores, each new one with half the weight."""
    lists = _hits(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 6).alias("s")))).alias("l"))
    return lists.select("qid", F.round(F.aggregate(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), F.element_at("l", 1)["s"], lambda a, x: (a + x["s"]) / 2), 6).alias("average"))


@query(f"with {_FINE}, {_TOP} select qid, id, cast(rank as int) as rank from hits where id not in (select qa_index from qa where answer is null or trim(answer) = '') and id <> qid")
def q_without_invalid(spark: SparkSession, d: str) -> DataFrame:
    """Hits without documents that have no answer, and without the query itself."""
    bad = table(spark, d, "qa").where("answer is null or trim(answer) = ''").select(F.col("qa_index").alias("id"))
    return retrieve.without(_hits(spark, d), bad).where("id <> qid").select("qid", "id", "rank")


@query("""with q as (select vec_id as qid, embedding::double[] as q from embeddings where vec_id % 20 = 0), s as (select qid, vec_id as id, list_cosine_similarity(q, embedding::double[]) as score from q, embeddings),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from s) select qid, id, round(1 - score, 5) + 0.0 as distance, round(score / 0.05, 4) as scaled from r where rank <= 10 and 1 - score < 0.7""")
def q_within_distance(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours below a distance, with the scaled product of the normalised vectors."""
    e = table(spark, d, "embeddings")
    r = retrieve.nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return r.where("1 - score < 0.7").select("qid", "id", (F.round(1 - F.col("score"), 5) + 0.0).alias("distance"), F.round(F.col("score") / 0.05, 4).alias("scaled"))


@query("""with q as (select * from qa where qa_index % 20 = 0), p as (select qa_index, 'raw' as type, question as query, 1 as n from q union all select qa_index, 'fine', array_to_string(list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> ''), ' '), len(list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> '')) from q
union all select qa_index, 'rough', array_to_string(list_filter(question_rough_cut, lambda t: t is not null and trim(t) <> ''), ' '), len(list_filter(question_rough_cut, lambda t: t is not null and trim(t) <> '')) from q)
select type, query, min(qa_index) as first, cast(max(n) as int) as terms from p where query is not null and query <> '' group by type, query""")
def q_primitives(spark: SparkSession, d: str) -> DataFrame:
    """Queries taken apart into primitives, each (query, type) once."""
    return retrieve.primitives(table(spark, d, "qa").where("qa_index % 20 = 0"), "qa_index", "question", {"fine": "question_fine_cut", "rough": "question_rough_cut"})


@query(f"with {rq._POST.format(c='question_fine_cut')}, df as (select term, count(*) as df from post group by term) select id, term, tf::int as tf, df::int as df from post join df using (term) where id % 20 = 0")
def q_term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Term vectors of the stated documents: frequencies there and in the collection."""
    p = retrieve.postings(table(spark, d, "qa"), "qa_index", "question_fine_cut")
    return p.where("id % 20 = 0").join(p.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("id", "term", F.col("tf").cast("int").alias("tf"), F.col("df").cast("int").alias("df"))


@query("select lower(word) as word, cast(length(word) as int) as n, count(*) as copies from sensitive_words where word is not null group by all")
def q_relational(spark: SparkSession, d: str) -> DataFrame:
    """A relational source by SQL text."""
    return spark.sql("select lower(word) as word, length(word) as n, count(*) as copies from {words} where word is not null group by all", words=table(spark, d, "sensitive_words"))


@query("""with p as (select d.doc_id, l.toxic as y, cast(exists (select 1 from sensitive_words w where w.word <> '' and contains(d.text, w.word)) as int) as p from documents d join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id) where d.text is not null and l.toxic is not null),
c as (select k, count(*) filter (where y = k and p = k) as tp, count(*) filter (where p = k) as pp, count(*) filter (where y = k) as pos from p, (values (0), (1)) v(k) group by k), m as (select k, tp, pos, coalesce(tp / nullif(pp, 0), 0.0) as pr, coalesce(tp / nullif(pos, 0), 0.0) as re from c)
select round(sum(tp) / sum(pos), 6) as accuracy, round(avg(pr), 6) as precision, round(avg(re), 6) as recall, round(sum(pos * case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end) / sum(pos), 6) as weighted_f1 from m""")
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, macro precision and recall, weighted F1 of the word list against the labels."""
    docs = table(spark, d, "documents").where("text is not null")
    hit = tagging.mentions(docs, "doc_id", "text", table(spark, d, "sensitive_words"), "word").select("doc_id").distinct().withColumn("p", F.lit(1))
    y = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y is not null")
    return models.classification_metrics(docs.select("doc_id").join(y, "doc_id").join(hit, "doc_id", "left").fillna(0, ["p"]), "y", "p", [0, 1])


@query("with a as (select distinct name as x, unnest(alias) as y from entity_alias where name is not null), c as (select x, y, list_distinct(string_split(x, '')) as cx, list_distinct(string_split(y, '')) as cy from a where y is not null and y <> '') select x, y, round(len(list_intersect(cx, cy)) / len(list_distinct(list_concat(cx, cy))), 6) as jaccard, round(2.0 * list_sum(list_transform(cx, lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / (length(x) + length(y)), 6) as quick from c")
def q_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Similarities chosen by name."""
    a = table(spark, d, "entity_alias").where("name is not null").select(F.col("name").alias("x"), F.explode("alias").alias("y")).where("y <> ''").distinct()
    return a.select("x", "y", *[F.round(sim.lexical(n, F.col("x"), F.col("y")), 6).alias(n) for n in ("jaccard", "quick")])


@query()
def q_reading_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Words whose readings are one edit apart, with the similarity of signs (four fifths) and readings (one fifth)."""
    return suggest.reading_candidates(lq._words(spark, d), "word", spark.createDataFrame(lq.READINGS, "ch string, reading string"), 1)


_SUSPECTS = """b as (select w1, w2, count(*) as n from (select unnest(list_transform(range(1, len(w)), lambda i: w[i])) as w1, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) as w2 from (select list_concat(['<SOS>'], list_filter(question_fine_cut, lambda t: t is not null), ['<EOS>']) as w from qa where question_fine_cut is not null)) group by all having count(*) >= 2),
t as (select qa_index as id, list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> '') as t from qa where question_fine_cut is not null), r as (select id, unnest(t) as word, unnest(range(1, len(t) + 1)) as pos, t from t),
x as (select id, pos, word, case when pos = 1 then '<SOS>' else t[pos - 1] end as l, coalesce(t[pos + 1], '<EOS>') as r, cast(length(array_to_string(t[1:pos - 1], '')) as int) as begin from r), k as (select distinct name as word from entity_alias where name is not null union select distinct symptom from symptom_relation where symptom is not null),
m as (select id, pos, begin, begin + length(x.word) as fin, x.word, case when b1.n is null then 0.6 else 0.0 end + case when b2.n is null then 0.4 else 0.0 end + case when k.word is null then 0.8 * length(x.word) else 0.0 end as score from x left join b b1 on b1.w1 = l and b1.w2 = x.word left join b b2 on b2.w1 = x.word and b2.w2 = x.r left join k on k.word = x.word)"""


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa")
    words = table(spark, d, "entity_alias").select(F.col("name").alias("w")).unionByName(table(spark, d, "symptom_relation").select(F.col("symptom").alias("w")))
    return suggest.suspects(qa, "qa_index", "question_fine_cut", counts.bigrams(qa, "question_fine_cut"), words, "w")


@query(f"with {_SUSPECTS} select id as qa_index, cast(pos as int) as pos, begin, cast(fin as int) as end_, word, round(score, 6) as score from m")
def q_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Words of the questions with their places and what speaks against them."""
    return _suspects(spark, d).select(F.col("id").alias("qa_index"), "pos", "begin", F.col("end").alias("end_"), "word", F.round("score", 6).alias("score"))


@query(f"""with {_SUSPECTS}, w as (select w as word, count(*) as n from (select unnest(question_fine_cut) as w from qa) where length(w) >= 2 and regexp_full_match(w, '[\\x{{4e00}}-\\x{{9fff}}]+') group by w),
c as (select x.word, y.word as candidate, y.n / (x.n + y.n) as s from w x join w y on length(x.word) = length(y.word) and x.word <> y.word where len(list_filter(range(1, length(x.word) + 1), lambda i: x.word[i] <> y.word[i])) = 1),
o as (select word, candidate from (select *, row_number() over (partition by word order by round(s, 9) desc, candidate) as r from c where s >= 0.8) where r = 1), j as (select m.*, case when score >= 1.0 then candidate end as c from m left join o using (word))
select id as qa_index, string_agg(coalesce(c, word), '' order by pos) as text, count(c) as changed from j group by id""")
def q_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their suspect words replaced by the best candidate of one other character that is at least four times as frequent."""
    best = suggest.corrections([("mask", suggest.masked_candidates(lq._words(spark, d)).where("score >= 0.8"))])
    return suggest.corrected(_suspects(spark, d), best, 1.0).select(F.col("id").alias("qa_index"), "text", "changed")


# ---- answering over the graph


@query(f"with {fq._EDGES} select name, count(distinct rel) as relations, count(*) as facts from (select src as name, rel, src, dst from edges where dst is not null union select dst, rel, src, dst from edges where dst is not null) group by name")
def q_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_counts(fq.edges(spark, d))


_DISEASES = "s as (select distinct disease as start from symptom_relation where disease is not null)"
_BACK = "(select distinct start, a.rel || '|症状|' || c.rel as path, c.dst as answer from s join edges a on a.src = start join edges b on b.dst = a.dst and b.rel = '症状' and b.src <> start join edges c on c.src = b.src)"


@query(f"with {fq._EDGES}, {_DISEASES} select * from {_BACK}")
def q_graph_hop_back(spark: SparkSession, d: str) -> DataFrame:
    """What shares a symptom with a disease, and where that leads."""
    return graph.hop_back(fq.edges(spark, d), fq._diseases(spark, d), "症状")


@query(f"with {fq._EDGES}, n as (select distinct name from entity_alias where name is not null and upper(type) = 'SYMPTOMS'), e as (select * from edges union all select name, '同名', name from n), s as (select distinct unnest(alias) as start from entity_alias) select distinct start, '别名|' || b.rel || '|' || c.rel as path, c.dst as answer from s join e a on a.dst = start and a.rel = '别名' join e b on b.src = a.src and b.dst = a.src join e c on c.src = a.src and c.dst <> c.src")
def q_graph_named_loop(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of nodes that have an edge to themselves, and what else these nodes lead to."""
    a = table(spark, d, "entity_alias").where("name is not null")
    loops = a.where("upper(type) = 'SYMPTOMS'").select(F.col("name").alias("src"), F.lit("同名").alias("rel"), F.col("name").alias("dst")).distinct()
    starts = a.select(F.explode("alias").alias("name")).where("name is not null").distinct()
    return graph.named_loop(graph.edited(fq.edges(spark, d).where("dst is not null"), add=loops), starts, "别名")


@query(f"""with {fq._EDGES}, {_DISEASES}, u as (select start, '1a' as template, a.rel as path, a.dst as answer from s join edges a on a.src = start union all select start, '2aa', a.rel || '|' || b.rel, b.dst from s join edges a on a.src = start and a.rel <> '别名' join edges b on b.src = a.dst union all select start, '2ab', path, answer from {_BACK})
select * from u where (start, template) in (select (start, template) from u group by start, template having count(*) <= 60)""")
def q_graph_templates(spark: SparkSession, d: str) -> DataFrame:
    """All templates of the diseases; one with more than sixty answers is left out for that disease."""
    e, s = fq.edges(spark, d), fq._diseases(spark, d)
    return graph.templates({"1a": graph.one_hop(e, s), "2aa": graph.two_hops(e, s, ("别名",)), "2ab": graph.hop_back(e, s, "症状")}, 60)


@query(f"with {fq._EDGES}, {_DISEASES}, p as (select distinct start, a.rel || '|' || b.rel as path from s join edges a on a.src = start and a.rel <> '别名' join edges b on b.src = a.dst) select start, path, 'path' as part, path as text from p union all select start, path, 'first', split_part(path, '|', 1) from p union all select start, path, 'second', split_part(path, '|', 2) from p")
def q_path_triples(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_triples(graph.two_hops(fq.edges(spark, d), fq._diseases(spark, d), ("别名",)))


@query(f"with {fq._EDGES}, gone as (select distinct name from entity_alias where upper(type) = 'CAT' and name is not null) select distinct src, rel, dst from (select * from edges where dst is not null union all select 'x', '症状', 'y') where src not in (select name from gone) and dst not in (select name from gone) and not (rel = '症状' and dst = '呕吐')")
def q_graph_edit(spark: SparkSession, d: str) -> DataFrame:
    """Edges after adding one, dropping those to one symptom and removing the vertices of one type."""
    e = fq.edges(spark, d).where("dst is not null")
    gone = table(spark, d, "entity_alias").where("upper(type) = 'CAT' and name is not null").select("name").distinct()
    return graph.edited(e, spark.createDataFrame([("x", "症状", "y")], "src string, rel string, dst string"), e.where("rel = '症状' and dst = '呕吐'"), gone)


_LINKED = f"""{rq._ALIAS}, h as (select distinct qa_index, mention from qa join (select distinct mention from al) on contains(question, mention)), k as (select * from h x where not exists (select 1 from h y where y.qa_index = x.qa_index and y.mention <> x.mention and contains(y.mention, x.mention))), ln as (select distinct qa_index, name, type from k join al using (mention))"""


@query(f"""with {_LINKED}, j as (select qa_index, question as q, name as e from ln join qa using (qa_index)), c as (select *, list_distinct(string_split(q, '')) as cq, list_distinct(string_split(e, '')) as ce from j)
select qa_index, e as entity, cast(length(q) as int) as query_length, cast(length(e) as int) as entity_length, contains(q, e) as contained, cast(position(e in q) - 1 as int) as begin, cast(case when contains(q, e) then length(q) - length(e) - position(e in q) + 1 end as int) as behind, round(len(list_intersect(cq, ce)) / len(ce), 6) as share from c""")
def q_entity_features(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of question and linked entity with the features by which they're ranked."""
    j = rq.q_entity_link(spark, d).select("qa_index", "entity").join(table(spark, d, "qa").select("qa_index", "question"), "qa_index")
    return tagging.match_features(j, "question", "entity").select("qa_index", "entity", "query_length", "entity_length", "contained", "begin", "behind", F.round("share", 6).alias("share"))


@query(f"""with {_LINKED}, {fq._EDGES}, a as (select qa_index, name as entity from ln join qa using (qa_index) where regexp_matches(question, '是什么|怎么办|怎么样')) select qa_index, entity, string_agg(distinct rel || '：' || dst, '；' order by rel || '：' || dst) as details from a join edges on src = entity where dst is not null group by all""")
def q_details(spark: SparkSession, d: str) -> DataFrame:
    """Open questions are answered by all facts on their entity, as one made-up row."""
    asked = table(spark, d, "qa").where(F.col("question").rlike("是什么|怎么办|怎么样")).select("qa_index")
    j = rq.q_entity_link(spark, d).select("qa_index", "entity").join(asked, "qa_index")
    facts = fq.edges(spark, d).where("dst is not null").groupBy(F.col("src").alias("entity")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("rel", F.lit("："), "dst"))), "；").alias("details"))
    return j.join(facts, "entity").select("qa_index", "entity", "details")


@query(f"with {_LINKED}, {fq._EDGES}, t as (select qa_index, name, type, row_number() over (partition by qa_index order by case type when 'DISEASE' then 2 when 'SYMPTOMS' then 1 else 0 end desc, name, type) as r from ln), w as (select qa_index, name, case when regexp_matches(question, '症状|表现') then '症状' else '别名' end as rel from t join qa using (qa_index) where r = 1) select qa_index, name as entity, w.rel as path, string_agg(distinct dst, chr(9) order by dst) as answers from w join edges e on e.src = name and e.rel = w.rel where dst is not null group by all")
def q_graph_answers(spark: SparkSession, d: str) -> DataFrame:
    """End to end over the graph: entities, the best one, the relation asked about, its answers."""
    top = rq.q_entity_link(spark, d).where("rank = 1").join(table(spark, d, "qa").select("qa_index", "question"), "qa_index")
    wanted = top.select("qa_index", F.col("entity").alias("start"), F.when(F.col("question").rlike("症状|表现"), "症状").otherwise("别名").alias("path"))
    answers = graph.grouped_paths(graph.one_hop(fq.edges(spark, d).where("dst is not null"), wanted.select(F.col("start").alias("name")).distinct()))
    return wanted.join(answers, ["start", "path"]).select("qa_index", F.col("start").alias("entity"), "path", "answers")


# ---- tagging and corpus

_SCENARIOS = ("PART", "AGE", "HEALTHY", "FOOD")


@query(f"with {rq._RULES}, t as (select distinct qa_index, unnest(question_fine_cut) as keyword from qa), g as (select qa_index, scenario, name from t join rules using (keyword)) select qa.qa_index, " + ", ".join(f"coalesce(string_agg(distinct case when scenario = '{s}' then name end, '|' order by case when scenario = '{s}' then name end), '') as {s.lower()}" for s in _SCENARIOS) + " from qa left join g using (qa_index) group by qa.qa_index")
def q_retag(spark: SparkSession, d: str) -> DataFrame:
    """The whole corpus tagged anew: one joined list of labels per scenario."""
    rules = spark.createDataFrame(rq.RULES, "scenario string, name string, keyword string")
    qa = table(spark, d, "qa")
    t = tagging.tag_columns(tagging.tags(qa, "qa_index", "question_fine_cut", rules), "qa_index", list(_SCENARIOS))
    return qa.select("qa_index").join(t, "qa_index", "left").select("qa_index", *[F.coalesce(F.array_join(s, "|"), F.lit("")).alias(s.lower()) for s in _SCENARIOS])


@query(r"""with l as (select 'question' as source, question as line from qa union all select 'answer', unnest(string_split(answer, chr(10))) from qa union all select 'document', unnest(string_split(text, chr(10))) from documents), c as (select source, trim(line, ' ' || chr(9) || chr(13)) as line from l where line is not null)
select line, count(*) as copies, string_agg(distinct source, '|' order by source) as sources from c where line <> '' group by line""")
def q_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus of all sources, each line once with its number of copies and its sources."""
    qa, docs = table(spark, d, "qa"), table(spark, d, "documents")
    parts = [qa.select(F.lit("question").alias("source"), F.col("question").alias("line")), qa.select(F.lit("answer").alias("source"), F.explode(F.split("answer", "\n")).alias("line")), docs.select(F.lit("document").alias("source"), F.explode(F.split("text", "\n")).alias("line"))]
    return tx.corpus(parts)


@query()
def q_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risk of each frequent disease for each visit, by one model per disease with over a hundred visits."""
    v = table(spark, d, "visits").where("id is not null").dropDuplicates(["id"])
    flags = fq.q_flags(spark, d).select("id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("weight_class", "town_class", "adult", "old")])
    return models.risks(flags, v.select("id", F.col("symptom_level3").alias("disease")), "id", ["weight_class", "town_class", "adult", "old"], over=100)
