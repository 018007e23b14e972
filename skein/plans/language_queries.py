"""Queries over readings, spelling, pieces, codes, sequences, maps and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import similarity as sim
from skein.operators import counts, retrieve, suggest
from skein.plans.registry import query
from skein.sources.tables import table

#: Readings of some characters, and sound and shape codes of some.
READINGS = [("犬", "quan"), ("全", "quan"), ("猫", "mao"), ("毛", "mao"), ("症", "zheng"), ("诊", "zhen"), ("炎", "yan"), ("眼", "yan"), ("病", "bing"), ("兵", "bing"), ("血", "xue"), ("雪", "xue"), ("尿", "niao"), ("鸟", "niao"), ("瘦", "shou"), ("嗽", "sou"), ("吐", "tu"), ("兔", "tu"), ("嗝", "ge"), ("隔", "ge")]
CODES = [("犬", "4G02080043A"), ("太", "4E04080043A"), ("大", "4E04080043B"), ("狗", "3F03180027B"), ("猫", "2F01180042C")]
_CODES = "codes(ch, code) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in CODES) + ")"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return counts.word_counts(table(spark, d, "qa"), "question_fine_cut").where(F.col("word").rlike(r"^[\x{4e00}-\x{9fff}]{2,}$"))


@query("""with r(ch, reading) as (values """ + ", ".join(f"('{a}', '{b}')" for a, b in READINGS) + r"""), w as (select distinct w as word from (select unnest(question_fine_cut) as w from qa) where regexp_full_match(w, '[\x{4e00}-\x{9fff}]{2,}')),
c as (select word, i, substring(word, i, 1) as ch from (select word, unnest(range(1, length(word) + 1)) as i from w)) select word, string_agg(coalesce(regexp_replace(regexp_replace(reading, 'ng$', 'n'), '^([zsc])h', '\1'), c.ch), ' ' order by i) as reading from c left join r using (ch) group by word""")
def q_readings(spark: SparkSession, d: str) -> DataFrame:
    return suggest.readings(_words(spark, d), "word", spark.createDataFrame(READINGS, "ch string, reading string"))


@query()
def q_homophones(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the questions that are read alike."""
    chars = table(spark, d, "qa").where("question is not null").select(F.explode(F.array_distinct(F.split("question", ""))).alias("word")).where("word <> ''").distinct()
    return suggest.homophones(chars, "word", spark.createDataFrame(READINGS, "ch string, reading string"))


@query()
def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Best correction of each word from three sources: one other character, the same reading, one edit."""
    from skein.operators.joins import within_edits

    w = _words(spark, d)
    near = within_edits(w, "word", 1)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("candidate")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("candidate"))).withColumn("score", F.lit(0.4))
    same = suggest.homophones(w, "word", spark.createDataFrame(READINGS, "ch string, reading string")).select("word", F.col("other").alias("candidate"), F.lit(0.6).alias("score"))
    return suggest.corrections([("mask", suggest.masked_candidates(w)), ("reading", same), ("edits", both)]).withColumn("score", F.round("score", 6))


@query()
def q_viterbi_words(spark: SparkSession, d: str) -> DataFrame:
    """Unsupervised segmentation: places scored by how often runs of 1 to 4 characters occur."""
    qa = table(spark, d, "qa").where("question is not null and length(question) > 0").select("qa_index", F.col("question").alias("s"))
    g = counts.grams(qa, "s", 4).select("gram", F.ln("n").alias("ln"))
    at = qa.select("qa_index", F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("i", "ch"), "s")
    runs = at.select("qa_index", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.col("i") + 1))).alias("k"), "s").select("qa_index", "i", "k", F.expr("substring(s, i - k + 2, k)").alias("gram"))
    # the exploded rows are estimated by the size of the file, so without the hint they'd be broadcast through the driver
    p = runs.join(g.hint("merge"), "gram").groupBy("qa_index", "i").agg(F.array(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("ln") * (1 + 0.5 * (k - 1)) - 6)), F.lit(-99.0)) for k in range(1, 5)]).alias("p"))
    rows = p.groupBy("qa_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("p"))
    return qa.join(rows.hint("merge"), "qa_index").select("qa_index", suggest.viterbi_words("s", "p").alias("words"))


@query()
def q_word_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Greedy pieces of the Latin words by a vocabulary of frequent runs."""
    names = table(spark, d, "part").where("p_name is not null").select("p_partkey", F.split(F.lower("p_name"), " ").alias("t"))
    g = counts.grams(names.select(F.explode("t").alias("w")).distinct(), "w", 4)
    v = g.where("n > 1 or length(gram) = 1").select(F.explode(F.array("gram", F.concat(F.lit("##"), "gram"))).alias("piece"))
    return suggest.word_pieces(names, "t", v, "piece").select("p_partkey", "pieces")


@query(f"""with {_CODES}, p as (select x.ch as a, y.ch as b, x.code as x, y.code as y from codes x join codes y on x.ch < y.ch), s as (select *, position(upper(substring(x, 11, 1)) in '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1 as sx, position(upper(substring(y, 11, 1)) in '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1 as sy from p)
select a, b, round(0.7 * ({' + '.join(f"{w} * cast(substring(x, {i + 1}, 1) = substring(y, {i + 1}, 1) as int)" for i, w in enumerate(suggest.SOUND))}) + 0.3 * ({' + '.join(f"{w} * cast(substring(x, {i + 5}, 1) = substring(y, {i + 5}, 1) as int)" for i, w in enumerate(suggest.SHAPE[:-1]))} + 0.25 * (1 - abs(sx - sy) / greatest(sx, sy))), 6) as similarity from s""")
def q_tone_shape(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(CODES, "ch string, code string")
    p = c.select(F.col("ch").alias("a"), F.col("code").alias("x")).join(c.select(F.col("ch").alias("b"), F.col("code").alias("y")), F.col("a") < F.col("b"))
    return p.select("a", "b", F.round(suggest.code_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("select source, n, cast(ceil(-n * ln(0.01) / (ln(2) * ln(2))) as bigint) as bits, cast(greatest(round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)), 1) as bigint) as hashes from (select source, count(*) as n from documents where source is not null group by source)")
def q_bloom_size(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    bits, hashes = suggest.bloom_size(F.col("n"), 0.01)
    return n.select("source", "n", bits.cast("long").alias("bits"), hashes.alias("hashes"))


@query("select qa_index, list_resize(list_filter(coalesce(question_fine_cut, []), lambda t: t is not null)[1:8], 8, '[PAD]') as padded, cast(least(len(list_filter(coalesce(question_fine_cut, []), lambda t: t is not null)), 8) as int) as used from qa")
def q_pad(spark: SparkSession, d: str) -> DataFrame:
    """Sequences cut and padded to one length, with the number of real entries."""
    a = F.slice(F.filter(F.coalesce("question_fine_cut", F.array().cast("array<string>")), lambda t: t.isNotNull()), 1, 8)
    return table(spark, d, "qa").select("qa_index", a.alias("a")).select("qa_index", F.concat("a", F.array_repeat(F.lit("[PAD]"), 8 - F.size("a"))).alias("padded"), F.size("a").alias("used"))


@query("select qa_index, list_concat(['[CLS]'], string_split(question, ''), ['[SEP]'], string_split(answer, ''), ['[SEP]']) as sequence, cast(3 + length(question) + length(answer) as int) as n from qa where length(question) > 0 and length(answer) > 0")
def q_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer as one marked sequence of characters."""
    rows = table(spark, d, "qa").where("length(question) > 0 and length(answer) > 0")
    sep = F.array(F.lit("[SEP]"))
    seq = F.concat(F.array(F.lit("[CLS]")), F.split("question", ""), sep, F.split("answer", ""), sep)
    return rows.select("qa_index", F.filter(seq, lambda c: c != "").alias("sequence")).select("qa_index", "sequence", F.size("sequence").alias("n"))


@query("select name from (select distinct name from entity_alias where name is not null) x where not exists (select 1 from (select distinct name from entity_alias where name is not null) y where y.name <> x.name and starts_with(y.name, x.name))")
def q_prefix_sieve(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin no longer name: a name's proper prefixes are joined by equality."""
    n = table(spark, d, "entity_alias").where("name is not null").select("name").distinct()
    short = n.where("length(name) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", F.lit(1), i))).alias("name")).distinct()
    return n.join(short, "name", "left_anti")


@query("select qa_index, list_sort(list_distinct(list_concat(string_split(coalesce(tag_species, ''), '|'), string_split(coalesce(tag_sex, ''), '|'), string_split(coalesce(tag_age, ''), '|')))) as tags from qa")
def q_tags_union(spark: SparkSession, d: str) -> DataFrame:
    """Tags of several columns, flattened, once each."""
    part = lambda c: F.split(F.coalesce(c, F.lit("")), r"\|")
    return table(spark, d, "qa").select("qa_index", F.array_sort(F.array_distinct(F.flatten(F.array(*[part(c) for c in ("tag_species", "tag_sex", "tag_age")])))).alias("tags"))


@query("select coalesce(b.name, a.name) as name, coalesce(b.v, a.v) as v from (select disease as name, max(weight) as v from symptom_relation where disease is not null group by 1) a full join (select symptom as name, max(weight) as v from symptom_relation where symptom is not null group by 1) b on a.name = b.name")
def q_map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two maps merged; the right one wins."""
    r = table(spark, d, "symptom_relation")
    side = lambda c: r.where(f"{c} is not null").groupBy(F.col(c).alias("name")).agg(F.max("weight").alias("v"))
    a, b = side("disease"), side("symptom").withColumnRenamed("v", "w")
    return a.join(b, "name", "full_outer").select("name", F.coalesce("w", "v").alias("v"))


@query("""with t as (select disease, symptom from (select distinct disease, symptom from symptom_relation where disease is not null and symptom is not null)) select a.disease, a.symptom as first, b.symptom as second from t a join t b on a.disease = b.disease and a.symptom < b.symptom""")
def q_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of a disease's symptoms, made inside the disease's sorted list."""
    g = table(spark, d, "symptom_relation").where("disease is not null and symptom is not null").groupBy("disease").agg(F.array_sort(F.collect_set("symptom")).alias("a"))
    pairs = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice("a", i + 2, F.size("a")), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return g.select("disease", F.inline(pairs))


@query("""with q as (select qa_index as qid, question, list_distinct(list_filter(question_fine_cut, lambda t: t is not null and length(t) > 1)) as t from qa where qa_index % 20 = 0 and question_fine_cut is not null),
h as (select qid, b.qa_index as id, len(list_filter(q.t, lambda x: contains(b.question, x))) as hits, len(q.t) as n from q join qa b on b.disease_name = (select disease_name from qa z where z.qa_index = qid) where b.question is not null)
select qid, id, hits, case when hits > 0 then 1.0::double else 0.0::double end as proximity, round(hits / nullif(n, 0) * 20, 6) as rescored from h""")
def q_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Rescoring of questions on the same disease by the query's terms they hold."""
    qa = table(spark, d, "qa")
    q = qa.where("qa_index % 20 = 0 and question_fine_cut is not null").select(F.col("qa_index").alias("qid"), "disease_name", F.array_distinct(F.filter("question_fine_cut", lambda t: t.isNotNull() & (F.length(t) > 1))).alias("t"))
    j = retrieve.held_terms(qa, "qa_index", "question", q, "qid", "t", "disease_name")
    return j.select("qid", "id", "hits", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("proximity"), F.round(F.try_divide("hits", "n") * 20, 6).alias("rescored"))


@query()
def q_path_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best path for a question that names a disease: similarity of question and path, and the number of answers."""
    from skein.plans.feature_queries import q_graph_one_hop

    paths = q_graph_one_hop(spark, d).select(F.col("start").alias("disease_name"), "path", F.size(F.split("answers", "\t")).alias("n"))
    j = table(spark, d, "qa").where("question is not null").select("qa_index", "question", "disease_name").join(F.broadcast(paths), "disease_name")
    return retrieve.top(j.select(F.col("qa_index").alias("qid"), F.col("path").alias("id"), (sim.quick_ratio(F.col("question"), F.col("path")) + F.log1p("n") / 10).alias("score")), 1).select("qid", "id", F.round("score", 6).alias("score"))


@query()
def q_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Synonym candidates with their method: words of similar neighbours, and names and aliases whose characters have a Jaccard similarity of 0.5 or more."""
    net = counts.network_similarity(counts.cooccurrence(table(spark, d, "qa"), "question_rough_cut")).select("x", "y", "similarity", F.lit("network").alias("method"))
    from skein.operators.joins import sharing
    from skein.plans.text_queries import names_and_aliases

    p = sharing(names_and_aliases(spark, d), "name", 0.5).select(F.col("a").alias("x"), F.col("b").alias("y"), sim.jaccard(F.col("a"), F.col("b")).alias("similarity"), F.lit("characters").alias("method")).where("similarity >= 0.5")
    return net.unionByName(p).withColumn("similarity", F.round("similarity", 6))


_SPARQL = ["select ?x where { <犬瘟热> <症状> ?x . }", "select ?x where { ?x <症状> <发热> . }", "select ?y where { <猫> <疾病> ?x . ?x <症状> ?y . }", "select ?x where { <猫> <疾病> ?x . <犬> <疾病> ?x . }"]


@query()
def q_query_templates(spark: SparkSession, d: str) -> DataFrame:
    """Entities and template of graph queries."""
    e, t = suggest.template_of(F.col("q"))
    return spark.createDataFrame([(q,) for q in _SPARQL], "q string").select("q", e.alias("entities"), t.alias("template"))


@query(r"""with p(page, html) as (values (1, '<html><title>金毛犬</title><meta name="description" content="大型犬，俗称黄金猎犬。"></html>'), (2, '<title></title>')) select page, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, 'name="description" content="([^"]*)"', 1) as description, regexp_extract(html, '俗称([^，。"]*)', 1) as alias from p""")
def q_html_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title, description and alias of crawled pages."""
    pages = spark.createDataFrame([(1, '<html><title>金毛犬</title><meta name="description" content="大型犬，俗称黄金猎犬。"></html>'), (2, "<title></title>")], "page int, html string")
    x = lambda p: F.regexp_extract("html", p, 1)
    return pages.select("page", x("<title>([^<]*)</title>").alias("title"), x('name="description" content="([^"]*)"').alias("description"), x('俗称([^，。"]*)').alias("alias"))
