"""Queries over counts: words, n-grams, windows, co-occurrence, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.functions import similarity as sim
from skein.operators import counts, vectors
from skein.plans.registry import query
from skein.sources.tables import table

_WORDS = "words as (select w as word, count(*) as n from (select unnest(question_fine_cut) as w from qa) where w is not null and trim(w) <> '' group by w)"
_BI = """pad as (select qa_index, list_concat(['<SOS>'], list_filter(question_fine_cut, lambda t: t is not null), ['<EOS>']) as a from qa where question_fine_cut is not null),
pos as (select qa_index, a, unnest(range(1, len(a))) as i from pad), pairs as (select qa_index, a[i] as w1, a[i + 1] as w2 from pos), bi as (select w1, w2, count(*) as n from pairs group by all)"""
_GRAMS = """t as (select distinct p_name as s from part where p_name is not null), g as (select substring(s, i, k) as gram from (select s, k, unnest(range(1, length(s) - k + 2)) as i from (select s, unnest(range(1, 5)) as k from t) where length(s) >= k)),
c as (select gram, count(*) as n, length(gram) as k from g group by gram)"""


@query(f"with {_WORDS} select word, n from words")
def q_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.word_counts(table(spark, d, "qa"), "question_fine_cut")


@query(f"with {_WORDS} select word, n from words where n >= 5 order by n desc, word limit 50")
def q_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the top list: most frequent terms."""
    return counts.word_counts(table(spark, d, "qa"), "question_fine_cut", 5).orderBy(F.desc("n"), "word").limit(50)


@query(f"with {_WORDS} select word, n, row_number() over (order by n desc, word) - 1 as id, round(0.001 / (0.001 + n / (select sum(n) from words)), 6) as weight from words where n >= 2")
def q_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids by frequency and smooth inverse frequency weights.

    Ids are dense without sorting in one task: words are range-partitioned, and each partition's offset is a prefix sum.
    """
    from skein.operators.windows import dense_ids

    words = counts.word_counts(table(spark, d, "qa"), "question_fine_cut")
    total = words.agg(F.sum("n").alias("total"))
    numbered = dense_ids(words.where("n >= 2"), [F.desc("n"), F.asc("word")], "id")
    return numbered.join(F.broadcast(total)).select("word", "n", "id", F.round(counts.sif_weight(F.col("n"), F.col("total")), 6).alias("weight"))


@query(f"with {_BI} select w1, w2, n from bi")
def q_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return counts.bigrams(table(spark, d, "qa"), "question_fine_cut")


@query(f"with {_BI} select cast(sum(n) as bigint) as total, round(avg(n), 6) as mean, round(var_pop(n), 6) as variance from bi")
def q_bigram_totals(spark: SparkSession, d: str) -> DataFrame:
    return counts.bigrams(table(spark, d, "qa"), "question_fine_cut").agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 6).alias("variance"))


@query(f"with {_BI}, u as (select w1, cast(sum(n) as bigint) as n1 from bi group by w1), p as (select qa_index, ln(bi.n / n1) as lp from pairs join bi using (w1, w2) join u using (w1)) select qa_index, round(sum(lp), 4) as log_probability, round(exp(-avg(lp)), 4) as perplexity from p group by qa_index")
def q_perplexity(spark: SparkSession, d: str) -> DataFrame:
    s = counts.sentence_probability(table(spark, d, "qa"), "qa_index", "question_fine_cut")
    return s.select("qa_index", F.round("log_probability", 4).alias("log_probability"), F.round("perplexity", 4).alias("perplexity"))


@query(f"with {_GRAMS} select gram, n from c")
def q_char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return counts.grams(table(spark, d, "part").select("p_name").distinct(), "p_name", 4)


@query(f"""with {_GRAMS}, s as (select k, sum(n) as total from c group by k), p as (select gram, n, k, n / total as p from c join s using (k)),
x as (select gram, n, p, substring(gram, 1, i) as l, substring(gram, i + 1) as r from (select *, unnest(range(1, k)) as i from p where k > 1))
select x.gram, x.n, round(min(log10(x.p / (a.p * b.p))), 6) as pmi from x join p a on a.gram = x.l join p b on b.gram = x.r group by x.gram, x.n""")
def q_pmi(spark: SparkSession, d: str) -> DataFrame:
    return counts.pointwise_information(counts.grams(table(spark, d, "part").select("p_name").distinct(), "p_name", 4)).withColumn("pmi", F.round("pmi", 6))


@query(f"""with {_GRAMS}, e as (select substring(gram, 1, k - 1) as gram, n from c where k > 1), tt as (select gram, sum(n) as total from e group by gram)
select gram, round(sum(-n / total * log10(n / total)), 6) + 0 as entropy from e join tt using (gram) group by gram""")
def q_branching_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = counts.branching_entropy(counts.grams(table(spark, d, "part").select("p_name").distinct(), "p_name", 4), "right")
    return e.withColumn("entropy", F.round("entropy", 6) + 0)


@query()
def q_new_words(spark: SparkSession, d: str) -> DataFrame:
    """Word candidates from the questions."""
    return counts.new_words(table(spark, d, "qa"), "question").select("gram", "n", F.round("score", 4).alias("score"))


_CO = """w as (select qa_index, list_filter(question_rough_cut, lambda t: t is not null and trim(t) <> '') as w from qa), p as (select qa_index, w, unnest(range(1, len(w) + 1)) as i from w),
e as (select least(x.w[x.i], y.w[y.i]) as a, greatest(x.w[x.i], y.w[y.i]) as b, 3 - (y.i - x.i) + 1 as v from p x join p y on x.qa_index = y.qa_index and y.i - x.i between 1 and 3),
edges as (select a, b, cast(sum(v) * 2 as bigint) as weight from e group by a, b)"""


@query(f"with {_CO} select a, b, weight from edges")
def q_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return counts.cooccurrence(table(spark, d, "qa"), "question_rough_cut")


@query(f"""with {_CO}, both_ as (select a, b, weight from edges where a <> b union all select b, a, weight from edges where a <> b), g as (select a, count(*) as d, sum(weight) as w from both_ group by a),
c as (select l.a as x, r.a as y, count(*) as c, sum(l.weight) as cx, sum(r.weight) as cy from both_ l join both_ r on l.b = r.b and l.a < r.a group by all)
select x, y, round(c / (gx.d + gy.d - c) * (cx / gx.w) * (cy / gy.w), 6) as similarity from c join g gx on gx.a = x join g gy on gy.a = y where c / (gx.d + gy.d - c) * (cx / gx.w) * (cy / gy.w) > 0.25""")
def q_network_similarity(spark: SparkSession, d: str) -> DataFrame:
    return counts.network_similarity(counts.cooccurrence(table(spark, d, "qa"), "question_rough_cut")).withColumn("similarity", F.round("similarity", 6))


@query("select qa_index, pos, token, cast(b - length(token) as bigint) as begin_at, cast(b as bigint) as end_at, coalesce(p, '<SOS>') as previous, coalesce(nx, '<EOS>') as following from (select qa_index, pos, token, sum(length(token)) over w as b, lag(token) over w as p, lead(token) over w as nx from (select qa_index, unnest(list_filter(question_fine_cut, lambda t: t is not null)) as token, unnest(range(len(list_filter(question_fine_cut, lambda t: t is not null)))) as pos from qa) window w as (partition by qa_index order by pos))")
def q_token_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Each token's place in characters and its neighbours, computed inside the record's array: no shuffle."""
    a = table(spark, d, "qa").select("qa_index", F.filter("question_fine_cut", lambda t: t.isNotNull()).alias("a"))
    ends = F.transform(F.sequence(F.lit(1), F.size("a")), lambda i: F.length(F.array_join(F.slice("a", F.lit(1), i), "")).cast("long"))
    at = a.where("size(a) > 0").withColumn("e", ends).select("qa_index", "a", "e", F.posexplode("a").alias("pos", "token"))
    end = F.element_at("e", F.col("pos") + 1)
    return at.select("qa_index", F.col("pos").cast("long").alias("pos"), "token", (end - F.length("token")).alias("begin_at"), end.alias("end_at"),
        F.when(F.col("pos") > 0, F.try_element_at("a", F.greatest("pos", F.lit(1)))).otherwise("<SOS>").alias("previous"), F.coalesce(F.try_element_at("a", F.col("pos") + 2), F.lit("<EOS>")).alias("following"))


@query("""with p as (select disease, symptom, weight, sum(weight) over (partition by disease) as total from (select disease, symptom, max(weight) as weight from symptom_relation where weight is not null group by all)),
c as (select *, sum(weight / total) over (partition by disease order by weight desc, symptom rows between unbounded preceding and 1 preceding) as before from p) select disease, symptom, round(weight / total, 6) as share from c where coalesce(before, 0) < 0.7""")
def q_nucleus(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest symptoms of a disease up to a cumulative share, with the first above it."""
    r = table(spark, d, "symptom_relation").where("weight is not null").groupBy("disease", "symptom").agg(F.max("weight").alias("weight"))
    r = r.withColumn("p", F.col("weight") / F.sum("weight").over(W.partitionBy("disease")))
    before = F.sum("p").over(W.partitionBy("disease").orderBy(F.desc("weight"), "symptom").rowsBetween(W.unboundedPreceding, -1))
    return r.withColumn("before", before).where(F.coalesce("before", F.lit(0.0)) < 0.7).select("disease", "symptom", F.round("p", 6).alias("share"))


@query("select user_id, event_id, cast(count(*) over w as bigint) as around, round(sum(value) over w, 4) as total from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)")
def q_frames(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("around"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as low, max(value) as high, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("select round(avg(n), 6) as mean, median(n) as median, max(n) as longest from (select len(question_fine_cut) as n from qa where question_fine_cut is not null)")
def q_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "qa").where("question_fine_cut is not null").select(F.size("question_fine_cut").cast("long").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("longest"))


@query("""with p as (select toxic as label, case when quality <= 2 then 1 else 0 end as predicted from labels where quality is not null and toxic is not null), c as (select unnest([0, 1]) as class),
m as (select class, count(*) filter (label = class and predicted = class) as tp, count(*) filter (label <> class and predicted = class) as fp, count(*) filter (label = class and predicted <> class) as fn from p, c group by class)
select class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision_, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall_, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from m""")
def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Per-class precision, recall and F1 of a rule, from one small confusion table."""
    p = table(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("toxic").alias("label"), (F.col("quality") <= 2).cast("int").alias("predicted"))
    m = p.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    hit, guess = F.col("label") == F.col("class"), F.col("predicted") == F.col("class")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    m = m.groupBy("class").agg(some(hit & guess).alias("tp"), some(~hit & guess).alias("fp"), some(hit & ~guess).alias("fn"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return m.select("class", "tp", "fp", "fn", r(F.col("tp"), F.expr("tp + fp")).alias("precision_"), r(F.col("tp"), F.expr("tp + fn")).alias("recall_"), r(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")).alias("f1"))


@query("with r as (select avg(rx) over (partition by l_quantity) as a, avg(ry) over (partition by l_extendedprice) as b from (select l_quantity, l_extendedprice, row_number() over (order by l_quantity) as rx, row_number() over (order by l_extendedprice) as ry from lineitem)) select round(corr(a, b), 6) as spearman from r")
def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with average ranks; ranks come from counts per value, so no task sorts all rows."""
    from skein.operators.windows import average_ranks

    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    a, b = average_ranks(rows, "l_quantity", "a"), average_ranks(rows, "l_extendedprice", "b")
    return rows.join(a, "l_quantity").join(b, "l_extendedprice").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query("""with x as (select label, unnest(embedding)::double as x, unnest(range(64)) as i from embeddings) select label, i, round(avg(x), 6) + 0.0 as x from x group by all""")
def q_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per label."""
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return vectors.pooled(rows).select(F.col("id").alias("label"), F.posexplode("vector").alias("i", "x")).withColumns({"i": F.col("i").cast("long"), "x": F.round("x", 6) + 0.0})


@query("select distinct unnest(string_split(question, '')) as ch from qa where question is not null")
def q_charset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("question is not null").select(F.explode(F.array_distinct(F.split("question", ""))).alias("ch")).distinct()


@query("select breed_name, list_sort(list_distinct(list(disease_name) filter (disease_name is not null))) as diseases, count(*) as n from qa where breed_name is not null group by breed_name")
def q_group_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa").where("breed_name is not null").groupBy("breed_name").agg(F.array_sort(F.collect_set("disease_name")).alias("diseases"), F.count(F.lit(1)).alias("n"))


@query("select type, list_sort(list(name || ':' || first)) as entries from (select upper(type) as type, name, min(alias[1]) as first from entity_alias where name is not null and alias[1] is not null group by all) group by type")
def q_group_map(spark: SparkSession, d: str) -> DataFrame:
    """Per type a map of names; shown as sorted entries."""
    a = table(spark, d, "entity_alias").select(F.upper("type").alias("type"), "name", F.try_element_at("alias", F.lit(1)).alias("first")).where("name is not null and first is not null")
    m = a.groupBy("type", "name").agg(F.min("first").alias("first")).groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("name", "first"))).alias("m"))
    return m.select("type", F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))).alias("entries"))


@query("select disease, string_agg(symptom, '|' order by symptom) as symptoms, cast(sum(w) as bigint) as total, round(sum(w) / sum(sum(w)) over (), 6) as share from (select disease, symptom, max(coalesce(weight, 0)) as w from symptom_relation where disease is not null group by all) group by disease")
def q_concat_sum(spark: SparkSession, d: str) -> DataFrame:
    """Concatenated symptoms, summed weights and the share of the total."""
    r = table(spark, d, "symptom_relation").where("disease is not null").groupBy("disease", "symptom").agg(F.max(F.coalesce("weight", F.lit(0))).alias("w"))
    g = r.groupBy("disease").agg(F.array_join(F.array_sort(F.collect_list("symptom")), "|").alias("symptoms"), F.sum("w").alias("total"))
    all_ = r.agg(F.sum("w").alias("all"))
    return g.join(F.broadcast(all_)).select("disease", "symptoms", "total", F.round(F.col("total") / F.col("all"), 6).alias("share"))


@query("select text, min(doc_id) as doc_id from documents where text is not null group by text")
def q_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """First occurrence wins: an aggregation, where a window would sort every group of copies."""
    return table(spark, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("select city, pet_kindof from (select city, pet_kindof, orgid from visits union all select city, pet_kindof, orgid from visits where orgid = 'ORG0001') group by city, pet_kindof, orgid having count(*) = 1")
def q_multiplicity_one(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stand exactly once in a table with a subset appended: not the same as a difference."""
    v = table(spark, d, "visits").select("city", "pet_kindof", "orgid")
    return v.unionByName(v.where("orgid = 'ORG0001'")).groupBy("city", "pet_kindof", "orgid").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("city", "pet_kindof")


@query("select 'qa' as source, question as text from qa where question is not null union select 'documents', text from documents where text is not null")
def q_union_tagged(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "qa").where("question is not null").select(F.lit("qa").alias("source"), F.col("question").alias("text"))
    return a.unionByName(table(spark, d, "documents").where("text is not null").select(F.lit("documents").alias("source"), "text")).distinct()


@query("select qa_index, list_sort(list_distinct(list_filter(list_concat(coalesce(question_fine_cut, []), coalesce(question_rough_cut, [])), lambda x: x is not null))) as united, list_sort(list_filter(list_intersect(coalesce(question_fine_cut, []), coalesce(question_rough_cut, [])), lambda x: x is not null)) as shared from qa")
def q_array_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("question_fine_cut", "question_rough_cut"))
    known = lambda x: F.array_sort(F.filter(x, lambda t: t.isNotNull()))
    return table(spark, d, "qa").select("qa_index", known(F.array_union(a, b)).alias("united"), known(F.array_intersect(a, b)).alias("shared"))
