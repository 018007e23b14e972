"""Text preparation, mining, vector pooling and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import prepare as pr
from skein.functions import similarity as sim
from skein.operators import counts, mining, vectors, windows
from skein.operators import features as ft
from skein.plans.registry import query
from skein.sources.tables import table

_CLEAN = "list_filter({c}, lambda t: t is not null and trim(t) <> '')"


def _translate(c: str, a: str, b: str) -> str:
    q = lambda s: s.replace("'", "''")
    return f"translate({c}, '{q(a)}', '{q(b)}')"


def _converted(c: str, *maps: str) -> str:
    for m in maps:
        for a, b in pr.MAPS[m]:
            c = _translate(c, a, b) if len(a) == len(b) else f"replace({c}, '{a}', '{b}')"
    return c


@query(f"select qa_index, {_converted('question', 'narrow', 'marks')} as narrow, {_converted('question', 'wide')} as wide, {_converted('answer', 'simple')} as simple from qa")
def q_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Texts by ordered replacement maps: ordinary width, full width, simplified characters."""
    c = F.col
    return table(spark, d, "qa").select("qa_index", pr.convert(c("question"), "narrow", "marks").alias("narrow"), pr.convert(c("question"), "wide").alias("wide"), pr.convert(c("answer"), "simple").alias("simple"))


@query(rf"select doc_id, regexp_matches(text, '{pr.EMOJI}') as emoji, length(regexp_replace(text, '{pr.EMOJI}', '', 'g')) as n, regexp_replace(text, '（.*）', '', 'g') as bare from documents where text is not null")
def q_emoji(spark: SparkSession, d: str) -> DataFrame:
    """Texts with emoji, without them, and without bracketed suffixes."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", pr.has_emoji(t).alias("emoji"), F.length(pr.without_emoji(t)).cast("long").alias("n"), pr.without_suffix(t).alias("bare"))


@query("select doc_id, text as text from documents where text is not null")
def q_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes decoded to text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", pr.decoded(F.encode("text", "UTF-8")).alias("text"))


@query(r"""with p as (select qa_index, unnest(list_filter(string_split(regexp_replace(answer, '([。！？!?\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as block, unnest(range(len(list_filter(string_split(regexp_replace(answer, '([。！？!?\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')))) as i from qa where answer is not null)
select qa_index, cast(coalesce(sum(length(block)) over (partition by qa_index order by i rows between unbounded preceding and 1 preceding), 0) as int) as begin, block from p""")
def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Answers as sentences with offsets."""
    return table(spark, d, "qa").where("answer is not null").select("qa_index", F.inline(pr.blocks(F.col("answer"))))


@query(r"""with c as (select qa_index, answer as c, question as q, question_fine_cut as t from qa where answer is not null),
h as (select qa_index, c, case when q is not null and q <> '' and contains(c, q) then q else (select x from (select unnest(t) as x) where x is not null and trim(x) <> '' and contains(c, x) order by length(x) desc, x limit 1) end as hit from c),
p as (select qa_index, c, hit, position(hit in c) as place from h),
b as (select *, place - length(regexp_extract(substring(c, greatest(place - 48, 1), least(place - 1, 48)), '[^。！？!?\n]*$')) as b, place + length(regexp_extract(substring(c, place, 128), '^[^。！？!?\n]*[。！？!?]?')) - 1 as e from p)
select qa_index, coalesce(substring(c, b, place - b) || '<em>' || hit || '</em>' || substring(c, place + length(hit), greatest(e - place - length(hit) + 1, 0)), substring(c, 1, 64)) as abstract from b""")
def q_abstract(spark: SparkSession, d: str) -> DataFrame:
    """The passage of each answer that its question is about: by the question, else its longest term, else the beginning."""
    q = table(spark, d, "qa").where("answer is not null")
    return q.select("qa_index", pr.abstract(F.col("answer"), F.col("question"), F.col("question_fine_cut")).alias("abstract"))


@query("""with w as (select distinct name as word from entity_alias where name is not null) select word, list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, strlen(word) * 2, 2), lambda i: ('0x' || substring(hex(word), i, 2))::int::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as hash from w""")
def q_fnv(spark: SparkSession, d: str) -> DataFrame:
    """A stable hash of the dictionary's words."""
    return table(spark, d, "entity_alias").where("name is not null").select(F.col("name").alias("word")).distinct().select("word", pr.fnv(F.col("word")).alias("hash"))


@query("with a as (select distinct name, unnest(alias) as alias from entity_alias where name is not null) select name, alias, cast(levenshtein(name, alias) as int) as distance from a where alias is not null")
def q_byte_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance in bytes between names and their aliases."""
    a = table(spark, d, "entity_alias").where("name is not null").select("name", F.explode("alias").alias("alias")).where("alias is not null").distinct()
    return a.select("name", "alias", pr.byte_distance(F.col("name"), F.col("alias")).alias("distance"))


@query("""with d as (select distinct text from documents where text is not null and length(text) > 1), g as (select substring(question, i::int, n::int) as gram from qa, range(1, 4) r(n), range(1, length(question) - n + 2) s(i) where question is not null),
c as (select gram, count(*) as n, length(gram) as k from g group by gram), t as (select k, sum(n) as total from c group by k), p as (select gram, n, c.k, n / total as p from c join t on c.k = t.k),
s as (select x.gram, x.n, x.k, min(ln(x.p / (l.p * r.p))) as pmi from p x, range(1, x.k) i(i) join p l on l.gram = substring(x.gram, 1, i.i::int) join p r on r.gram = substring(x.gram, i.i::int + 1) where x.k in (2, 3) group by all)
select gram, n, round(pmi, 6) as pmi from s where (k = 2 and pmi >= 2.0) or (k = 3 and pmi >= 4.0)""")
def q_kept_grams(spark: SparkSession, d: str) -> DataFrame:
    """Character runs whose parts hold together, with a threshold for each length."""
    g = mining.kept_grams(counts.grams(table(spark, d, "qa"), "question", 3), {2: 2.0, 3: 4.0})
    return g.select("gram", "n", F.round("pmi", 6).alias("pmi"))


_PHRASES = r"""w as (select list_filter(question_fine_cut, lambda t: t is not null and trim(t) <> '') as w from qa where question_fine_cut is not null), p as (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) as phrase from w where len(w) > 1),
n as (select phrase, count(*) as n from p where regexp_matches(phrase, '^[\x{4e00}-\x{9fff}]{2,}$') and not regexp_matches(phrase, '^[的了吗呢是在和有也都就]|[的了吗呢是在和有也都就]$') group by phrase having count(*) >= 5), k as (select phrase, n from n where phrase not in (select name from entity_alias where name is not null))"""


@query(f"with {_PHRASES} select phrase, n from k")
def q_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two neighbouring words that aren't in the dictionary."""
    return mining.phrases(table(spark, d, "qa"), "question_fine_cut", table(spark, d, "entity_alias"), "name")


@query(f"with {_PHRASES}, s as (select distinct symptom as w from symptom_relation where length(symptom) > 1) select phrase, n from k where not exists (select 1 from s where contains(phrase, w)) and not regexp_matches(phrase, '^[一二三两几第]')")
def q_unknown_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases without a known word inside them that don't begin with a numeral."""
    p = mining.phrases(table(spark, d, "qa"), "question_fine_cut", table(spark, d, "entity_alias"), "name")
    return mining.without_known_parts(p, "phrase", table(spark, d, "symptom_relation"), "symptom").where(~F.col("phrase").rlike("^[一二三两几第]"))


_BI = "b as (select w1, w2, count(*) as n from (select unnest(list_transform(range(1, len(w)), lambda i: w[i])) as w1, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) as w2 from (select list_concat(['<SOS>'], list_filter(question_fine_cut, lambda t: t is not null), ['<EOS>']) as w from qa where question_fine_cut is not null)) group by all)"


@query(f"""with {_BI}, r as (select list_filter(question_rough_cut, lambda t: t is not null) as w from qa where question_rough_cut is not null), q as (select distinct unnest(list_transform(range(1, len(w)), lambda i: w[i])) as w1, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) as w2 from r where len(w) > 1),
o as (select w2, sum(n) as n2 from b group by w2), f as (select w1, sum(n) as n1 from b group by w1)
select q.w1, q.w2, coalesce(n1, 0)::bigint as n1, coalesce(n, 0)::bigint as n12, round(case when n > 0 then n / n1 else 0.4 * coalesce(n2, 0) / (select sum(n) from b) end, 9) as p from q left join b on q.w1 = b.w1 and q.w2 = b.w2 left join o on o.w2 = q.w2 left join f on f.w1 = q.w1""")
def q_backed_off(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of the rough segmentation's neighbours by the fine one's counts, unseen ones backed off."""
    qa = table(spark, d, "qa")
    w = F.filter("question_rough_cut", lambda t: t.isNotNull())
    pairs = qa.where("question_rough_cut is not null").select(w.alias("w")).where("size(w) > 1").select(F.inline(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))))
    return mining.backed_off(counts.bigrams(qa, "question_fine_cut"), pairs).select("w1", "w2", "n1", "n12", F.round("p", 9).alias("p"))


@query()
def q_bloom(spark: SparkSession, d: str) -> DataFrame:
    """Words of the questions that a Bloom filter of the dictionary may hold: never False for one that it holds."""
    names = table(spark, d, "entity_alias").select("name")
    bits, hashes = 4096, 7
    words = table(spark, d, "qa").select(F.explode("question_rough_cut").alias("name")).where("name is not null").distinct()
    return mining.maybe_in(words, "name", mining.bloom_filter(names, "name", bits, hashes), bits, hashes).withColumnRenamed("name", "word")


# ---- vectors: the k-th commonest word has the k-th vector, further words have none

_VEC = f"""c as (select unnest({_CLEAN.format(c='question_fine_cut')}) as word from qa where question_fine_cut is not null), v as (select word, n, embedding::double[] as vec from (select word, count(*) as n, row_number() over (order by count(*) desc, word) - 1 as k from c group by word) left join embeddings on vec_id = k),
t as (select qa_index as id, unnest({_CLEAN.format(c='question_fine_cut')}) as word from qa where question_fine_cut is not null)"""
_SIF = "w as (select id, word, n, coalesce(vec, list_resize([0.0::double], 64, 0.0)) as vec, 0.001 / (0.001 + n / (select count(*) from c)) as a from t join v using (word)), x as (select id, a, unnest(vec) as x, unnest(range(64)) as i from w), m as (select id, i, sum(a * x) / count(*) as x from x group by all)"


def _word_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tokens with vectors, and the words with their numbers."""
    qa = table(spark, d, "qa")
    n = counts.word_counts(qa, "question_fine_cut")
    v = windows.dense_ids(n, [F.desc("n"), F.asc("word")], "vec_id").join(table(spark, d, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vector"))
    return vectors.looked_up(qa, "qa_index", "question_fine_cut", v, 64), n, v


@query(f"with {_VEC}, {_SIF} select id as qa_index, i, round(x, 6) + 0.0 as x from m")
def q_weighted_pool(spark: SparkSession, d: str) -> DataFrame:
    """Questions as smooth-inverse-frequency weighted means of their words' vectors."""
    tokens, n, _ = _word_vectors(spark, d)
    total = n.agg(F.sum("n").alias("total"))
    weighted = tokens.join(n, "word").join(F.broadcast(total)).withColumn("a", counts.sif_weight(F.col("n"), F.col("total")))
    p = vectors.pooled(weighted, F.col("a"))
    return p.select(F.col("id").alias("qa_index"), F.posexplode("vector").alias("i", "x")).withColumns({"i": F.col("i").cast("long"), "x": F.round("x", 6) + 0.0})


@query(f"with {_VEC}, {_SIF}, p as (select id, list(x order by i) as vec from m group by id), l as (select p.*, d.disease_name from p join qa d on d.qa_index = p.id where d.disease_name is not null and d.disease_name <> ''), f as (select disease_name, min(id) as first from l group by 1) select a.id as qa_index, round(1 - list_cosine_similarity(a.vec, b.vec), 5) + 0.0 as distance from l a join f using (disease_name) join l b on b.id = f.first and a.id <> b.id")
def q_pooled_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of each question to the first one on the same disease, by pooled vectors."""
    tokens, n, _ = _word_vectors(spark, d)
    total = n.agg(F.sum("n").alias("total"))
    p = vectors.pooled(tokens.join(n, "word").join(F.broadcast(total)).withColumn("a", counts.sif_weight(F.col("n"), F.col("total"))), F.col("a"))
    m = p.join(table(spark, d, "qa").where("disease_name <> ''").select(F.col("qa_index").alias("id"), "disease_name"), "id")
    first = m.groupBy("disease_name").agg(F.min_by(F.struct("id", "vector"), "id").alias("f"))
    j = m.join(first, "disease_name").where("id <> f.id")
    return j.select(F.col("id").alias("qa_index"), (F.round(1 - sim.cosine(F.col("vector"), F.col("f.vector")), 5) + 0.0).alias("distance"))


@query(f"""with {_VEC}, k as (select id, word, vec is not null as known, coalesce(vec, list_resize([0.0::double], 64, 0.0)) as vec from t join v using (word)), x as (select id, unnest(vec) as x, unnest(range(64)) as i from k), m as (select id, i, avg(x) as x from x group by all), p as (select id, list(x order by i) as mean from m group by id), n as (select id, count(*) as n from k group by id)
select distinct id as qa_index, word, round(case when n = 1 then 1.0 when not known then 0.0 else 1 - coalesce(list_cosine_similarity(vec, mean), 1.0) end, 5) + 0.0 as weight from k join p using (id) join n using (id)""")
def q_term_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far each word of a question is from its mean."""
    tokens, _, _ = _word_vectors(spark, d)
    t = vectors.term_distances(tokens)
    return t.select(F.col("id").alias("qa_index"), "word", (F.round("weight", 5) + 0.0).alias("weight"))


# ---- features of visits

_VITAL = "case when {c} is null or {c} = 'nan' or trim({c}) = '' then {m} when length({s}) <= 1 then 0.1 else coalesce(try_cast({s} as double), {m}) end"


def _vital(c: str, m: float) -> str:
    s = f"regexp_replace(regexp_replace({c}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g'), '[^0-9.]', '', 'g')"
    s = f"(case when regexp_matches({s}, '\\..*\\.') then regexp_extract({s}, '^([0-9]*)', 1) else {s} end)"
    return _VITAL.format(c=c, m=m, s=s)


@query(f"with v as (select distinct id, temperatures, {_vital('temperatures', 38.5)} as t from visits) select id, temperatures, round(case when t > 100 then t / 10 else t end, 6) as temperature from v")
def q_vitals_rescaled(spark: SparkSession, d: str) -> DataFrame:
    """Temperatures typed without their decimal point, divided by ten."""
    v = table(spark, d, "visits").select("id", "temperatures").distinct()
    return v.select("id", "temperatures", F.round(ft.rescaled(F.col("temperatures"), 38.5, 100.0), 6).alias("temperature"))


_CLASSES = "case when pet_gender in ('公', '雄', 'M') then 1 when pet_gender in ('母', '雌', 'F') then 2 end as sex, case when try_cast(pet_age as double) > 96 then 3 when try_cast(pet_age as double) > 12 then 2 when try_cast(pet_age as double) is not null then 1 end as age, case when regexp_matches(pet_kindof, '犬|DOG') then 1 when regexp_matches(pet_kindof, '猫|CAT') then 2 end as kind"


def _classes() -> dict:
    return {"sex": ft.sex_class(F.col("pet_gender")), "age": ft.age_class(F.col("pet_age").try_cast("double")), "kind": ft.kind_class(F.col("pet_kindof"))}


@query(f"with v as (select distinct id, {_CLASSES} from visits) select id, coalesce(cast(sex = 1 as int), 0) as is_male, coalesce(cast(sex = 2 as int), 0) as is_female, coalesce(cast(age = 1 as int), 0) as is_young, coalesce(cast(age = 2 as int), 0) as is_grown, coalesce(cast(age = 3 as int), 0) as is_old, coalesce(cast(kind > 0 as int), 0) as known from v")
def q_derived_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of flags from codes, and a code made binary."""
    v = table(spark, d, "visits").select("id", *[c.alias(n) for n, c in _classes().items()]).distinct()
    flag = lambda c, k: F.coalesce((F.col(c) == k).cast("int"), F.lit(0))
    return v.select("id", flag("sex", 1).alias("is_male"), flag("sex", 2).alias("is_female"), flag("age", 1).alias("is_young"), flag("age", 2).alias("is_grown"), flag("age", 3).alias("is_old"), F.coalesce((F.col("kind") > 0).cast("int"), F.lit(0)).alias("known"))


_ATTRIBUTES = "a as (select symptom_level3 as disease, p, v, count(*) as n from (select symptom_level3, 'sex' as p, sex as v from c union all select symptom_level3, 'age', age from c union all select symptom_level3, 'kind', kind from c) where symptom_level3 is not null and v is not null group by all), b as (select disease, p, arg_max(v, n * 10 - v) as v, max(n) / sum(n) as share from a group by all)"


@query(f"""with c as (select id, symptom_level3, chief_complaint, {_CLASSES} from visits), {_ATTRIBUTES},
r as (select disease, symptom, max(weight) as weight from symptom_relation where disease is not null and symptom is not null and weight > 0 group by all), q as (select distinct id as request, unnest(string_split(chief_complaint, '、')) as symptom from visits where chief_complaint is not null),
h as (select request, disease, exp(sum(ln(weight))) as score from q join r using (symptom) group by all), g as (select id as request, max(sex) as sex, max(age) as age, max(kind) as kind from c group by id),
k as (select h.* from h join g using (request) where not exists (select 1 from b where b.disease = h.disease and share >= 0.6 and v <> case p when 'sex' then sex when 'age' then age else kind end)),
p as (select request, disease, score / sum(score) over (partition by request) as probability from k), o as (select *, row_number() over (partition by request order by round(probability, 9) desc, disease) as rank from p)
select request, disease, round(probability + 1e-9, 6) as probability, cast(rank as int) as rank from o where rank <= 5""")
def q_diagnose_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest diseases of each complaint that go with the animal's kind, sex and age; a disease's own are those of three fifths of its visits."""
    v = table(spark, d, "visits")
    attributes = ft.attributes(v, "symptom_level3", _classes(), 0.6)
    given = v.groupBy(F.col("id").alias("request")).agg(*[F.max(c).alias(n) for n, c in _classes().items()])
    requests = v.where("chief_complaint is not null").select(F.col("id").alias("request"), F.explode(F.split("chief_complaint", "、")).alias("symptom"))
    return ft.diagnose_filtered(table(spark, d, "symptom_relation"), requests, attributes, given, list(_classes())).withColumn("probability", F.round(F.col("probability") + 1e-9, 6))


@query("with n as (select pet_kindof as kind, pet_variety as variety, count(*) as n from (select distinct id, pet_kindof, pet_variety from visits) where pet_kindof is not null and pet_variety is not null group by all), s as (select kind, variety, n / sum(n) over (partition by kind) as rate from n) select kind, string_agg(variety || '=' || printf('%.4f', rate), ';' order by variety) as rates from s group by kind")
def q_rate_map(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of animal, a map of the shares of its breeds."""
    n = table(spark, d, "visits").select("id", F.col("pet_kindof").alias("kind"), F.col("pet_variety").alias("variety")).distinct().where("kind is not null and variety is not null").groupBy("kind", "variety").agg(F.count(F.lit(1)).alias("n"))
    rates = n.join(n.groupBy("kind").agg(F.sum("n").alias("all")), "kind").groupBy("kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variety", F.format_string("%.4f", F.col("n") / F.col("all")).alias("r"))))).alias("m"))
    return rates.select("kind", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("rates"))


@query("with r as (select disease, symptom, max(weight) as weight from symptom_relation where disease is not null and symptom is not null group by all) select disease, list(symptom order by coalesce(weight, -1) desc, symptom desc) as symptoms from r group by disease")
def q_sorted_lists(spark: SparkSession, d: str) -> DataFrame:
    """Symptoms of each disease by weight, then name, both descending."""
    r = table(spark, d, "symptom_relation").where("disease is not null and symptom is not null").groupBy("disease", "symptom").agg(F.coalesce(F.max("weight"), F.lit(-1)).alias("weight"))
    return r.groupBy("disease").agg(F.transform(F.sort_array(F.collect_list(F.struct("weight", "symptom")), False), lambda s: s["symptom"]).alias("symptoms"))


@query("with a as (select row_number() over (order by name) - 1 as i, name from (select distinct name from breed_info where name is not null)), b as (select row_number() over (order by word) - 1 as i, word from (select distinct word from sensitive_words where word is not null)) select i, name, word from a full join b using (i)")
def q_aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of two tables side by side, by row number."""
    a = windows.dense_ids(table(spark, d, "breed_info").where("name is not null").select("name").distinct(), [F.asc("name")], "i")
    b = windows.dense_ids(table(spark, d, "sensitive_words").where("word is not null").select("word").distinct(), [F.asc("word")], "i")
    return a.join(b, "i", "full_outer").select(F.col("i").cast("long").alias("i"), "name", "word")


@query("with r as (select symptom, disease, max(weight) as weight from symptom_relation where symptom is not null and disease is not null and weight is not null group by all) select symptom, string_agg(disease || '=' || weight, ';' order by disease) as weights from r group by symptom")
def q_nested_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of maps: symptom to disease to weight."""
    r = table(spark, d, "symptom_relation").where("symptom is not null and disease is not null and weight is not null").groupBy("symptom", "disease").agg(F.max("weight").alias("weight"))
    m = r.groupBy("symptom").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("disease", "weight")))).alias("m"))
    return m.select("symptom", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("weights"))
