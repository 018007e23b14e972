"""Queries over visits, breeds, relations and edges: features, cohorts, diagnosis, graphs, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import features as ft
from skein.operators import graph, models
from skein.plans.registry import query
from skein.sources.tables import table

_TS = "try_strptime({0}, '%Y-%m-%d %H:%M:%S.%g')"
_SEX = ["公", "母", "雄", "雌"]


def _one(visits: DataFrame) -> DataFrame:
    """Each visit once: repeated loads have equal fields but load_time."""
    return visits.drop("load_time").distinct()


@query("""with v as (select distinct id, try_cast(replace(pet_birthday, '.0', '') as timestamp) as b, try_cast(replace(reg_time, '.0', '') as timestamp) as r from visits)
select id, cast(case when b is null or r is null then 0 when floor((epoch(r) - epoch(b)) / 86400) > 18000 then 0 else floor((epoch(r) - epoch(b)) / 86400) end as bigint) as age_days from v""")
def q_age_days(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "visits").select("id", "pet_birthday", "reg_time").distinct()
    return v.select("id", ft.elapsed_days(ft.timestamp(F.col("pet_birthday")), ft.timestamp(F.col("reg_time"))).alias("age_days"))


_V = r"""regexp_replace(regexp_replace({c}, '[\x{{4e00}}-\x{{9fff}}]', '', 'g'), '{s}', '', 'g')"""


def _vital_sql(c: str, average: float, strip: str) -> str:
    s = _V.format(c=c, s=strip)
    two = rf"case when regexp_matches({s}, '\..*\.') then regexp_extract({s}, '^([0-9]*)', 1) else {s} end"
    return f"case when {c} is null or {c} = 'nan' or trim({c}) = '' then {average} when length({two}) <= 1 then 0.1 else coalesce(try_cast({two} as double), {average}) end"


@query(f"select id, {_vital_sql('temperatures', 38.5, '[^0-9.]')} as temperature, {_vital_sql('temperatures', 38.5, '[^0-9]')} as faithful, {_vital_sql('heart_rate', 120.0, '[^0-9.]')} as heart from (select distinct id, temperatures, heart_rate from visits)")
def q_vitals(spark: SparkSession, d: str) -> DataFrame:
    """Vital signs as numbers, in the evident and in the literal reading."""
    v = table(spark, d, "visits").select("id", "temperatures", "heart_rate").distinct()
    t, h = F.col("temperatures"), F.col("heart_rate")
    return v.select("id", ft.vital(t, 38.5).alias("temperature"), ft.vital(t, 38.5, True).alias("faithful"), ft.vital(h, 120.0).alias("heart"))


_LIMITS = "lim as (select name, least({0}) as low, greatest({0}) as high from breed_info)".format(", ".join(
    f"coalesce(try_cast(nullif(split_part({c}, '|', {i}), '') as double), try_cast(split_part({c}, '|', 1) as double))" for c in ("male_weight", "female_weight") for i in (1, 2)))


@query(f"with {_LIMITS} select name, low, high from lim")
def q_limits(spark: SparkSession, d: str) -> DataFrame:
    return ft.limits(table(spark, d, "breed_info"))


@query(f"""with {_LIMITS}, v as (select distinct id, pet_variety, city, symptom_level3, try_cast(regexp_replace(weight, '[-*]', '', 'g') as double) as w, try_cast(pet_age as int) as age from visits), l as (select name, min(low) as low, max(high) as high from lim group by name)
select id, case when w is null or low is null then 2 when w < low then 1 when w > high then 3 else 0 end as weight_class, case when replace(city, '市', '') in ('青岬', '丹墀') then 1 when replace(city, '市', '') in ('望溪', '云栈', '石漪') then 2 else 3 end as town_class,
  case when age > 12 then 1 else 0 end as adult, case when age > 96 then 1 else 0 end as old, cast(coalesce(contains(symptom_level3, '炎'), false) as int) as inflamed from v left join l on l.name = v.pet_variety""")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    """Weight against the breed's limits, town tier, age flags, complication."""
    lim = ft.limits(table(spark, d, "breed_info")).groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    v = table(spark, d, "visits").select("id", "pet_variety", "city", "symptom_level3", F.regexp_replace("weight", "[-*]", "").try_cast("double").alias("w"), F.col("pet_age").try_cast("int").alias("age")).distinct()
    j = v.join(lim, v["pet_variety"] == lim["name"], "left")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return j.select("id", ft.weight_class(F.col("w"), F.col("low"), F.col("high")).alias("weight_class"), ft.town_class(F.col("city")).alias("town_class"), flag(F.col("age") > 12).alias("adult"), flag(F.col("age") > 96).alias("old"), F.coalesce(F.contains("symptom_level3", F.lit("炎")), F.lit(False)).cast("int").alias("inflamed"))


@query("select id, " + ", ".join(f"coalesce(cast(pet_gender = '{v}' as int), 0) as gender_{i}" for i, v in enumerate(_SEX)) + " from (select distinct id, pet_gender from visits)")
def q_one_hot(spark: SparkSession, d: str) -> DataFrame:
    return ft.one_hot(table(spark, d, "visits").select("id", "pet_gender").distinct(), "pet_gender", _SEX, "gender").drop("pet_gender")


@query("select id, case pet_kindof when '犬' then 1 when '猫' then 2 else 0 end as kind, case when pet_gender in ('公', '雄', 'M') then 1 when pet_gender in ('母', '雌', 'F') then 2 else 0 end as sex from (select distinct id, pet_kindof, pet_gender from visits)")
def q_category_codes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "visits").select("id", "pet_kindof", "pet_gender").distinct()
    code = lambda c, m: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)], F.lit(0))
    return v.select("id", code("pet_kindof", {"犬": 1, "猫": 2}).alias("kind"), code("pet_gender", {"公": 1, "雄": 1, "M": 1, "母": 2, "雌": 2, "F": 2}).alias("sex"))


@query("""with d as (select distinct disease from symptom_relation where disease is not null), s as (select distinct symptom from symptom_relation where symptom is not null), w as (select disease, symptom, max(weight) as weight from symptom_relation group by all)
select disease, string_agg(coalesce(weight, 0), ',' order by symptom) as weights from d cross join s left join w using (disease, symptom) group by disease""")
def q_multi_hot(spark: SparkSession, d: str) -> DataFrame:
    """The weights of all symptoms of each disease, in order of the symptoms' names; 0 where a disease hasn't the symptom."""
    r = table(spark, d, "symptom_relation")
    return ft.multi_hot(r.where("disease is not null"), "disease", "symptom", "weight", r.where("symptom is not null").select("symptom").distinct()).select("disease", F.array_join(F.col("weights").cast("array<string>"), ",").alias("weights"))


@query("""with e as (select distinct pet_id from visits where contains(symptom_level3, '皮炎') and pet_id is not null), o as (select distinct pet_id from visits where symptom_level3 is not null and pet_id is not null and pet_id not in (select pet_id from e))
select pet_id, 1 as label from e union all select pet_id, 0 from o""")
def q_cohort(spark: SparkSession, d: str) -> DataFrame:
    return ft.cohort(table(spark, d, "visits"), "pet_id", "symptom_level3", "皮炎")


@query()
def q_balanced_cohort(spark: SparkSession, d: str) -> DataFrame:
    return ft.balance(q_cohort(spark, d), "label", "pet_id")


@query()
def q_draws(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: as many draws with replacement as there are breeds."""
    return ft.draw_with_replacement(table(spark, d, "breed_info").select("name").distinct(), "name", 36)


@query("""with r as (select disease, symptom, max(weight) as weight from symptom_relation where disease is not null and symptom is not null and weight > 0 group by all), q as (select distinct id as request, unnest(string_split(chief_complaint, '、')) as symptom from visits where chief_complaint is not null),
h as (select request, disease, exp(sum(ln(weight))) as score from q join r using (symptom) group by all), p as (select request, disease, score / sum(score) over (partition by request) as probability from h),
k as (select *, row_number() over (partition by request order by round(probability, 9) desc, disease) as rank from p) select request, disease, round(probability + 1e-9, 6) as probability, cast(rank as int) as rank from k where rank <= 5""")
def q_diagnose(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest diseases for the symptoms listed in each complaint."""
    requests = table(spark, d, "visits").where("chief_complaint is not null").select(F.col("id").alias("request"), F.explode(F.split("chief_complaint", "、")).alias("symptom"))
    return ft.diagnose(table(spark, d, "symptom_relation"), requests).withColumn("probability", F.round(F.col("probability") + 1e-9, 6))


_EDGES = """edges as (select distinct disease as src, '症状' as rel, symptom as dst from symptom_relation where disease is not null and symptom is not null union all select distinct name, '别名', unnest(alias) from entity_alias where name is not null)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Diseases, their symptoms and aliases as an edge list."""
    r = table(spark, d, "symptom_relation").where("disease is not null and symptom is not null").select(F.col("disease").alias("src"), F.lit("症状").alias("rel"), F.col("symptom").alias("dst")).distinct()
    a = table(spark, d, "entity_alias").where("name is not null").select(F.col("name").alias("src"), F.lit("别名").alias("rel"), F.explode("alias").alias("dst")).distinct()
    return r.unionByName(a)


def _diseases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symptom_relation").where("disease is not null").select(F.col("disease").alias("name")).distinct()


@query(f"with {_EDGES}, s as (select distinct disease as src from symptom_relation where disease is not null) select src as start, rel as path, string_agg(distinct dst, chr(9) order by dst) as answers from edges join s using (src) where dst is not null group by all")
def q_graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.grouped_paths(graph.one_hop(edges(spark, d).where("dst is not null"), _diseases(spark, d)))


@query(f"with {_EDGES}, s as (select distinct disease as src from symptom_relation where disease is not null) select a.src as start, a.rel || '|' || b.rel as path, b.dst as answer from edges a join s on s.src = a.src join edges b on b.src = a.dst where a.rel <> '别名'")
def q_graph_two_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(edges(spark, d), _diseases(spark, d), ("别名",))


@query(f"with {_EDGES}, s as (select distinct symptom as dst from symptom_relation where symptom is not null) select distinct a.dst as start, a.rel || '|' || b.rel as path, b.dst as answer from edges a join s on s.dst = a.dst join edges b on b.src = a.src and not (a.rel = b.rel and a.dst = b.dst)")
def q_graph_siblings(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "symptom_relation").where("symptom is not null").select(F.col("symptom").alias("name")).distinct()
    return graph.siblings(edges(spark, d), starts)


@query(f"with {_EDGES}, v as (select src as name from edges union select dst from edges where dst is not null) select name, count(src) as degree from v left join edges on dst = name group by name")
def q_in_degree(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    v = e.select(F.col("src").alias("name")).unionByName(e.where("dst is not null").select(F.col("dst").alias("name"))).distinct()
    return graph.in_degree(v, e)


def _geography(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """World -> region -> nation -> supplier, with costs."""
    r, n, s = (table(spark, d, x) for x in ("region", "nation", "supplier"))
    e = r.select(F.lit("world").alias("src"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("dst"), (F.col("r_regionkey") + 1).cast("double").alias("cost"))
    e = e.unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"), F.lit(2.0).alias("cost")))
    e = e.unionByName(s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit(0.5).alias("cost")))
    return e.select(F.col("src").alias("name")).unionByName(e.select(F.col("dst").alias("name"))).distinct(), e


_GEO = "e as (select 'world' as src, 'r' || r_regionkey as dst, cast(r_regionkey + 1 as double) as cost from region union all select 'r' || n_regionkey, 'n' || n_nationkey, 2.0 from nation union all select 'n' || s_nationkey, 's' || s_suppkey, 0.5 from supplier)"


@query(f"with recursive {_GEO}, p as (select 'world' as name, 0 as level union all select e.dst, p.level + 1 from p join e on e.src = p.name) select name, max(level) as level from (select * from p union all select distinct src, 0 from e where src not in (select dst from e)) group by name")
def q_topological(spark: SparkSession, d: str) -> DataFrame:
    return graph.topological_levels(*_geography(spark, d))


@query(f"with recursive {_GEO}, p as (select 'world' as name, 0.0::double as distance union all select e.dst, p.distance + e.cost from p join e on e.src = p.name) select name, min(distance) as distance from p group by name")
def q_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_paths(_geography(spark, d)[1], "world")


@query("select coalesce(a.name, b.name, c.name) as name, coalesce(a.n, 0) as visits, coalesce(b.n, 0) as relations, coalesce(c.n, 0) as aliases from (select pet_variety as name, count(*) as n from visits where pet_variety is not null group by 1) a full join (select disease as name, count(*) as n from symptom_relation where disease is not null group by 1) b on a.name = b.name full join (select name, count(*) as n from entity_alias where name is not null group by 1) c on coalesce(a.name, b.name) = c.name")
def q_outer_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chain of full outer joins on one key."""
    n = lambda t, c, out: table(spark, d, t).where(f"{c} is not null").groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias(out))
    return n("visits", "pet_variety", "visits").join(n("symptom_relation", "disease", "relations"), "name", "full_outer").join(n("entity_alias", "name", "aliases"), "name", "full_outer").fillna(0)


@query("select v.orgid, c.city, c.magnitude, count(*) as visits, count(distinct v.pet_id) as pets from (select distinct id, orgid, pet_id from visits) v join clinics c using (orgid) group by all")
def q_relation_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Inner join with attributes; visits are counted per clinic before they meet the attributes."""
    v = table(spark, d, "visits").select("id", "orgid", "pet_id").distinct().groupBy("orgid").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("pet_id").alias("pets"))
    return v.join(table(spark, d, "clinics").select("orgid", "city", "magnitude"), "orgid").select("orgid", "city", "magnitude", "visits", "pets")


@query()
def q_forest(spark: SparkSession, d: str) -> DataFrame:
    """Random forest that tells the disease of a visit from the symptoms in its texts, trained on three quarters of the visits with a known disease."""
    r, v = table(spark, d, "symptom_relation"), table(spark, d, "visits")
    diseases = r.where("disease is not null").groupBy("disease").agg(F.max("weight").alias("w")).select("disease")
    known = v.join(F.broadcast(diseases), v["symptom_level3"] == diseases["disease"]).where("id is not null").dropDuplicates(["id"]).select("id", "disease", F.concat_ws("\n", "chief_complaint", "present_history").alias("said"))
    return models.diagnosis_forest(known, "id", "said", "disease", r.where("symptom is not null").select("symptom").distinct(), "symptom")


@query()
def q_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees that tell whether a visit names an inflammation."""
    return models.tree_classifier(q_flags(spark, d), "id", ["weight_class", "town_class", "adult", "old"], "inflamed", "boosted")


@query()
def q_text_classifier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("target")), "doc_id")
    return models.text_classifier(rows, "doc_id", "text", "target")


@query()
def q_word_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = models.word_vectors(table(spark, d, "qa"), "question_fine_cut")
    return v.select("word", F.size("vector").alias("n"))


@query()
def q_without_component(spark: SparkSession, d: str) -> DataFrame:
    v = models.without_first_component(table(spark, d, "embeddings"), "vec_id", "embedding")
    return v.select("vec_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 4).alias("energy"))
