"""Dictionary matching as equality joins, entity linking, rule tags and intent flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.functions import text as tx
from skein.session import small

_PIECE, _HEADS = 128, 2_000


def mentions(df: DataFrame, id: str, text: str, words: DataFrame, word: str, longest: int = 12) -> DataFrame:
    """(id, word): the dictionary words (of up to ``longest`` characters) that stand in a text.

    Every multi-pattern search is a join of the text's substrings of 1..longest characters with the dictionary by equality;
    it needs no automaton, and a small dictionary is broadcast (checked), so nothing of the texts is shuffled but the hits.
    Longer words, rare, are searched by containment against the broadcast list of just those.
    """
    w = words.select(F.col(word).alias("word")).where("word is not null and word <> ''").distinct()
    lengths = sorted(r[0] for r in w.where(F.length("word") <= longest).select(F.length("word")).distinct().collect()) or [1]  # at most ``longest`` numbers
    # only substrings that begin like a word are kept, where the beginnings are few enough for a hash set in the plan
    heads = [r[0] for r in w.select(F.substring("word", 1, 2)).distinct().limit(_HEADS + 1).collect()]
    begins = (lambda g: F.filter(g, lambda x: F.substring(x, 1, 2).isin(heads))) if 0 < len(heads) <= _HEADS else (lambda g: g)
    # a long text is cut into overlapping pieces first, as finding a place in a string takes time in proportion to the place
    pieces = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(_PIECE)), lambda s: F.substring(F.col(text), s, F.lit(_PIECE + longest - 1)))
    cut = df.where(F.length(text) > 0).select(F.col(id).alias(id), F.explode(pieces).alias("piece"))
    subs = cut.select(id, F.explode(F.array_distinct(begins(F.flatten(F.array(*[_grams(F.col("piece"), F.lit(n)) for n in lengths]))))).alias("word"))
    short = subs.join(small(w.where(F.length("word") <= longest)), "word").select(id, "word").distinct()
    long = w.where(F.length("word") > longest)
    many = df.where(F.col(text).isNotNull()).select(id, text).join(small(long), F.contains(F.col(text), F.col("word"))).select(id, "word")
    return short.unionByName(many)


def _grams(c: Column, n: Column) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def aliases(table: DataFrame) -> DataFrame:
    """(mention, name, type): names and their aliases, with the type in upper case."""
    t = table.where("name is not null").select("name", F.upper("type").alias("type"), F.filter(F.concat(F.coalesce("alias", F.array().cast("array<string>")), F.array("name")), lambda x: x.isNotNull() & (F.trim(x) != "")).alias("m"))
    return t.select(F.explode(F.array_distinct("m")).alias("mention"), "name", "type").distinct()


def longest_only(hits: DataFrame, id: str, word: str) -> DataFrame:
    """Drops a word that is part of a longer hit of the same text."""
    x, y = hits.alias("x"), hits.alias("y")
    return x.join(y, (F.col(f"x.{id}") == F.col(f"y.{id}")) & (F.col(f"x.{word}") != F.col(f"y.{word}")) & F.contains(F.col(f"y.{word}"), F.col(f"x.{word}")), "left_anti")


def link(df: DataFrame, id: str, text: str, alias_table: DataFrame) -> DataFrame:
    """(id, entity, type, rank): the entities a text names: diseases first, then symptoms, then breeds."""
    a = aliases(alias_table)
    hits = longest_only(mentions(df, id, text, a, "mention").distinct(), id, "word")
    linked = hits.join(small(a), hits["word"] == a["mention"]).select(id, F.col("name").alias("entity"), "type").distinct()
    order = F.when(F.col("type") == "DISEASE", 2).when(F.col("type") == "SYMPTOMS", 1).otherwise(0)
    return linked.withColumn("rank", F.row_number().over(W.partitionBy(id).orderBy(order.desc(), "entity", "type")))


def tags(df: DataFrame, id: str, tokens: str, rules: DataFrame) -> DataFrame:
    """(id, scenario, names): the rule names whose keyword is one of the tokens, once each."""
    t = df.select(id, F.explode(F.array_distinct(tokens)).alias("keyword"))
    return t.join(small(rules), "keyword").groupBy(id, "scenario").agg(F.array_sort(F.collect_set("name")).alias("names"))


def tag_columns(tagged: DataFrame, id: str, scenarios: list[str]) -> DataFrame:
    """One array column of labels per stated scenario."""
    return tagged.groupBy(id).agg(*[F.first(F.when(F.col("scenario") == s, F.col("names")), ignorenulls=True).alias(s) for s in scenarios])


def match_features(df: DataFrame, query: str, entity: str) -> DataFrame:
    """df with the features of a query and an entity: lengths, whether and where the query has it (begin from 0, -1 if not; characters behind), share of its characters in the query."""
    q, e = F.col(query), F.col(entity)
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return df.withColumns({
        "query_length": F.length(q), "entity_length": F.length(e), "contained": F.contains(q, e), "begin": F.position(e, q) - 1,
        "behind": F.when(F.contains(q, e), F.length(q) - F.length(e) - F.position(e, q) + 1), "share": F.try_divide(F.size(F.array_intersect(chars(q), chars(e))), F.size(chars(e))),
    })


def intent(text: Column, sensitive: Column, domain: Column) -> Column:
    """Cascade: empty or nonsense is chit-chat, then sensitive words, then domain words."""
    return F.when(text.isNull() | (F.trim(text) == ""), "chitchat").when(sensitive, "sensitive").when(domain, "pet_qa").when(tx.nonsense(text), "chitchat").otherwise("unknown")
