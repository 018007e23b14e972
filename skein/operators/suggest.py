"""Readings, spelling candidates, synonyms, tags of characters, word pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skein.operators.joins import within_edits
from skein.session import small


def folded_reading(c: Column) -> Column:
    """Readings that are easily confused fall together: ng -> n, zh/sh/ch -> z/s/c."""
    return F.regexp_replace(F.regexp_replace(c, "ng$", "n"), "^([zsc])h", "$1")


def readings(words: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """(word, reading): folded readings of the characters, joined in order; characters without one stand for themselves."""
    chars = words.select(F.col(word).alias("word")).where("word is not null").distinct().select("word", F.posexplode(F.split("word", "")).alias("i", "ch")).where("ch <> ''")
    d = dictionary.groupBy("ch").agg(F.min("reading").alias("reading"))
    j = chars.join(small(d), "ch", "left").select("word", F.struct("i", F.coalesce(folded_reading(F.col("reading")), F.col("ch")).alias("r")).alias("x"))
    return j.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), " ").alias("reading"))


def homophones(words: DataFrame, word: str, dictionary: DataFrame) -> DataFrame:
    """(word, other): different words of the same folded reading, by equality of the reading."""
    r = readings(words, word, dictionary)
    return r.select("word", "reading").join(r.select(F.col("word").alias("other"), "reading"), "reading").where("word <> other").select("word", "other")


def reading_candidates(words: DataFrame, word: str, dictionary: DataFrame, k: int) -> DataFrame:
    """(word, candidate, distance, similarity): different words whose readings are at most ``k`` edits apart; four fifths of the similarity come from the signs, one fifth from the reading, by edits over the greater length."""
    r = readings(words, word, dictionary)
    near = within_edits(r, "reading", k)
    same = r.select(F.col("reading").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("distance"))
    pairs = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(same)
    j = pairs.join(r.select(F.col("word").alias("word"), F.col("reading").alias("a")), "a").join(r.select(F.col("word").alias("candidate"), F.col("reading").alias("b")), "b").where("word <> candidate")
    alike = lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return j.select("word", "candidate", "distance", F.round(0.8 * alike(F.col("word"), F.col("candidate")) + 0.2 * alike(F.col("a"), F.col("b")), 6).alias("similarity"))


def masked_candidates(words: DataFrame) -> DataFrame:
    """(word, candidate, score): of (word, n), other words of the same length that differ in one place; the score is the share of the candidate's frequency."""
    masks = words.where(F.length("word") >= 2).select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("_"), F.substring("word", i + 1, F.length("word"))))).alias("mask"))
    p = masks.join(masks.select(F.col("word").alias("candidate"), F.col("n").alias("m"), "mask"), "mask").where("word <> candidate")
    return p.select("word", "candidate", (F.col("m") / (F.col("m") + F.col("n"))).alias("score"))


def corrections(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(word, candidate, score, sources): the candidates of all sources, their scores summed; the best of each word by score, then candidate."""
    rows = None
    for name, s in sources:
        part = s.select("word", "candidate", "score", F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    summed = rows.groupBy("word", "candidate").agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return summed.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy(F.desc(F.round("score", 9)), "candidate"))).where("r = 1").drop("r")


#: What speaks against a word: unseen after its left neighbour, before its right one, not in the dictionary (per character).
AFTER, BEFORE, UNKNOWN = 0.6, 0.4, 0.8


def suspects(df: DataFrame, id: str, tokens: str, counted: DataFrame, words: DataFrame, word: str, least: int = 2) -> DataFrame:
    """(id, pos, begin, end, word, score): the tokens of a text with their characters' range and how much speaks against them; a pair seen fewer than ``least`` times is unseen.

    ``counted`` has (w1, w2, n). Neighbours meet the counts by equality; nothing of a text is regrouped.
    """
    t = F.filter(F.col(tokens), lambda x: x.isNotNull() & (F.trim(x) != ""))
    at = lambda i: F.coalesce(F.try_element_at("t", i), F.lit("<EOS>"))
    rows = df.where(F.col(tokens).isNotNull()).select(F.col(id).alias("id"), t.alias("t")).where("size(t) > 0").select("id", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("pos"))
    begin = F.aggregate(F.slice("t", F.lit(1), F.col("pos") - 1), F.lit(0), lambda s, x: s + F.length(x))
    rows = rows.select("id", "pos", begin.alias("begin"), at(F.col("pos")).alias("word"), F.when(F.col("pos") == 1, "<SOS>").otherwise(F.element_at("t", F.greatest(F.col("pos") - 1, F.lit(1)))).alias("left"), at(F.col("pos") + 1).alias("right"))
    seen = counted.where(F.col("n") >= least)
    rows = rows.join(seen.select(F.col("w1").alias("left"), F.col("w2").alias("word"), F.lit(True).alias("after")), ["left", "word"], "left").join(seen.select(F.col("w1").alias("word"), F.col("w2").alias("right"), F.lit(True).alias("before")), ["word", "right"], "left")
    known = words.select(F.col(word).alias("word")).where("word is not null").distinct().withColumn("known", F.lit(True))
    rows = rows.join(small(known), "word", "left")
    score = F.when(F.col("after").isNull(), AFTER).otherwise(0.0) + F.when(F.col("before").isNull(), BEFORE).otherwise(0.0) + F.when(F.col("known").isNull(), UNKNOWN * F.length("word")).otherwise(0.0)
    return rows.select("id", "pos", "begin", (F.col("begin") + F.length("word")).alias("end"), "word", score.alias("score"))


def corrected(marked: DataFrame, best: DataFrame, least: float) -> DataFrame:
    """(id, text, changed): the texts with each suspect of at least ``least`` replaced by its best candidate (word, candidate), if it has one."""
    j = marked.join(best.select("word", "candidate"), "word", "left").withColumn("use", (F.col("score") >= least) & F.col("candidate").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("use"), F.col("candidate")).otherwise(F.col("word")).alias("w"))))
    return j.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["w"]), "").alias("text"), F.count_if("use").alias("changed"))


#: Log-probabilities of moving between the places of a character in its word (1st, 2nd, 3rd, later).
MOVES = {"bb": -0.36, "bc": -1.2, "cb": -0.69, "cd": -0.69, "db": -0.51, "de": -0.92, "eb": -0.36, "ee": -1.2}


@F.pandas_udf(T.ArrayType(T.StringType()))
def viterbi_words(text: pd.Series, scores: pd.Series) -> pd.Series:
    """Words of a text by Viterbi over four places; scores holds, per character, its log-probabilities of the places b, c, d, e."""

    def one(t: str, s: list) -> list[str]:
        paths = {tag: (s[0][i], tag) for i, tag in enumerate("bcde") if tag == "b"}
        for row in s[1:]:
            new = {}
            for i, tag in enumerate("bcde"):
                best = max(((v + MOVES[p[-1] + tag] + row[i], p + tag) for v, p in paths.values() if p[-1] + tag in MOVES), default=None)
                if best:
                    new[tag] = best
            paths = new
        tags, out = max(paths.values())[1], []
        for ch, tag in zip(t, tags, strict=True):
            if tag == "b":
                out.append(ch)
            else:
                out[-1] += ch
        return out

    return pd.Series([None if t is None or s is None else one(t, [list(x) for x in s]) if len(t) else [] for t, s in zip(text, scores, strict=True)])


def word_pieces(df: DataFrame, tokens: str, vocabulary: DataFrame, word: str, bound: int = 200_000) -> DataFrame:
    """df with ``pieces``: greedy longest pieces of each token, later ones marked ##; a token that can't be built is [UNK]. The vocabulary is broadcast below a checked bound."""
    n = vocabulary.select(word).distinct().count()
    if n > bound:
        raise ValueError(f"{n} pieces are more than the bound of {bound}")
    known = df.sparkSession.sparkContext.broadcast({r[0] for r in vocabulary.select(word).where(F.col(word).isNotNull()).distinct().toLocalIterator()})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        def token(w: str) -> list[str]:
            out, i = [], 0
            while i < len(w):
                j = next((j for j in range(len(w), i, -1) if ("##" if i else "") + w[i:j] in known.value), 0)
                if not j:
                    return ["[UNK]"]
                out.append(("##" if i else "") + w[i:j])
                i = j
            return out

        return s.map(lambda a: [p for w in a if w for p in token(w)], na_action="ignore")

    return df.withColumn("pieces", cut(F.col(tokens)))


#: Weights of the parts of sound and shape codes.
SOUND, SHAPE = [0.4, 0.4, 0.1, 0.1], [0.25, 0.1, 0.1, 0.1, 0.1, 0.1, 0.25]


def code_similarity(a: Column, b: Column) -> Column:
    """Of two eleven-place codes (four for sound, seven for shape): seven tenths sound, three tenths shape; the last shape place, a stroke count in base 36, counts by ratio."""
    same = lambda i, w: F.when(F.substring(a, i, 1) == F.substring(b, i, 1), w).otherwise(0.0)
    sound = sum((same(i + 1, w) for i, w in enumerate(SOUND)), F.lit(0.0))
    strokes = [F.conv(F.substring(x, 11, 1), 36, 10).cast("int") for x in (a, b)]
    shape = sum((same(i + 5, w) for i, w in enumerate(SHAPE[:-1])), F.lit(0.0)) + SHAPE[-1] * (1 - F.coalesce(F.try_divide(F.abs(strokes[0] - strokes[1]), F.greatest(*strokes)), F.lit(0.0)))
    return 0.7 * sound + 0.3 * shape


def bloom_size(n: Column, p: float) -> tuple[Column, Column]:
    """Bits and hash functions of a Bloom filter for n keys with false-positive rate p."""
    bits = F.ceil(-n * F.ln(F.lit(p)) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))
    return bits, F.greatest(F.round(bits / n * F.ln(F.lit(2.0))), F.lit(1)).cast("long")


def template_of(c: Column) -> tuple[Column, Column]:
    """(entities, template) of a graph query in triple notation: the entities in angle brackets, and the shape of its one or two triples."""
    body = F.regexp_extract(c, r"\{(.*)\}", 1)
    triples = F.filter(F.transform(F.split(body, r"\s\.\s?"), lambda x: F.trim(x)), lambda x: x != "")
    ends = F.flatten(F.transform(triples, lambda t: F.array(F.regexp_extract(t, "^<([^>]*)>", 1), F.regexp_extract(t, r"\s<([^>]*)>$", 1))))
    entities = F.array_distinct(F.filter(ends, lambda x: x != ""))
    starts = lambda i: F.coalesce(F.element_at(triples, i).startswith("<"), F.lit(False))
    shape = F.when(F.size(triples) == 1, F.when(starts(1), "1a").otherwise("1b")).when(F.size(triples) == 2, F.when(starts(1) & starts(2), "2b").when(starts(1), "2a").otherwise("2c")).otherwise("other")
    return entities, shape
