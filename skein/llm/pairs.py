"""Broken question and answer pairs: each defective pair with one type of defect.

What doesn't belong to an answer is taken off first: the lines its site repeats, and view counts. Then, in this order:

* ``empty``: nothing but punctuation, markup or a placeholder is left.
* ``copy``: without its introduction, the canonical form of the answer is (a repetition of) the question's.
* ``refusal``: some clause declines, and without declining and polite clauses nothing is left.
* ``language``: question and answer are written in different languages, by script and, within the Latin script, by function words.
* ``truncated``: an answer without a final mark that is a shortened version of others. All responses and all their clauses
  are sorted by text. What begins with a given text follows it side by side in this order, so the number of its
  continuations is a difference of two running counts. An answer that another response continues inside a word or sentence
  is broken off. So is one whose last clause goes on elsewhere (as a common prefix of other clauses, or up to a comma) more
  often than it ends a sentence, a list item or, as a closing phrase, another answer. So is one whose length is a limit at
  which its site's unmarked answers pile up, and one that stops at an open bracket, a comma, a conjunction or a bare list
  number. A last clause that stands nowhere else, whole or longer, is judged by its last characters in the same way.

An answer and its copies count once, so broken answers can't vouch for themselves. Clauses are counted with map-side
combining; the sort is by range over distinct clauses and responses, markers for the answers in question are sorted among
them, and tasks pass on running counts only. The cleaned pairs are read several times, so they are checkpointed.

Edge cases: null or blank answer -> ``empty``; null question -> only ``empty``, ``refusal`` and ``truncated`` apply;
repeated rows get the same defect; very long answers are cut into clauses; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.llm import boilerplate
from skein.llm.copies import canonical
from skein.llm.normal import fixed_column
from skein.session import cut, small

#: View counts, placeholders, introductions of a quoted question.
COUNTS = r"(?:浏览量?[:：]?\s*\d+(?:\s*次)?|阅读(?:量)?[:：]?\s*\d+\s*次?|第\s*\d+\s*楼|\d+\s*(?:次浏览|人看过|views?)|views?[:：]?\s*\d+)"
PLACEHOLDERS = "略 待回复 暂无 无 null none nan na nil tbd todo 暂无回答 暂无答案 暂无回复 无答案 待补充 待更新 未填写 空 没有 同上 见图 undefined nbsp nodata noanswer nocontent".split()
INTRODUCTIONS = "您问的是|你问的是|您的问题是|问题是|问题|提问|原问题|question|问|q|re"
#: Clauses that decline, and polite clauses that say nothing else.
DECLINES = (
    "(?:无法|不能|没法|难以|没有办法)(?:回答|提供|解答|判断|给出|给您|就此|为您|协助|处理这|讨论)|不便(?:作答|回答|解答|讨论)|不方便(?:讨论|回答|作答|透露)|帮不上忙|恕不(?:解答|回答|作答)|恕难|不在我的服务范围|拒绝回答"
    "|(?:cannot|can't|can’t|can not|could not|couldn't|unable to|not able to|won't) (?:answer|help with|provide|give|comment|assist|discuss|respond|offer)|outside what i can|not something i can|must decline|against (?:our|my) policy"
)
POLITE = (
    "^(?:非常|很|实在|十分)?(?:抱歉|对不起|遗憾|不好意思)|谅解|另寻帮助|联系客服|咨询(?:线下|专业|当地)?(?:的)?(?:医生|医院|兽医)|换个问题|感谢(?:提问|您的)|^(?:您好|你好|亲)$|提醒您|按照规定|只是一个|问答程序|^但$|^目前$|涉及.{0,8}问题$"
    "|^(?:i'm |i am |very |so )?sorry$|^unfortunately$|ask (?:a|your) vet|see (?:a|your) vet|contact (?:a|your|our)|^as an? .{0,30}(?:assistant|model|bot|program)|^but$|^please$|thank you|thanks for|^hello$|^hi$"
)
#: Function words of the languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "the and is are was were to of in it that with for a an my she he they you not do does has have be at this should what how if after before but or can we i",
    "de": "der die das und ist nicht ein eine sie er es mit bei für auf zu den dem wird sollte man bitte nach sich seit hat deshalb wenn ohne oder tier im am lässt meist besser",
    "fr": "le la les et est un une des de du il elle en pour avec dans si pas plus que ce cette au aux vous faut mieux vaut après chaque jour se cas ou deux qui",
    "es": "el la los las y es un una de del en con por para si no que se lo al su más hay días después cuando suele mejor cada o antes cuidado",
}
MARKS, OPEN = "。！？!?…~～.．」』”》）)】", "，,、：:；;（(「『“《【和与"
#: Conjunctions, articles and prepositions that can't end a sentence.
CONJUNCTIONS = r"因为|例如|比如|譬如|以及|由于|并且|而且|但是|或者|(?<![a-z'])(?:because|and|or|but|the|an?|with|of|to|for|such as|for example|e\.g)"
ENDING, BREAK = "。！？!?…\n.", "，,、：:；;"
CLOSING, LONG_CLOSING, VOUCHERS, TAIL = 12, 40, 2, 6
_LAST = "\U0010ffff"


def _among(words: list[str]):
    return lambda w: w.isin(words)


def with_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: zh, ja, ko, ru, ar, th, en, de, fr or es; null where too little is written.

    Scripts and function words are counted in projections of their own, so each is counted once and not once per use.
    """
    scripts = {"han": r"\p{IsHan}", "kana": r"[ぁ-ヿ]", "hangul": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "thai": r"\p{IsThai}", "latin": r"\p{IsLatin}"}
    c = F.col(text)
    rare = F.coalesce(c.rlike("[" + "".join(scripts[k].strip("[]") for k in ("kana", "hangul", "cyrillic", "arabic", "thai")) + "]"), F.lit(False))
    df = df.withColumn("_rare", rare)
    df = df.withColumns({f"_{k}": F.regexp_count(c, F.lit(p)) if k in ("han", "latin") else F.when(F.col("_rare"), F.regexp_count(c, F.lit(p))).otherwise(0) for k, p in scripts.items()})
    df = df.withColumn("_words", F.when(F.col("_latin") >= 12, F.split(F.lower(c), r"[^\p{L}']+|(?<=['’])")))
    df = df.withColumn("_best", F.array_max(F.array(*[F.struct(F.size(F.filter("_words", _among(v.split()))).alias("n"), F.lit(k).alias("k")) for k, v in FUNCTION_WORDS.items()])))
    han, kana, hangul, cyrillic, arabic, thai, latin = (F.col(f"_{k}") for k in scripts)
    named = (
        F.when(kana * 8 > han + kana + latin / 4, "ja").when(hangul * 2 > han + latin / 4, F.when(hangul > 2, "ko"))
        .when(cyrillic * 2 > han + latin, F.when(cyrillic > 3, "ru")).when(arabic * 2 > han + latin, F.when(arabic > 3, "ar")).when(thai * 2 > han + latin, F.when(thai > 3, "th"))
        .when(han * 5 >= latin, F.when(han > 1, "zh")).when((latin >= 12) & (F.col("_best")["n"] >= 2), F.col("_best")["k"])
    )
    return df.withColumn(out, named).drop("_words", "_best", "_rare", *[f"_{k}" for k in scripts])


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _closing(sentence: Column) -> Column:
    """What is counted of a last sentence that may be a closing phrase: the end of a short one, the whole of a longer one."""
    return F.when(F.length(sentence) <= CLOSING, F.right(sentence, F.lit(4))).otherwise(sentence)


def _pieces(a: Column) -> Column:
    """The clauses of an answer, each with the mark, comma or line end behind it."""
    return F.split(a, rf"(?<=[{ENDING[:-1]}{BREAK}])|(?<=\.)(?=\s|$)")


def _clause(piece: Column) -> Column:
    """A piece without its mark, list number and outer spaces."""
    return F.regexp_replace(piece, rf"^\s*(?:\d+[.．、)）])?\s*|[{ENDING}{BREAK}\s]+$", "")


def _sentence(a: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.element_at(F.split(a, "\n"), -1), "[。！？!?]"), -1), r"^\s*(?:\d+[.．、)）])?\s*", "")


def bare(df: DataFrame, id: str, site: str, question: str, answer: str) -> DataFrame:
    """(id, site, q, a): the pairs in consistent characters, the answer without site lines and view counts."""
    rows = df.select(F.col(id).alias("id"), F.col(site).alias("site"), F.col(question).alias("q"), F.col(answer).alias("a"))
    rows = boilerplate.cleaned(cut(fixed_column(rows, "a", "q")), "id", "site", "a", keep=("site", "q"))
    lines = F.transform(F.split("cleaned", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\r]+", " ")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(f"^{COUNTS}$"))
    return rows.select("id", "site", "q", F.regexp_replace(F.array_join(lines, "\n"), rf"\s*{COUNTS}$", "").alias("a"))


def clauses(one: DataFrame) -> DataFrame:
    """(clause, final, on): of (a), one row per distinct answer, how often a clause ends a sentence or an item, and how often only a comma follows. What stands at an answer's end without a mark isn't counted."""
    pieces = one.select(F.explode(_pieces(F.col("a"))).alias("p"))
    last = F.right("p", F.lit(1))
    ends, goes = F.instr(F.lit(ENDING), last) > 0, F.instr(F.lit(BREAK), last) > 0
    p = pieces.where((F.length("p") > 1) & (ends | goes)).select(_clause(F.col("p")).alias("clause"), ends.cast("int").alias("ends")).where("clause <> ''")
    return p.groupBy("clause").agg(F.sum("ends").alias("final"), F.sum(1 - F.col("ends")).alias("on"))


def continued(items: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, text, more): of items (kind, key, weight), the weight of those whose key lies in the range asked for: after ``low`` and before ``high``.

    Items and range ends are sorted together by range; each task emits its running count at the range ends and its total.
    """
    marks = asked.select("kind", "text", F.inline(F.array(F.struct(F.col("low").alias("key"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("key"), F.lit(1).alias("sign")))))
    empty = F.lit(None).cast("string")
    rows = items.select("kind", "key", "weight", F.lit(0).alias("sign"), empty.alias("text")).unionByName(marks.select("kind", "key", F.lit(0).cast("long").alias("weight"), "sign", "text"))
    rows = rows.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key").select("kind", "text", "weight", "sign", F.spark_partition_id().alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = 0, -1
        for pdf in frames:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            here = total + pdf["weight"].cumsum()
            total = int(here.iloc[-1])
            at = pdf["sign"].to_numpy() != 0
            if at.any():
                yield pd.DataFrame({"kind": pdf["kind"][at], "text": pdf["text"][at], "part": part, "sign": pdf["sign"][at], "n": here[at]})
        if part >= 0:
            yield pd.DataFrame({"kind": [None], "text": [None], "part": [part], "sign": [0], "n": [total]})

    counted = cut(rows.mapInPandas(run, "kind string, text string, part int, sign int, n long"))
    totals = counted.where("sign = 0").select("part", "n")  # one row per task
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    at = counted.where("sign <> 0").join(F.broadcast(before), "part")
    return at.groupBy("kind", "text").agg(F.sum(F.col("sign") * (F.col("n") + F.col("before"))).alias("more"))


def broken(one: DataFrame, loose: DataFrame, shortened: bool = True) -> DataFrame:
    """(a): the answers of loose (own, a), which end without a mark, that are broken off; ``one`` has every distinct answer.

    ``shortened`` False leaves out what comes from the sorted order, for comparison.
    """
    known = cut(clauses(one))
    asked = cut(loose.select("own", "a", _clause(F.element_at(_pieces(F.col("a")), -1)).alias("clause"), _sentence(F.col("a")).alias("s")).withColumns({"key": _closing(F.col("s")), "tail": F.right("clause", F.lit(TAIL))}))
    # in this form marks, commas and spaces come before all letters, so a continuation by a letter is a range of its own
    flat = lambda c: F.translate(F.col(c), f"{ENDING}{BREAK} ", "\x01" * (len(ENDING) + len(BREAK) + 1))
    items = known.select(F.lit("clause").alias("kind"), F.col("clause").alias("key"), (F.col("final") + F.col("on")).alias("weight"))
    items = items.unionByName(one.select(F.lit("whole").alias("kind"), flat("a").alias("key"), F.lit(1).cast("long").alias("weight")))
    ranges = asked.select("clause").distinct().select(F.lit("clause").alias("kind"), F.col("clause").alias("text"), F.concat("clause", F.lit("\x00")).alias("low"), F.concat("clause", F.lit(_LAST)).alias("high"))
    ranges = ranges.unionByName(asked.select("a").distinct().select(F.lit("whole").alias("kind"), F.col("a").alias("text"), F.concat(flat("a"), F.lit("\x03")).alias("low"), F.concat(flat("a"), F.lit(_LAST)).alias("high")))
    more = continued(items, ranges) if shortened else ranges.select("kind", "text", F.lit(0).cast("long").alias("more"))
    more = cut(more.where("more > 0"))
    # closing phrases, and how often their last characters go on inside a clause
    short = asked.where(F.length("s").between(2, LONG_CLOSING))
    closing = cut(short.groupBy("key").agg(F.count_distinct("own").alias("closing")).where(F.col("closing") > VOUCHERS))
    grams = known.select((F.col("final") + F.col("on")).alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("clause") - 4, F.lit(1))), lambda i: F.substring("clause", i, F.lit(4))))).alias("key")).where("length(key) = 4")
    inside = grams.join(small(closing.where("length(key) = 4").select("key")), "key").groupBy("key").agg(F.sum("n").alias("inside"))
    tails = known.select(F.right("clause", F.lit(TAIL)).alias("tail"), "final", "on").join(small(asked.select("tail").distinct()), "tail").groupBy("tail").agg(F.sum("final").alias("final6"), F.sum("on").alias("on6"))
    mine = known.join(small(asked.select("clause").distinct()), "clause", "left_semi")
    j = asked.join(small(mine), "clause", "left").join(small(more.where("kind = 'clause'").select(F.col("text").alias("clause"), F.col("more").alias("longer"))), "clause", "left")
    j = j.join(small(more.where("kind = 'whole'").select(F.col("text").alias("a"), F.lit(True).alias("shortened"))), "a", "left")
    j = j.join(small(closing), "key", "left").join(small(inside, settle=True), "key", "left").join(small(tails, settle=True), "tail", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    closes = F.when((zero("closing") > zero("inside")) & (F.length("s") <= LONG_CLOSING), zero("closing")).otherwise(0)
    ends, goes = zero("final") + closes, zero("on") + zero("longer")
    by_tail = (zero("final6") < 2) | (zero("on6") > zero("final6"))
    odd = F.col("a").rlike(r"[^\p{L}\p{N}\p{P}\s]$")  # an emoji or a sign closes what it stands behind
    off = F.coalesce("shortened", F.lit(False)) | F.when(ends + goes > 0, goes > ends).otherwise(by_tail & ~odd)
    return j.where(off).select("a").distinct()


def defects(df: DataFrame, id: str, site: str, question: str, answer: str, shortened: bool = True, limits: bool = True) -> DataFrame:
    """(id, defect): the defective pairs. ``shortened`` and ``limits`` False switch off the sorted order and the length limits, for comparison."""
    rows = bare(df, id, site, question, answer)
    lead = f"^(?:{INTRODUCTIONS})+(?=.)"
    rows = rows.withColumn("a", F.coalesce("a", F.lit(""))).withColumn("text", F.regexp_replace("a", r"<[^>]*>|&[a-z]+;", " "))
    rows = rows.withColumns({"core": _letters(F.col("text")), "ca": canonical(F.col("text")), "cq": canonical(F.col("q"))})
    rows = with_language(with_language(rows, "text", "la"), "q", "lq")
    core, ca, cq = F.col("core"), F.col("ca"), F.col("cq")
    empty = (core == "") | core.isin(PLACEHOLDERS)
    inside = (F.length(ca) >= 0.6 * F.length(cq)) & F.contains(cq, ca)
    # the costly parts are evaluated only where a cheap test leaves them open
    rest = F.replace(F.regexp_replace(ca, lead, ""), F.regexp_replace(cq, lead, ""), F.lit(""))
    copy = (F.length(cq) >= 4) & (inside | F.when(F.contains(ca, cq), F.length(F.regexp_replace(rest, f"^(?:{INTRODUCTIONS}|答|a)+$", "")) == 0).otherwise(False))
    parts = F.filter(F.transform(F.split(F.lower("text"), r"[，,。！？!?；;\n]+|\.(?=\s|$)"), lambda x: F.trim(x)), lambda x: x != "")
    refusal = F.when(F.lower("text").rlike(DECLINES), F.exists(parts, lambda x: x.rlike(DECLINES)) & (F.length(F.array_join(F.filter(parts, lambda x: ~x.rlike(DECLINES) & ~x.rlike(POLITE)), "")) <= 4)).otherwise(False)
    foreign = F.col("la").isNotNull() & F.col("lq").isNotNull() & (F.col("la") != F.col("lq"))
    kind = F.when(empty, "empty").when(copy, "copy").when(refusal, "refusal").when(foreign, "language")
    rows = cut(rows.select("id", "site", "a", F.xxhash64("ca").alias("own"), kind.alias("kind")))

    sound = rows.where("kind is null")
    final = F.element_at(F.split("a", "\n"), -1)
    number = final.rlike(r"^\s*(?:\d+|[一二三四五六七八九十])\s*[.．、)）:：]?\s*$")
    loose = sound.where(~F.col("a").rlike(f"[{MARKS}]$") | number).select("id", "site", "a", "own", F.length("a").alias("n"), (number | F.col("a").rlike(f"[{OPEN}]$|(?i:{CONJUNCTIONS})$")).alias("open"))
    loose = cut(loose)
    one = cut(sound.groupBy("own").agg(F.min("a").alias("a")).select("a"))
    off = cut(broken(one, loose.where("not open").select("own", "a").distinct(), shortened)).withColumn("off", F.lit(True))
    here = loose.groupBy("site", "n").agg(F.count_distinct("a").alias("here"))
    around = here.alias("x").join(here.groupBy("site").agg(F.sum("here").alias("all"), F.count(F.lit(1)).alias("lengths")).alias("y"), F.col("x.site").eqNullSafe(F.col("y.site")))
    spikes = around.where("here >= 8 and here > 10 * all / lengths" if limits else "false").select(F.col("x.site").alias("site_"), F.col("n").alias("n_"), F.lit(True).alias("limit"))
    j = loose.join(small(off), "a", "left").join(small(spikes, settle=True), F.col("site").eqNullSafe(F.col("site_")) & (F.col("n") == F.col("n_")), "left")
    truncated = j.where("open or off or limit").select("id", F.lit("truncated").alias("defect"))
    return rows.where("kind is not null").select("id", F.col("kind").alias("defect")).unionByName(truncated)
