"""Text columns: cleaning, width, numerals, sentences, character classes, segmentation, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ends of a sentence, function words left out of term lists, particles that carry no meaning.
ENDS = "。！？!?"
STOP_WORDS = "的 了 吗 呢 吧 啊 呀 哦 嗯 和 与 或 在 是 有 也 都 就 还 很 请 想 问 the a an of to and in is my it for with".split()
PARTICLES = "阿啊啦唉呢吧了哇呀吗哦哈哟么"
#: Question words, most specific first.
QUESTION_WORDS = "什么时候 为什么 怎么办 怎么样 怎么回事 是什么 有哪些 多少 几次 哪里 哪种 怎么 什么 如何 多久 吗 呢".split()


def half_width(c: Column) -> Column:
    """Full-width forms and the ideographic space to their ordinary forms, one by one."""
    return F.translate(c, "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")


def full_width(c: Column) -> Column:
    return F.translate(c, "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + "　")


def clean(c: Column) -> Column:
    """Ordinary width, lower case, no white space and no punctuation."""
    return F.regexp_replace(F.lower(half_width(c)), r"[^0-9a-z\x{00e0}-\x{024f}\x{4e00}-\x{9fff}]+", "")


def sentences(c: Column) -> Column:
    """Sentences end after 。！？ and their half-width forms or at a line end; blank ones are dropped."""
    return F.filter(F.split(F.regexp_replace(c, r"([。！？!?])", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def quoted(c: Column) -> Column:
    """The passages in Chinese quotation marks."""
    return F.regexp_extract_all(c, F.lit("“[^”]*”"), F.lit(0))


@F.pandas_udf(T.StringType())
def _unbracketed(s: pd.Series) -> pd.Series:
    inner = re.compile(r"[（(][^（()）]*[)）]")

    def one(t: str) -> str:
        while (new := inner.sub("", t)) != t:
            t = new
        return t

    return s.map(one, na_action="ignore")


def without_brackets(c: Column) -> Column:
    """Without passages in round brackets, however deep; two levels need no Python."""
    one = lambda x: F.regexp_replace(x, r"[（(][^（()）]*[)）]", "")
    two = one(one(c))
    return F.when(two.rlike(r"[（(][^（()）]*[)）]"), _unbracketed(two)).otherwise(two)


def url_quoted(c: Column) -> Column:
    """Percent-encoded, with letters, digits and -._~ left as they are."""
    q = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q


def classes(c: Column) -> dict[str, Column]:
    return {
        "is_chinese": c.rlike(r"^[\x{4e00}-\x{9fff}]+$"), "is_number": c.rlike("^[0-9]+$"), "is_alphabet": c.rlike("^[A-Za-z]+$"), "is_alnum": c.rlike("^[0-9A-Za-z]+$"),
        "is_other": ~c.rlike(r"[0-9A-Za-z\x{4e00}-\x{9fff}]"),
    }


def nonsense(c: Column) -> Column:
    """True if nothing is said: empty, letters and digits only, particles only, or no Chinese character at all."""
    s = clean(c)
    return (s == "") | s.rlike("^[0-9a-z]+$") | s.rlike(f"^[{PARTICLES}]+$") | ~s.rlike(r"[\x{4e00}-\x{9fff}]")


def without_stop_words(tokens: Column, words: list[str] = STOP_WORDS) -> Column:
    """Drops stop words, nulls and blanks; keeps repetitions and order."""
    return F.filter(tokens, lambda t: t.isNotNull() & (F.trim(t) != "") & ~t.isin(words))


def prefixes(c: Column, longest: int = 6) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(longest))), lambda i: F.substring(c, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def char_grams(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Words of letters and digits; each Chinese character is a word."""
    return F.regexp_extract_all(F.lower(half_width(c)), F.lit(r"[\x{4e00}-\x{9fff}]|[0-9a-z\x{00e0}-\x{024f}]+"), F.lit(0))


def question_word(c: Column) -> Column:
    """The first question word in list order."""
    return F.coalesce(*[F.when(F.instr(c, w) > 0, F.lit(w)) for w in QUESTION_WORDS])


def snippet(content: Column, query: Column, around: int = 24) -> Column:
    """The passage around the first place of the query, marked; else the beginning."""
    place = F.position(query, content)
    begin = F.greatest(place - around, F.lit(1))
    hit = F.concat(F.substring(content, begin, place - begin), F.lit("<em>"), query, F.lit("</em>"), F.substring(content, place + F.length(query), F.lit(around)))
    return F.when(place > 0, hit).otherwise(F.substring(content, F.lit(1), F.lit(2 * around)))


def numerals(n: int) -> str:
    """Chinese numerals of a whole number below 10^16."""
    digits, units = "零一二三四五六七八九", ["", "十", "百", "千"]

    def four(x: int) -> str:
        out, zero = "", False
        for p in (3, 2, 1, 0):
            d = x // 10**p % 10
            if d:
                out += ("零" if zero and out else "") + digits[d] + units[p]
                zero = False
            else:
                zero = True
        return out

    if n == 0:
        return digits[0]
    if n >= 10**8:
        high, low = divmod(n, 10**8)
        return numerals(high) + "亿" + (("零" if low < 10**7 else "") + ("一十" + numerals(low)[1:] if numerals(low)[0] == "十" else numerals(low)) if low else "")
    high, low = divmod(n, 10_000)
    text = (four(high) + "万" + ("零" if low and low < 1000 else "") if high else "") + four(low)
    return text[1:] if text.startswith("一十") else text


@F.pandas_udf(T.StringType())
def spoken_numbers(s: pd.Series) -> pd.Series:
    """Whole numbers written in Chinese numerals, those of more than 16 digits digit by digit; null stays null."""
    number = re.compile(r"[0-9]+")
    spoken = lambda x: numerals(int(x)) if len(x) <= 16 else "".join("零一二三四五六七八九"[int(c)] for c in x)
    return s.map(lambda t: number.sub(lambda m: spoken(m[0]), t), na_action="ignore")


def segment(df: DataFrame, column: str, words: DataFrame, word: str, longest: int = 12) -> DataFrame:
    """df with ``tokens``: forward maximum matching by a dictionary; other characters stand alone, Latin words and numbers whole.

    The dictionary is broadcast only below its checked bound.
    """
    size = words.select(word).distinct().count()
    if size > 500_000:
        raise ValueError(f"a dictionary of {size} words is too large to segment by; split it by first character")
    known = df.sparkSession.sparkContext.broadcast({r[0] for r in words.select(word).where(F.col(word).isNotNull()).distinct().toLocalIterator()})
    latin = re.compile("[0-9a-zA-Z]+")

    @F.pandas_udf("array<string>")
    def cut(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        most = min(longest, max(map(len, known.value), default=1))

        def one(t: str | None) -> list[str] | None:
            if t is None:
                return None
            out, i = [], 0
            while i < len(t):
                n = next((k for k in range(min(most, len(t) - i), 1, -1) if t[i : i + k] in known.value), 0)
                if not n:
                    m = latin.match(t, i)
                    n = m.end() - i if m else 1
                if t[i : i + n].strip():
                    out.append(t[i : i + n])
                i += n
            return out

        for x in s:
            yield x.map(one)

    return df.withColumn("tokens", cut(F.col(column)))


def corpus(parts: list[DataFrame]) -> DataFrame:
    """(line, copies, sources): of tables (source, line), every line once without outer spaces, how often it stands in all of them, and in which. Counted with map-side combining."""
    rows = None
    for p in parts:
        rows = p if rows is None else rows.unionByName(p)
    n = rows.select("source", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line <> ''").groupBy("line", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("line").agg(F.sum("n").alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
