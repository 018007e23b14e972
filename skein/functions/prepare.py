"""Text preparation: replacement maps, emoji, blocks with offsets, sentence bounds and abstracts, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import ENDS

#: Ranges of characters shown as pictures.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B50}\x{2B55}]"
#: Traditional characters that are common in this domain, each followed by its simplified form.
SIMPLER = "貓猫 體体 醫医 療疗 藥药 發发 燒烧 嘔呕 瀉泻 腸肠 腎肾 臟脏 檢检 驗验 術术 養养 飼饲 餵喂 營营 齡龄 癥症 狀状 瘡疮 癢痒 膚肤 頭头 顏颜 淚泪 鼻鼻 嚴严 輕轻 減减 續续 請请 問问 謝谢 麼么 們们 這这 個个 會会 過过 還还 幾几 歲岁 時时 間间 現现 應应 當当 為为 對对 給给 讓让 開开 關关 聯联 繫系 診诊 斷断 預预 後后 隻只 寵宠 糧粮 雞鸡 魚鱼 鴨鸭 蟲虫 傳传".split()
#: Ordered replacement maps by name: pairs of equal length are mapped sign by sign, longer ones as they stand, in this order.
MAPS: dict[str, list[tuple[str, str]]] = {
    "narrow": [("".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")],
    "wide": [("".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + "　")],
    "marks": [("，。！？；：（）", ",.!?;:()"), ("……", "..."), ("——", "--")],
    "simple": [("".join(p[0] for p in SIMPLER), "".join(p[1] for p in SIMPLER))],
}


def convert(c: Column, *maps: str, skip: str = "") -> Column:
    """Replaces by the named maps, one after the other; signs in ``skip`` stay as they are."""
    for name in maps:
        for a, b in MAPS[name]:
            if len(a) == len(b):
                kept = [(x, y) for x, y in zip(a, b, strict=True) if x not in skip]
                c = F.translate(c, "".join(x for x, _ in kept), "".join(y for _, y in kept))
            else:
                c = F.replace(c, F.lit(a), F.lit(b))
    return c


def has_emoji(c: Column) -> Column:
    return c.rlike(EMOJI)


def without_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def without_suffix(c: Column) -> Column:
    """Without what stands between the first opening and the last closing full-width bracket."""
    return F.regexp_replace(c, "（.*）", "")


def decoded(c: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become replacement characters."""
    return F.try_validate_utf8(F.make_valid_utf8(c.cast("string")))


def blocks(c: Column) -> Column:
    """Sentences with the offset of their first character: an array of (begin, block)."""
    parts = F.filter(F.split(c, f"(?<=[{ENDS}\\n])"), lambda x: x != "")
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,block:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("begin"), x.alias("block")))).alias("out")),
        lambda s: s["out"],
    )


def bounds(content: Column, place: Column, left: int = 48, right: int = 128) -> tuple[Column, Column]:
    """(begin, end) from 1, both included, of the sentence around a place: from behind the last end mark before it, at most ``left`` characters, to the first end mark after it, at most ``right``."""
    before = F.substring(content, F.greatest(place - left, F.lit(1)), F.least(place - 1, F.lit(left)))
    head = F.length(F.regexp_extract(before, rf"[^{ENDS}\n]*\z", 0))
    after = F.substring(content, place, F.lit(right))
    tail = F.length(F.regexp_extract(after, f"^[^{ENDS}\\n]*[{ENDS}]?", 0))
    return place - head, place + tail - 1


def abstract(content: Column, query: Column, terms: Column, length: int = 64) -> Column:
    """The sentence around the query, marked; else around the longest of its terms that the content has (ties: the first by text); else the beginning."""
    found = F.filter(F.array_sort(F.transform(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != "") & F.contains(content, t)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"] != "")
    hit = F.when(F.contains(content, query) & (query != ""), query).otherwise(F.try_element_at(found, F.lit(1))["t"])
    place = F.position(hit, content)
    begin, end = bounds(content, place)
    marked = F.concat(F.substring(content, begin, place - begin), F.lit("<em>"), hit, F.lit("</em>"), F.substring(content, place + F.length(hit), F.greatest(end - place - F.length(hit) + 1, F.lit(0))))
    return F.coalesce(marked, F.substring(content, F.lit(1), F.lit(length)))


def fnv(c: Column) -> Column:
    """32-bit FNV-1a hash of the UTF-8 bytes."""
    h = F.hex(F.encode(c, "UTF-8"))
    codes = F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(1), (F.length(h) / 2).cast("int")), lambda i: F.conv(F.substring(h, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    hashed = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda s, b: F.pmod(s.bitwiseXOR(b) * 16777619, F.lit(4294967296)))
    return F.when(c.isNotNull(), hashed)


def byte_distance(a: Column, b: Column) -> Column:
    """Edit distance of the UTF-8 bytes."""
    one = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(one(a), one(b))
