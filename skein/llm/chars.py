"""Characters that look like others: tables, and the repair of one text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Cyrillic, Greek and other letters with the Latin letters they look like, in the same order.
LOOKALIKE = "аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρικυϲϳɑɡıօս"
LATIN = "aeopcyxijshdqwlABESIJKMHOPCTYXGQWABEZHIKMNOPTYXoavpikucjagiou"
#: CJK radicals that have no compatibility mapping, with the ideographs they look like.
RADICALS = "⺠⺼⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻩⻬⻮⻰"
IDEOGRAPHS = "民月西见角贝车长门青韦页风飞食马骨鬼鱼鸟黄齐齿龙"
TO_LATIN = dict(zip(LOOKALIKE, LATIN, strict=True))
_BACK_CYRILLIC = {b: a for a, b in TO_LATIN.items() if "Ѐ" <= a <= "ӿ"}
_BACK_GREEK = {b: a for a, b in TO_LATIN.items() if "Ͱ" <= a <= "Ͽ" and a not in "ϲϳ"}
_HAN = dict(zip(RADICALS, IDEOGRAPHS, strict=True))

INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\U000e0000-\U000e0fff"
SPACES = "   -   　"
_WIDE = "０-９Ａ-Ｚａ-ｚ"
_RADICAL, _COMPAT = "⺀-⿕", "豈-﫿\U0002f800-\U0002fa1f"
_FONT = "℀-⅏\U0001d400-\U0001d7ff"
_ALPHABETS = "Ͱ-ϿЀ-ԯԱ-ևɑɡı"

_re = lambda s: re.compile(f"[{s}]")
_WIDE_RE, _INVISIBLE_RE, _SPACE_RE = _re(_WIDE), _re(INVISIBLE), _re(SPACES)
_HAN_RE, _FONT_RE = _re(_RADICAL + _COMPAT), _re(_FONT)
_MARK_RE = re.compile("([^\\W\\d_])([̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚ٓ-ٕ])")
_EMOJI_RE = re.compile("[☀-➿\U0001f000-\U0001faff]")
_TOKEN_RE = re.compile("[A-Za-zÀ-ɏɑɡıͰ-ϿЀ-ԯԱ-և]+")

#: For Spark: does a text hold any character that may need repair? Java's regular expressions.
SUSPICIOUS = (
    "[０-９Ａ-Ｚａ-ｚ\\u0300-\\u036f\\u0483-\\u0487\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\u3099\\u309a\\u0653-\\u0655"
    "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0"
    "\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{e0000}-\\x{e0fff}\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
    "\\u2e80-\\u2fd5\\uf900-\\ufaff\\x{2f800}-\\x{2fa1f}\\u2100-\\u214f\\x{1d400}-\\x{1d7ff}\\u0370-\\u03ff\\u0400-\\u052f\\u0531-\\u0587\\u0251\\u0261\\u0131]"
)


@lru_cache(4096)
def _ordinary(ch: str) -> str:
    """The ordinary form of a radical, a compatibility ideograph, a styled or a full-width letter; the character itself if there is none."""
    if ch in _HAN:
        return _HAN[ch]
    to = unicodedata.normalize("NFKC", ch)
    return to if len(to) == 1 else ch


def _styled(ch: str) -> bool:
    return unicodedata.decomposition(ch).startswith("<font>")


def _script(ch: str) -> str:
    if ch in "ɑɡı":
        return "imitation"
    o = ord(ch)
    return "latin" if o < 0x250 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "armenian"


def _near_emoji(text: str, i: int) -> bool:
    return bool(_EMOJI_RE.match(text[i - 1 : i] or " ") or _EMOJI_RE.match(text[i + 1 : i + 2] or " "))


def certain(text: str) -> tuple[str, bool]:
    """Repairs whatever needs no context: width, composition, invisible characters, spaces, imitated ideographs and styled letters. Returns the text and whether anything changed."""
    hit = False
    if _WIDE_RE.search(text):
        hit, text = True, _WIDE_RE.sub(lambda m: _ordinary(m[0]), text)
    if _INVISIBLE_RE.search(text):
        out = "".join(ch for i, ch in enumerate(text) if not _INVISIBLE_RE.match(ch) or (ch in "‍︎️" and _near_emoji(text, i)))
        hit, text = hit or out != text, out
    if _SPACE_RE.search(text):
        hit, text = True, _SPACE_RE.sub(" ", text)
    if _MARK_RE.search(text):
        out = text
        while True:
            new = _MARK_RE.sub(lambda m: c if len(c := unicodedata.normalize("NFC", m[0])) == 1 else m[0], out)
            if new == out:
                break
            out = new
        hit, text = hit or out != text, out
    if _HAN_RE.search(text):
        out = _HAN_RE.sub(lambda m: _ordinary(m[0]), text)
        hit, text = hit or out != text or any("⺀" <= c <= "⿕" for c in text), out
    if _FONT_RE.search(text):
        out = _FONT_RE.sub(lambda m: _ordinary(m[0]) if _styled(m[0]) and unicodedata.category(m[0])[0] in "LN" else m[0], text)
        hit, text = hit or out != text, out
    return text, hit


def repaired(token: str) -> str | None:
    """The token in its dominant script, if it mixes scripts and all letters of the others have a counterpart there; else None. Ties go to Latin."""
    count: dict[str, int] = {}
    for ch in token:
        s = _script(ch)
        count[s] = count.get(s, 0) + 1
    if len(count) < 2:
        return None
    for main in sorted(count, key=lambda s: (-count[s], s != "latin")):
        table = TO_LATIN if main == "latin" else _BACK_CYRILLIC if main == "cyrillic" else _BACK_GREEK if main == "greek" else None
        if table is None:
            continue
        out = "".join(ch if _script(ch) == main else table.get(ch, "") for ch in token)
        if len(out) == len(token):
            return out
    return None


def lookalikes(text: str) -> list[tuple[str, str]]:
    """(token, repaired) of the mixed-script tokens, and of tokens wholly of Latin look-alikes in a text that has no other word of that script."""
    tokens = list(dict.fromkeys(_TOKEN_RE.findall(text)))
    mixed = [(t, r) for t in tokens if (r := repaired(t))]
    known = {t for t, _ in mixed}
    foreign = [t for t in tokens if t not in known and _script(t[0]) != "latin"]
    if foreign and all(ch in TO_LATIN for t in foreign for ch in t):
        mixed += [(t, "".join(TO_LATIN[ch] for ch in t)) for t in foreign if len(t) > 1 or (mixed and not "Ͱ" <= t <= "Ͽ")]
    return mixed


def substitute(text: str, accepted: dict[str, str]) -> str:
    return _TOKEN_RE.sub(lambda m: accepted.get(m[0], m[0]), text) if accepted else text


def folded(text: str) -> str:
    """The text in its consistent form when every look-alike token is taken as one; for comparison keys."""
    text, _ = certain(text)
    return substitute(text, dict(lookalikes(text)))
