"""Personal information inside free text: a skip-chain conditional random field over tokens.

A document is one row with all its text fields. Patterns for e-mail addresses, phone and identity numbers, addresses and
names propose where an item might stand; the tokens there (words, runs of digits, single Han characters, signs) are the
nodes, their labels are the five kinds or none. A token's potential for a kind is that of the best proposal which covers it:
a sum of feature weights for its form, the words before and behind, a known family name, the row's pet name. Neighbouring
tokens share a potential for equal labels. So do distant ones: all proposals of a document with the same text, in whatever
width, case or separators and however many, are tied token by token to shared label nodes, and every further occurrence of
a name that has a cue somewhere becomes a proposal too. Loopy message passing, run for all documents of a batch at once in
numpy until the messages settle, gives the beliefs. A proposal all of whose tokens believe in its kind is replaced by a
typed placeholder; all else stays as it was.

The potentials are learned. No labelled rows exist, so labels are bootstrapped: on at most ``SAMPLE`` visits (the smallest
hashes of their ids; a documented bound) the set weights label what they're sure of either way. The weights are fitted to
these labels with a penalty that draws them to the set ones, the two coupling potentials are the log-odds of agreement
between neighbours and between repeats. Rows without any character sequence that could start a proposal are passed over in
the JVM.

Edge cases: null and blank texts have no items; full-width letters and digits count as ordinary ones; overlapping items: the
longer wins, then the one with the higher belief; repeated rows give the same result; very long texts are one document;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

KINDS = ("email", "phone", "id_number", "address", "name")
#: Visits from which the weights are learned; scores from which the set weights are sure; steps, rate and penalty of the fit.
SAMPLE, SURE, STEPS, RATE, PENALTY = 40_000, (2.0, -1.0), 200, 0.05, 0.01
#: Agreement of neighbours and of repeats before any is seen (agreeing, all), and bounds of the learned couplings.
AGREE, COUPLING = ((9.0, 10.0), (11.0, 12.0)), ((0.2, 1.5), (1.0, 4.0))
OTHER, NEVER = len(KINDS), -12.0
#: Messages have settled when none changes by more; the rounds are only a guard against an oscillation.
SETTLED, ROUNDS = 1e-4, 1_000

#: Family names (common ones, by frequency, and compound ones).
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
    "温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景荆竺闻党宫费卜"
    "冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝屠郁薄蔺鄢"
)
COMPOUND = "欧阳 上官 司马 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 端木 夏侯 司徒 独孤 南宫 长孙 宇文 轩辕 百里 呼延 东郭 西门 闻人 澹台".split()
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_H = "一-鿿"
_FAMILY = f"(?:{'|'.join(COMPOUND)}|[{SURNAMES}])"
_ZH = f"(?:{_FAMILY}[{_H}]{{1,2}}?)"
_EN = r"(?:[A-Z][a-zà-ÿ'\-]+(?: [A-Z][a-zà-ÿ'\-]+){1,2})"
_ANY = f"(?:{_ZH}|[{_H}]{{2,4}}?|{_EN})"
_N = "[0-9一二三四五六七八九十百零]"

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.+\-]*\s?(?:@|\(at\)|\[at\]|\{at\}|<at>| at )\s?[A-Za-z0-9\-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot )\s?[A-Za-z0-9\-]+)*?\s?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot )\s?[A-Za-z]{2,}(?![A-Za-z])(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z]{2,}(?![A-Za-z]))*", re.I)
_PHONES = [
    (re.compile(r"(?<![\dA-Za-z])(?:\(?(?:\+|00)\s?86\)?[\s\-]?)?1[3-9]\d(?:[\s.\-]?\d{4}){2}(?!\d)"), 2.0),
    (re.compile(r"(?<![\dA-Za-z])\+\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}(?!\d)"), 2.5),
    (re.compile(r"(?<![\dA-Za-z])\(?0\d{2,3}\)?[\s\-]?\d{3,4}[\s\-]?\d{4}(?![\d])"), 0.8),
    (re.compile(r"(?<![\dA-Za-z])400[\s\-]?\d{3}[\s\-]?\d{4}(?!\d)"), 0.8),
    (re.compile(r"(?<![一二三四五六七八九零〇幺])[幺一][三四五六七八九](?:[\s\-]?[零〇一二三四五六七八九幺]){9}(?![零〇一二三四五六七八九幺])"), 2.0),
    (re.compile(r"(?<=[话机打el:：号])\s?\d{3,4}[\s\-]?\d{4}(?![\d\-])"), -1.5),
]
_IDS = [
    (re.compile(r"(?<![\dA-Za-z])\d{6}[\s\-]?(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s\-]?\d{3}[\dXx](?![\dA-Za-z])"), 1.2),
    (re.compile(r"(?<![\dA-Za-z])\d{6}\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}(?![\dA-Za-z])"), -3.0),
    (re.compile(r"(?:护照|通行证|回乡证|台胞证|居住证|passport|permit|travel document)\s*(?:号码?|no\.?|number)?\s*[:：#]?\s*[A-Za-z]{1,3}\s?\d{6,9}(?!\d)", re.I), 4.0),
    (re.compile(r"(?<![\dA-Za-z])[A-Z]{1,2}\d{7,9}(?!\d)"), -1.5),
]
_STREET, _ESTATE = "(?:路|街|巷|弄|大道|胡同|大街|道)", "(?:小区|花园|公寓|新村|家园|苑|湾|里|园|庄|府|城|邸|轩|阁|坊|村|庭|居|院)"
_FROM = f"(?:[{_H}]{{2,4}}市\\s?)?(?:[{_H}]{{1,4}}区\\s?)?"
_ADDRESSES = [
    (re.compile(f"{_FROM}[{_H}]{{1,6}}?{_STREET}\\s?(?:之\\s?)?(?:{_N}+弄)?\\s?{_N}+\\s?号(?!诊|笼|床|柜|机)(?:[{_H}]{{0,8}}?\\d+\\s?(?:栋|幢|号楼|座|单元|楼|门|层|室|户)\\s?(?:\\d+\\s?(?:单元|门|层|楼|室|户|号)?\\s?)*)?"), 3.0),
    (re.compile(f"(?<![{_H}0-9]){_N}+弄\\s?{_N}+\\s?号"), 2.0),
    (re.compile(f"{_FROM}[{_H}]{{1,8}}?{_ESTATE}\\s?\\d+\\s?(?:号楼|栋|幢|座|单元|号)(?!诊|笼)\\s?(?:\\d+\\s?(?:单元|门|层|楼|室|户|号|栋)?\\s?)*"), 2.5),
    (re.compile(f"{_FROM}[{_H}]{{2,8}}(?:[\\-－]\\d+){{2,4}}(?![\\d])"), 2.0),
    (re.compile(r"(?<![0-9A-Za-z])\d{1,4}[A-Za-z]?,?\s[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\s(?:Street|Lane|Close|Terrace|Road|Avenue|Drive|Court|Way|Place|Square|Crescent|Gardens|Row|Hill|Boulevard|St|Rd|Ave|Ln|Dr)\b\.?(?:,?\s(?:Flat|Apt|Unit|Suite|Room)\.?\s\w+)?"), 3.0),
    (re.compile(r"(?<![0-9A-Za-z])(?:Flat|Apt|Unit)\.?\s\d+,?\s\d{1,4}\s[A-Z][a-z]+"), 2.0),
]
_CUES = [
    (re.compile(f"(?:联系人|紧急联系人|签字|签名|姓名|owner|Owner|contact|Contact|登记人|家长)\\s?(?:[:：是为]\\s?|\\s)?({_EN}|{_ZH})(?=[。，,.;；、\\s()（）]|$|已|同意|先生|女士)"), 3.0),
    (re.compile(f"(?:转告|告知|通知|提醒|嘱咐|嘱)\\s?({_ANY})(?=按时|及时|记得|注意|复诊|尽快|来院|按)"), 2.0),
    (re.compile(f"(?:已与|已同|已和|与|和)\\s?({_ANY})(?=电话|微信|沟通|联系|确认|核实|商量)"), 1.0),
    (re.compile(f"由\\s?({_ANY})\\s?(?=代为|代|陪同|送诊|送来|领走|接走|签收)"), 1.5),
    (re.compile(f"(?:主人|宠主|饲主|家属|客户)\\s?({_EN}|{_ZH})(?=陈述|表示|要求|反映|自述|称|诉|说|来电|致电|确认|代|签|同意|，|,|。|$)"), 2.0),
    (re.compile(f"(?:主人|宠主|饲主|家属|客户)\\s?({_ANY})(?=陈述|自述)"), 2.0),
    (re.compile(f"(?<![{_H}])({_EN}|{_ZH})(?=先生|女士|小姐|太太|说|称|要求|来电|陈述|致电|签字|同意|代领|送诊)"), 2.0),
    (re.compile(f"(?<=[人主与和由告])({_EN}|{_ZH})(?=先生|女士|小姐|太太)"), 1.0),
    (re.compile(f"(?<![{_H}])({_EN}|{_FAMILY}[{_H}]{{1,2}})(?=医生|大夫|医师)"), 1.0),
    (re.compile(f"(?<![A-Za-z])({_EN})(?=\\s?(?:陈述|先生|女士|要求|说|代为|电话|按时|phoned|called|asked|says|said|signed))"), 2.5),
]
_GOODS = re.compile(r"(?:条码|单号|编号|芯片号?|批号|发票|样本|订单|运单|快递|货号|参考值|论文|doi|病历号?|处方号?|流水号?|工单|合同|型号|剂量|检验号?|住院号|档案号?|设备号?|序列号?|chip|lot|batch|invoice|barcode|sample|order|sku|ref)\s?(?:码|号|编号|no\.?|number|#)?\s?[:：#]?\s?[A-Za-z]*$", re.I)
_PHONE_CUE = re.compile(r"(?:电话|手机|致电|来电|打|联系|微信同号|微信|tel|phone|call|mobile|拨|传真)\s?(?:号码?|是|为)?[:：]?\s?\(?$", re.I)
_ID_CUE = re.compile(r"(?:身份证|证件|证|核对|理赔用?|登记人证件|实名|id|passport)\s?(?:号码?|号|是|为)?[:：,，]?\s?$", re.I)
_VERB = re.compile(f"[{_H}]*?(?:搬到|寄件到|送药至|送货到|送至|送到|寄到|寄往|住在|家在|住址|地址|位于|上门)(?:是|为)?|住")
_NOT_GIVEN = re.compile("医生|医院|先生|女士|电话|主人|家属|店员|护士|今天|昨天|复诊|宠物")

#: For Spark: could a row hold any candidate?
GATE = (
    r"[@＠]|(?i:[(\[{<（［｛＜][aａ][tｔ]| at [a-z0-9-]+\s?(?:\.|[(\[{]| dot ))|[0-9０-９](?:[ .()（）－-]{0,2}[0-9０-９XxＸｘ]){6}|[零〇一二三四五六七八九幺](?:[ -]?[零〇一二三四五六七八九幺]){9}"
    r"|(?i:passport|permit|travel document)|护照|通行证|回乡证|台胞证|居住证|[路街巷弄道同]\s?(?:之\s?)?[0-9０-９一二三四五六七八九十百零]|[0-9０-９]\s?(?:号楼|栋|幢|座|单元)|[-－][0-9０-９]+[-－][0-9０-９]"
    r"|[0-9][A-Za-z]?,? [A-Z][a-z]+ |Flat |Apt |Unit |联系人|签字|签名|姓名|(?i:owner|contact)|登记人|家长|转告|告知|通知|提醒|嘱|已[与同和]|[与和].{2,20}(?:电话|微信|沟通|联系|确认|核实|商量)|由.{2,20}(?:代|陪同|送|领走|接走|签收)"
    r"|(?:主人|宠主|饲主|家属|客户).{2,24}?(?:陈述|表示|要求|反映|自述|称|诉|说|来电|致电|确认|代|签|同意)|先生|女士|小姐|太太|大夫|医师|医生|(?:^|[^一-鿿])[一-鿿]{2,4}(?:说|称|要求|来电|陈述|致电|签字|同意|代领|送诊)|[A-Z][a-zà-ÿ'\-]+ [A-Z][a-zà-ÿ'\-]"
    rf"|(?:主人|宠主|饲主|家属|客户)\s?(?:[{SURNAMES}{''.join(sorted({x[0] for x in COMPOUND}))}]|[A-Z])|{_ESTATE}\s?[0-9０-９]"
)


def _known_family(s: str) -> bool:
    return len(s) > 1 and ((s[:2] in COMPOUND and len(s) > 2) or (s[0] in SURNAMES and s not in COMPOUND))


#: The weights at the start, by feature: forms (numbered as the patterns above), words around, and what the span itself is.
WEIGHTS = {
    "email": 4.0, "cue": 3.0, "goods": -6.0, "mail": -3.0, "known family": 1.5, "three signs": -1.0, "other length": -3.0, "pet": -6.0, "no name": -6.0, "family only": -6.0,
    **{f"phone {i}": w for i, (_, w) in enumerate(_PHONES)}, **{f"id {i}": w for i, (_, w) in enumerate(_IDS)}, **{f"address {i}": w for i, (_, w) in enumerate(_ADDRESSES)}, **{f"name {i}": w for i, (_, w) in enumerate(_CUES)},
}
_TOKEN = re.compile(rf"[A-Za-zÀ-ɏ]+|\d+|[{_H}]|\S")
Span = tuple[int, int, int]


class Potentials:
    """Feature weights and the couplings of neighbours and of repeats."""

    def __init__(self, weights: dict[str, float] | None = None, chain: float = 1.0, skip: float = 2.4) -> None:
        self.weights, self.chain, self.skip = weights or WEIGHTS, chain, skip

    def score(self, features: tuple[str, ...]) -> float:
        return sum(self.weights[f] for f in features)


def candidates(text: str, pets: set[str]) -> list[tuple[int, int, int, tuple[str, ...], bool]]:
    """(begin, end, kind, features, context) of the proposals for one text in ordinary width; context says whether any feature comes from the words around."""
    out: list[tuple[int, int, int, tuple[str, ...], bool]] = []
    if "@" in text or "at" in text:
        out += [(m.start(), m.end(), 0, ("email",), False) for m in _EMAIL.finditer(text)]
    if any(c.isdigit() for c in text) or "幺" in text or "一" in text:
        for kind, name, patterns, cue in ((1, "phone", _PHONES, _PHONE_CUE), (2, "id", _IDS, _ID_CUE)):
            for n, (pattern, _) in enumerate(patterns):
                for m in pattern.finditer(text):
                    before = text[max(0, m.start() - 14) : m.start()]
                    around = ("cue",) * bool(cue.search(before)) + ("goods",) * bool(_GOODS.search(before))
                    if kind == 1 and text[m.end() : m.end() + 2].lstrip(" ")[:1] == "@":
                        around += ("mail",)
                    out.append((m.start(), m.end(), kind, (f"{name} {n}", *around), bool(around)))
        for n, (pattern, _) in enumerate(_ADDRESSES):
            for m in pattern.finditer(text):
                verb = _VERB.match(m[0])
                out.append((m.start() + (verb.end() if verb else 0), m.start() + len(m[0].rstrip()), 3, (f"address {n}",), False))
    for n, (pattern, _) in enumerate(_CUES):
        for m in pattern.finditer(text):
            s = m[1]
            form = "known family" if s[0] < "　" or _known_family(s) else "three signs" if len(s) == 3 else "other length"
            out.append((m.start(1), m.end(1), 4, (f"name {n}", form) + ("pet",) * (s in pets) + ("no name",) * bool(_NOT_GIVEN.search(s)) + ("family only",) * (s in COMPOUND), True))
    return out


def believe(theta: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log-beliefs [nodes, labels] after loopy message passing; edge k links a[k] and b[k] with the potential j[k] for equal labels."""
    if not len(a):
        return theta
    source, target = np.r_[a, b], np.r_[b, a]
    more = np.expm1(np.r_[j, j])[:, None]
    back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
    order = np.argsort(target, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(target[order]) > 0])
    into = target[order][heads]
    message = np.zeros((len(source), theta.shape[1]))
    total = theta
    for _ in range(rounds):
        x = total[source] - message[back]
        x = np.exp(x - x.max(1, keepdims=True))
        new = np.log(more * x + x.sum(1, keepdims=True))
        new -= new.mean(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = new
        total = theta.copy()
        total[into] += np.add.reduceat(message[order], heads)
        if moved <= SETTLED:
            break
    return total


def proposals(texts: list[str], pets: set[str], p: Potentials) -> dict[tuple[int, int, int, int], tuple[float, tuple[str, ...], bool]]:
    """(field, begin, end, kind) -> (score, features, context) of one document, repeats of cued names among them."""
    nodes: dict[tuple[int, int, int, int], tuple[float, tuple[str, ...], bool]] = {}
    for f, t in enumerate(texts):
        for s, e, k, features, context in candidates(t, pets) if t else ():
            key, new = (f, s, e, k), (p.score(features), features, context)
            if key not in nodes or new[0] > nodes[key][0]:
                nodes[key] = new
    for name in {texts[f][s:e] for (f, s, e, k), (w, _, _) in nodes.items() if k == 4 and w > 0}:
        for f, t in enumerate(texts):
            at = t.find(name)
            while at >= 0:
                nodes.setdefault((f, at, at + len(name), 4), (0.0, (), False))
                at = t.find(name, at + 1)
    return nodes


def _surface(text: str) -> str:
    return re.sub(r"[\W_]+", "", text).lower()


def _repeats(texts: list[str], nodes: dict) -> list[list[tuple[int, int, int, int]]]:
    """The proposals of one kind with the same text, of which there are several."""
    same: dict[tuple[int, str], list[tuple[int, int, int, int]]] = {}
    for key in nodes:
        same.setdefault((key[3], _surface(texts[key[0]][key[1] : key[2]])), []).append(key)
    return [g for g in same.values() if len(g) > 1]


def label(rows: list[list[str | None]], pets: list[set[str]], p: Potentials | None = None) -> list[list[list[Span]]]:
    """For each row and field the accepted spans (begin, end, kind)."""
    p = p or Potentials()
    theta: list[list[float]] = []
    a, b, j, spans = [], [], [], []
    for r, fields in enumerate(rows):
        texts = [t.translate(_WIDE) if t else "" for t in fields]
        nodes = proposals(texts, pets[r], p)
        if not nodes:
            continue
        groups = _repeats(texts, nodes)
        for group in groups:  # the form of a repeat, which has no context of its own, speaks once, at the spans with evidence
            if any(nodes[x][0] > 0 for x in group):
                for x in group:
                    if nodes[x][0] < 0 and not nodes[x][2]:
                        nodes[x] = (0.0, *nodes[x][1:])
        token: dict[tuple[int, int], int] = {}
        members: dict[tuple[int, int, int, int], list[int]] = {}
        for key in sorted(nodes):
            f, s, e, k = key
            inside = members[key] = []
            for m in _TOKEN.finditer(texts[f], s, e):
                place = (f, m.start())
                if place not in token:
                    token[place] = len(theta)
                    theta.append([NEVER] * OTHER + [0.0])
                i = token[place]
                theta[i][k] = max(theta[i][k], nodes[key][0])
                inside.append(i)
            spans.append((r, f, s, e, k, inside))
            a += inside[:-1]
            b += inside[1:]
        j += [p.chain] * (len(a) - len(j))
        for group in groups:
            width = min(len(members[x]) for x in group)
            first = len(theta)
            theta += [[0.0] * (OTHER + 1) for _ in range(width)]
            for x in group:
                # token by token; where separators make the numbers of tokens differ, first to first
                a += range(first, first + width)
                b += members[x][:width]
            j += [p.skip] * (len(a) - len(j))
    out: list[list[list[Span]]] = [[[] for _ in fields] for fields in rows]
    if not theta:
        return out
    edges = np.array([a, b], dtype=np.int64).reshape(2, -1)
    edges, at = np.unique(np.sort(edges, axis=0), axis=1, return_index=True)
    belief = believe(np.array(theta), edges[0], edges[1], np.array(j)[at] if len(j) else np.zeros(0))
    best = np.partition(belief, OTHER - 1, axis=1)
    margin = np.where(belief == best[:, -1:], belief - best[:, -2:-1], belief - best[:, -1:])
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    sure = [(k, s - e, -float(margin[inside, k].min()), r, f, s, e) for r, f, s, e, k, inside in spans if inside and margin[inside, k].min() > 1e-9]
    for k, _, _, r, f, s, e in sorted(sure):
        over = taken.setdefault((r, f), [])
        if all(e <= x or s >= y for x, y in over):
            over.append((s, e))
            out[r][f].append((s, e, k))
    return out


def fit(rows: list[list[str | None]], pets: list[set[str]]) -> Potentials:
    """Weights and couplings learned from what the set weights are sure of."""
    start = Potentials()
    names = {f: i for i, f in enumerate(WEIGHTS)}
    where, what, y = [], [], []
    agree = np.array(AGREE)
    for fields, pet in zip(rows, pets, strict=True):
        texts = [t.translate(_WIDE) if t else "" for t in fields]
        nodes = proposals(texts, pet, start)
        sure = {key: 1.0 if w >= SURE[0] else 0.0 for key, (w, features, _) in nodes.items() if features and (w >= SURE[0] or w <= SURE[1])}
        for key, v in sure.items():
            where += [len(y)] * len(nodes[key][1])
            what += [names[f] for f in nodes[key][1]]
            y.append(v)
        # neighbours: tokens of one proposal agree; at its ends they don't, if it is one
        n = sum(max(0, len(_TOKEN.findall(texts[f][s:e])) - 1) for f, s, e, _ in sure)
        agree[0] += (n, n + sum(sure.values()))
        for group in _repeats(texts, nodes):
            v = [sure[x] for x in group if x in sure]
            agree[1] += (sum(v[i] == v[0] for i in range(1, len(v))), max(0, len(v) - 1))
    w0 = np.array([*WEIGHTS.values()])
    w, r, c, t = w0.copy(), np.array(where, int), np.array(what, int), np.array(y)
    m1, m2 = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1 if len(t) else 1):
        z = np.bincount(r, w[c], minlength=len(t))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - t
        g = np.bincount(c, e[r], minlength=len(w)) / len(t) + PENALTY * (w - w0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    q = np.clip(agree[:, 0] / agree[:, 1], 1e-6, 1 - 1e-6)
    chain, skip = (float(np.clip(np.log(x / (1 - x)), *bound)) for x, bound in zip(q, COUPLING, strict=True))
    return Potentials(dict(zip(WEIGHTS, w.tolist(), strict=True)), chain, skip)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    for s, e, k in sorted(spans, reverse=True):
        text = f"{text[:s]}[{KINDS[k].upper()}]{text[e:]}"
    return text


def learn(rows: DataFrame, columns: list[str], sample: int = SAMPLE) -> Potentials:
    """The potentials, fitted in one task to at most about ``sample`` rows, those with the smallest hashes of their ids; the set ones for an empty table."""
    share = min(1.0, sample / max(1, rows.count()))
    some = rows.where(F.xxhash64("id") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).where(F.concat_ws("\n", *columns).rlike(GATE))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*frames, pd.DataFrame({c: [] for c in ("id", "pet", *columns)})])
        if len(pdf):
            p = fit(*_documents(pdf, columns))
            yield pd.DataFrame({"name": [*p.weights, "_chain", "_skip"], "w": [*p.weights.values(), p.chain, p.skip]})

    got = {r["name"]: r["w"] for r in some.repartition(1).sortWithinPartitions("id", *columns).mapInPandas(run, "name string, w double").collect()}  # one row per feature
    return Potentials({f: got[f] for f in WEIGHTS}, got["_chain"], got["_skip"]) if got else Potentials()


def _documents(pdf: pd.DataFrame, columns: list[str]) -> tuple[list, list[set[str]]]:
    return list(zip(*[pdf[c].where(pdf[c].notna(), None).tolist() for c in columns], strict=True)), [{x} if isinstance(x, str) else set() for x in pdf["pet"]]


def personal(df: DataFrame, id: str, columns: list[str], pet: str | None = None, sample: int = SAMPLE, gate: bool = True) -> DataFrame:
    """(id, field, kinds, redacted): the text fields that hold personal information, with typed placeholders in its place. ``gate`` False looks at every row, for comparison."""
    ship(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), (F.col(pet) if pet else F.lit(None)).cast("string").alias("pet"), *columns)
    p = learn(rows, columns, sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, pets = _documents(pdf, columns)
            got = []
            for i, fields, spans in zip(pdf["id"], texts, label(texts, pets, p), strict=True):
                for c, t, s in zip(columns, fields, spans, strict=True):
                    if s:
                        got.append((i, c, sorted({KINDS[k] for _, _, k in s}), redact(t, s)))
            if got:
                yield pd.DataFrame(got, columns=["id", "field", "kinds", "redacted"])

    return (rows.where(F.concat_ws("\n", *columns).rlike(GATE)) if gate else rows).mapInPandas(run, f"id {kind}, field string, kinds array<string>, redacted string")
