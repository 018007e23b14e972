"""Small cases for the training-data operators: defined results for nulls, blanks, ties, copies, long texts, empty tables and clashing column names; brute force where there is no SQL."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from skein.llm import boilerplate, chars, copies, encode, leaks, normal, pairs, privacy, terms, toxic

# ---- distinctive terms


def test_term_scores(spark):
    data = [(1, ["a", "b", "a", None, ""], "x"), (2, ["b", "c"], "y"), (3, None, "z"), (4, [], "z"), (5, ["d"], "z")]
    df = spark.createDataFrame(data, "k long, w array<string>, term string")
    got = {(i, t): (tf, n, round(s, 4)) for i, _, t, tf, n, s in rows(terms.scores(df, "k", ["w"]))}
    ln = np.log
    assert got == {(1, "a"): (2, 1, round(ln(5), 4)), (1, "b"): (1, 2, round(ln(2.5), 4)), (2, "b"): (1, 2, round(ln(2.5), 4)), (2, "c"): (1, 1, round(ln(5), 4)), (5, "d"): (1, 1, 0.0)}
    assert terms.scores(df.limit(0), "k", ["w"]).count() == 0


def test_long_lists_take_the_other_way(spark):
    df = spark.createDataFrame([(1, [str(i % 7) for i in range(60)]), (2, ["x", "y"])], "k long, w array<string>")
    a, b = (rows(terms.record_terms(df, "k", ["w"], long=n)) for n in (1000, 10))
    assert a == b and len(a) == 9


# ---- look-alike characters


@pytest.mark.parametrize(
    ("text", "fixed"),
    [
        ("ＡＢ１２", "AB12"), ("café", "café"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("⽝⽑不", "犬毛不"), ("Чай и кофе", None), ("β-内酰胺", None), ("，。！？「」", None), ("café", None), ("\t\n", None), ("🐾", None), ("(ง •̀_•́)ง", None), ("", None),
    ],
)
def test_certain(text, fixed):
    assert chars.certain(text) == (text if fixed is None else fixed, fixed is not None)


def test_mixed_tokens():
    assert chars.repaired("Felivах") == "Felivax" and chars.repaired("Felivax") is None and chars.repaired("приvет") is None
    assert chars.lookalikes("на пищу") == []
    assert chars.folded("уеаr оld") == "year old"


def test_repair_asks_the_vocabulary(spark):
    data = [(1, "用Felivах滴剂", "x"), (2, "Felivax", "y"), (3, "Zоrр", "z"), (4, None, "z"), (5, "", "z"), (6, "ｏｋ", "z"), (6, "ｏｋ", "z")]
    df = spark.createDataFrame(data, "qa long, text string, field string")
    assert rows(normal.repair(df, "qa", ["text"])) == [(1, "text", "用Felivax滴剂", True), (3, "text", "Zоrр", False), (6, "text", "ok", True), (6, "text", "ok", True)]
    assert normal.repair(df.limit(0), "qa", ["text"]).count() == 0


# ---- copies


def test_copies(spark):
    data = [(5, "猫 发烧？"), (2, "猫发烧"), (9, "「猫发烧」!!"), (3, "狗发烧"), (4, None), (7, "ＣＡＴ"), (8, "c a​t"), (1, "??"), (6, "…")]
    df = spark.createDataFrame(data, "k long, q string").withColumn("first", F.lit(0))
    assert rows(copies.copies(df, "k", ["q"])) == [(1, 6), (2, 5), (2, 9), (7, 8)]
    assert copies.copies(df.limit(0), "k", ["q"]).count() == 0


def test_field_order_does_not_count(spark):
    df = spark.createDataFrame([(1, "a", "B"), (2, "b", "A "), (3, "ab", None)], "k long, x string, y string")
    assert rows(copies.groups(df, "k", ["x", "y"]).select("first", "copies")) == [(1, 2), (3, 1)]


# ---- site lines


def test_site_lines(spark):
    data = [(i, "s", f"one {i}\n {'foot' if i < 6 else 'rare'}\t\r\nfoot") for i in range(10)] + [(i, "t", f"own {i}") for i in range(10, 14)] + [(20, "s", None), (21, None, "foot"), (22, "s", "\n \n")]
    df = spark.createDataFrame(data, "k long, site string, a string").withColumns({"line": F.lit(1), "raw": F.lit(2)})
    got = rows(boilerplate.flagged(df, "k", "site", "a", least=5, share=0.5).where("repeated").select("id", "line_no"))
    assert got == sorted([(i, 3) for i in range(10)] + [(i, 2) for i in range(6)], key=repr)
    clean = dict(rows(boilerplate.cleaned(df, "k", "site", "a", least=5, share=0.5)))
    assert clean[0] == "one 0" and clean[9] == "one 9\n rare\t\r" and clean[20] is None and clean[21] == "foot"
    assert boilerplate.flagged(df.limit(0), "k", "site", "a").count() == 0


def test_bitmaps_over_many_buckets(spark):
    df = spark.range(0, 200_000, 997).select(F.col("id").alias("k"), F.lit("s").alias("site"), F.concat(F.lit("line\nown "), F.col("id").cast("string")).alias("a"))
    assert boilerplate.flagged(df, "k", "site", "a").where("repeated").select("id", "line_no").distinct().count() == df.count()


# ---- defective pairs


def test_pair_defects(spark):
    good = "先禁食两天，再从幼宠粮开始少量添加。若尾根肿胀并伴抽搐，请在一周内到院做胸片。"
    q = "新宠到家后发现金毛犬腹胀还发热，该怎么办？"
    data = [(i, "s", q, f"{good}第{i}条经验也请参考。\n祝早日康复") for i in range(8)]
    data += [(100 + i, "t", q, good) for i in range(4)]
    cases = {
        50: (None, "empty"), 51: ("<br>&nbsp;", "empty"), 52: ("N/A.", "empty"), 53: ("……", "empty"), 54: ("您问的是：" + q, "copy"), 55: (q.replace("，", " "), "copy"), 56: (q + "\n" + good, None), 57: ("抱歉，我无法回答这个问题，请谅解。", "refusal"),
        58: ("抱歉让您久等了，" + good, None), 59: ("这种情况无法只凭描述下结论，不过" + good, None), 60: ("The owner should keep the dog calm and call the vet if it is not better in two days.", "language"), 61: ("嘔吐が続く場合は耳をきれいにして、ようすを見てください。", "language"),
        62: (good + "若尾根肿胀并伴", "truncated"), 63: (good + "\n浏览量：532", None), 64: (good + "\n2.", "truncated"), 65: ("在用GastroKo冻干粉，" + good, None), 66: (good[:-1] + "，", "truncated"),
    }
    data += [(k, "u", q, a) for k, (a, _) in cases.items()] + [(90, None, None, good), (91, None, None, None)]
    df = spark.createDataFrame(data, "k long, s string, q string, a string").withColumns({"kind": F.lit("x"), "n": F.lit(1)})
    got = dict(rows(pairs.defects(df, "k", "s", "q", "a")))
    assert {k: got.get(k) for k in cases} == {k: d for k, (_, d) in cases.items()}
    assert got[91] == "empty" and 90 not in got and not any(k < 8 or 100 <= k < 104 for k in got)
    assert pairs.defects(df.limit(0), "k", "s", "q", "a").count() == 0


def test_broken_answers_do_not_vouch_for_themselves(spark):
    good = "先禁食两天，再从幼宠粮开始少量添加。若尾根肿胀并伴抽搐，请在一周内到院做胸片。"
    q = "新宠到家后发现金毛犬腹胀还发热，该怎么办？"
    data = [(i, "s", q, f"{good}第{i}条经验也请参考。\n祝早日康复") for i in range(8)]
    data += [(20 + i, "s", q, f"{good}\n打喷嚏时耳道的毛先剪") for i in range(3)] + [(30, "s", q, f"{good}\n 打喷嚏时，耳道的毛先剪")]  # copies, shorter than the whole text elsewhere
    data += [(40 + i, "s", q, f"{good}第{i}次给{w}喂药以后请先观察半天再喂水。") for i, w in enumerate("猫狗兔鼠鸟龟")] + [(50 + i, "s", q, f"{good}第{i}次复诊。\n给{w}喂药以后请先") for i, w in enumerate("马牛羊")]
    data += [(60 + i, "s", q, f"{good}\n慢慢调理不要着急一定会好起来的" + x) for i, x in enumerate(["", "", ""])]
    df = spark.createDataFrame(data, "k long, s string, q string, a string")
    got = dict(rows(pairs.defects(df, "k", "s", "q", "a")))
    assert got == dict.fromkeys([20, 21, 22, 30, 50, 51, 52, 60, 61, 62], "truncated")


def test_continuations_against_brute_force(spark):
    """Running counts in the sorted order give, for each text, how many items begin with it, wherever tasks begin and end."""
    r = np.random.default_rng(3)
    words = sorted({"".join(r.choice(list("甲乙b"), r.integers(1, 7))) for _ in range(300)})
    items = spark.createDataFrame([("clause", w, i % 3 + 1) for i, w in enumerate(words)], "kind string, key string, weight long")
    asked = spark.createDataFrame([("clause", w, w + "\x00", w + "\U0010ffff") for w in [*words[::5], "没有"]], "kind string, text string, low string, high string")
    got = {t: n for _, t, n in rows(pairs.continued(items, asked))}
    assert got == {w: sum(i % 3 + 1 for i, x in enumerate(words) if x.startswith(w) and x != w) for w in [*words[::5], "没有"]}


def test_clauses(spark):
    df = spark.createDataFrame([("先禁食，再喂。\n1. 多喝水\n祝好",), ("再喂。wait, then feed. ok",), ("",)], "a string")
    assert rows(pairs.clauses(df)) == [("then feed", 1, 0), ("wait", 0, 1), ("先禁食", 0, 1), ("再喂", 2, 0), ("多喝水", 1, 0)]


def test_sorted_order_and_limits_decide(spark):
    """Shortened versions are found by what follows them in the sorted order, and by their site's length limit; not without."""
    whole = [f"第{i}次来院以后先观察三天再复诊。回家之后请把耳道里面的毛先剪掉再上药，动作轻一些。" for i in range(12)]
    ends = [f"给第{i}只猫剪毛以后请把耳道里面的毛先剪掉。" for i in range(4)]  # the same last characters end sentences
    data = [(i, "s", "怎么办呢医生", a) for i, a in enumerate(whole + ends)]
    data += [(100, "s", "怎么办呢医生", whole[3][: whole[3].index("先剪掉") + 3])]
    limit = [f"{chr(0x4E00 + 97 * i)}先擦干净再喂药然后每天换水换垫子" for i in range(30)]
    data += [(200 + i, "t", "怎么办呢医生", a) for i, a in enumerate(limit)]
    data += [(300 + i, "t", "怎么办呢医生", f"{'多' * (i + 1)}晒{chr(0x5E00 + 91 * i)}太阳然后每天换水换垫子。\n{'多' * (i + 1)}晒{chr(0x5E00 + 91 * i)}太阳然后每天换水换垫子") for i in range(30)]
    df = spark.createDataFrame(data, "k long, s string, q string, a string")
    got = {k for k, d in rows(pairs.defects(df, "k", "s", "q", "a")) if d == "truncated"}
    assert got == {100, *range(200, 230)}
    assert 100 not in {k for k, d in rows(pairs.defects(df, "k", "s", "q", "a", shortened=False)) if d == "truncated"}
    assert {k for k, d in rows(pairs.defects(df, "k", "s", "q", "a", limits=False)) if d == "truncated"} == {100}


# ---- personal information


def spans(text, pet=None):
    return {privacy.KINDS[k]: text[s:e] for s, e, k in privacy.label([[text]], [{pet} if pet else set()])[0][0]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("报告发至mistvale834@mail.example。", {"email": "mistvale834@mail.example"}), ("c_crab(at)inbox(dot)invalid", {"email": "c_crab(at)inbox(dot)invalid"}), ("紧急时联系008616074689771。", {"phone": "008616074689771"}),
        ("家属（+1 (555) 017-4189）", {"phone": "+1 (555) 017-4189"}), ("致电 (026)55507640 预约", {"phone": "(026)55507640"}), ("联系电话幺六四九五幺七六三二三。", {"phone": "幺六四九五幺七六三二三"}), ("身份证９９０３１５１９６９１００８２２０X。", {"id_number": "９９０３１５１９６９１００８２２０X"}),
        ("核对970208 19901121 1232无误", {"id_number": "970208 19901121 1232"}), ("证件号：passport EZ9461060，", {"id_number": "passport EZ9461060"}), ("条码690339057005997535，", {}), ("芯片号900742378868917。", {}), ("单号722880106650已寄检", {}), ("批号20211226-28。", {}),
        ("参考值120-960，", {}), ("样本编号LX77366416259。", {}), ("9号诊室6号笼。", {}), ("@护士站 请量体温", {}), ("沅渚市很热", {}), ("主人刚搬到砚池街八弄25号，", {"address": "砚池街八弄25号"}), ("住柘湾市 望溪区 三棵榆巷 之 258 号。", {"address": "柘湾市 望溪区 三棵榆巷 之 258 号"}),
        ("lives at 95 Penhallow Street, Flat 10. ", {"address": "95 Penhallow Street, Flat 10"}), ("墨竹公寓-7-3-123，", {"address": "墨竹公寓-7-3-123"}), ("令狐女士已签收药品。", {}), ("屠沅芷女士要求尽快复查。", {"name": "屠沅芷"}), ("已与Pernille Sorrelby电话沟通。", {"name": "Pernille Sorrelby"}),
        ("年糕和汤圆同笼", {}), ("柴医生值班", {}), ("转告屈令徽按时用药。", {"name": "屈令徽"}), ("", {}),
    ],
)
def test_spans(text, want):
    assert spans(text) == want


def test_a_name_is_found_everywhere_once_it_has_a_cue():
    a, b = "联系人屠枕流。", "昨天屠枕流来过"
    got = privacy.label([[a, b, None]], [set()])[0]
    assert [x[:2] for x in got[0]] == [(3, 6)] and [x[:2] for x in got[1]] == [(2, 5)] and got[2] == []
    assert privacy.label([[None, b, None]], [set()])[0][1] == []


@pytest.mark.parametrize("n", [1, 10, 100])
def test_all_repeats_of_a_cued_name_or_number_are_found(n):
    name = privacy.label([["联系人屠枕流。" + "昨天屠枕流来过" * n, None, "屠枕流"]], [set()])[0]
    assert len(name[0]) == n + 1 and name[2] == [(0, 3, 4)]
    number = privacy.label([["证件号：AB1234567，" + "又见AB1234567，" * n]], [set()])[0][0]
    assert len(number) == n + 1
    goods = privacy.label([["电话13812345678，" + "批号13812345678，" * n]], [set()])[0][0]
    assert [x[:2] for x in goods] == [(2, 13)]
    assert privacy.label([["又见AB1234567，" * n]], [set()])[0][0] == []


def test_belief_is_exact_on_trees():
    r = np.random.default_rng(1)
    theta, a, b, j = r.normal(0, 1, (4, 3)), np.array([0, 1, 1]), np.array([1, 2, 3]), np.array([1.2, 0.7, 2.0])
    p = np.zeros((4, 3))
    for s in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(theta[i, s[i]] for i in range(4)) + sum(j[k] * (s[a[k]] == s[b[k]]) for k in range(3)))
        for i in range(4):
            p[i, s[i]] += w
    got = privacy.believe(theta, a, b, j)
    assert np.allclose(np.exp(got) / np.exp(got).sum(1, keepdims=True), p / p.sum(1, keepdims=True), atol=1e-3)


def test_ties_between_repeats_decide():
    """Without the shared potentials, repeats that have no words around them are lost, and one that only its repeats speak against is kept."""
    text = [["联系人屠枕流。昨天屠枕流来过", "证件号：AB1234567，又见AB1234567", None]]
    tied, loose = privacy.label(text, [set()]), privacy.label(text, [set()], privacy.Potentials(skip=0.0))
    assert [len(x) for x in tied[0]] == [2, 2, 0] and [len(x) for x in loose[0]] == [1, 1, 0]
    goods = [["批号13812345678，条码13812345678，又见13812345678", None, None]]
    assert privacy.label(goods, [set()])[0][0] == []
    assert [x[:2] for x in privacy.label(goods, [set()], privacy.Potentials(skip=0.0))[0][0]] == [(30, 41)]


def test_learned_potentials():
    rows_ = [["联系人屠枕流。", "电话13812345678。", "批号AB1234567"]] * 40 + [["联系人屠枕流，昨天屠枕流来过", None, None]] * 5 + [["宠物好", None, None]] * 5
    p = privacy.fit(rows_, [set()] * 50)
    assert p.weights["phone 0"] > privacy.WEIGHTS["phone 0"] and p.weights["goods"] < privacy.WEIGHTS["goods"] and p.weights["email"] == pytest.approx(privacy.WEIGHTS["email"])
    assert privacy.COUPLING[0][0] <= p.chain <= privacy.COUPLING[0][1] and privacy.COUPLING[1][0] <= p.skip <= privacy.COUPLING[1][1]
    assert privacy.fit([], []).weights == privacy.WEIGHTS


def test_the_gate_loses_nothing(spark, sf):
    """Every proposal of every visit passes the test in the JVM."""
    visits = spark.read.parquet(f"{sf}/visits.parquet")
    columns = ["chief_complaint", "present_history", "doctor_advice"]
    extra = ["和Zoë O'Neil电话沟通", "寄到花园12号", "a（at）b.com", "主人屠枕流。", "ｚ＠ｂ.ｃｏｍ", "住松风里3栋2单元", "由屠枕流陪同", "Zoë Neil phoned"]
    more = spark.createDataFrame([(f"x{i}", None, t, None, None) for i, t in enumerate(extra)], "id string, pet_name string, chief_complaint string, present_history string, doctor_advice string")
    both = visits.select("id", "pet_name", *columns).unionByName(more)
    gated, all_ = (rows(privacy.personal(both, "id", columns, "pet_name", gate=g)) for g in (True, False))
    assert gated == all_ and len(gated) > 20


def test_redaction(spark):
    df = spark.createDataFrame([("v", "电话14264687967，住砚池街八弄25号。", None, "团子"), ("w", None, "", None), ("x", "没有" * 50_000, None, None), ("v", "电话14264687967，住砚池街八弄25号。", None, "团子")], "id string, a string, b string, field string")
    got = rows(privacy.personal(df, "id", ["a", "b"]))
    assert got == [("v", "a", ("address", "phone"), "电话[PHONE]，住[ADDRESS]。")] * 2
    assert privacy.personal(df.limit(0), "id", ["a", "b"]).count() == 0


# ---- encoding


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(*encode.merge_table())


def test_encoding_equals_the_library(encoder, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    texts = ["", "Hello  world, it's 12345!\n\n", "<|endoftext|>", "犬细小病毒怎么治疗？" * 20, "的" * 3000, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "🐾👩‍⚕️é̂ ﷺ", "\t \r\n x"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert encoder.encode(texts) == want and encoder.encode([None]) == [[]]
    letters = np.random.default_rng(2)
    long = ["".join(letters.choice(list("abcdefghijklmnopqrstuvwxyz"), 5000)), "aab" * 3000, "".join(letters.choice(list("犬猫病症的了"), 2000)), "a" * 9001]
    assert encoder.encode(long) == [t.encode(x, add_special_tokens=False).ids for x in long]
    df = spark.createDataFrame([*enumerate(texts), (90, None)], "k long, text string").withColumn("ids", F.lit(1))
    got = dict(rows(encode.encoded(df, "k", "text")))
    assert got == {i: tuple(w) for i, w in enumerate(want)} | {90: ()}


def test_a_full_cache_keeps_the_words_of_the_batch(encoder, monkeypatch):
    texts = ["the cat, the dog", "the bird, the dog", None, "the cat, a fish, the bird and one more", "the dog"] * 3
    want = [encoder.encode([x])[0] for x in texts]
    monkeypatch.setattr(encode, "CACHE", 3)
    monkeypatch.setattr(encode, "BATCH", 2)
    fresh = encode.Encoder(*encode.merge_table())
    assert fresh.encode(texts) == want and len(fresh.known) < 15


# ---- leaks


def test_leaks_against_brute_force(spark):
    r = np.random.default_rng(3)
    words = lambda n: "".join(r.choice(list("abcd犬猫，。 "), n))
    items = [(i, words(150)) for i in range(8)] + [(8, None), (9, "short"), (10, "")]
    items.append((11, items[0][1]))
    docs = [(k, words(40) + (t := items[k % 8][1])[r.integers(0, 80) : r.integers(90, 150)] + words(60)) for k in range(60)] + [(99, None), (98, ""), (97, items[2][1].upper().replace(" ", "　"))]
    bad = set()
    for k, d in docs:
        n = leaks.normal(d)
        for i, t in items:
            m = leaks.normal(t)
            if any(n[a : a + 40] in m for a in range(len(n) - 39)):
                bad.add((k, i))
    df = spark.createDataFrame(docs, "k long, text string").withColumn("item", F.lit("x"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(df, "k", "text", it, "item_id", "text").collect()
    assert {(x["id"], x["item"]) for x in got} == bad and len(bad) > 20
    cleaned = leaks.Finder([(i, leaks.normal(t)) for i, t in items if t], 40)
    assert all(not cleaned.find(x["cleaned"])[0] for x in got)
    assert leaks.leaks(df, "k", "text", it.limit(0), "item_id", "text").count() == 0
    whole = {(x["id"], x["item"]): x for x in leaks.leaks(df, "k", "text", it, "item_id", "text", cover=0.3).collect()}
    assert whole[(97, 2)]["covered"] == 1.0 and whole[(97, 2)]["cleaned"] == "" and all((x["cleaned"] == "") == (x["covered"] >= 0.3) for x in whole.values())
    block = leaks.BLOCK_CHARS
    try:
        leaks.BLOCK_CHARS = 300
        assert {(x["id"], x["item"]) for x in leaks.leaks(df, "k", "text", it, "item_id", "text").collect()} == bad
    finally:
        leaks.BLOCK_CHARS = block


def test_an_automaton_of_a_full_block_fits_a_worker():
    import tracemalloc

    r = np.random.default_rng(4)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FA5, leaks.BLOCK_CHARS // 20)))
    tracemalloc.start()
    leaks.Finder([(i, text[i * 500 : i * 500 + 500]) for i in range(len(text) // 500)], 40)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size * 20 < 500e6


# ---- abusive content


def test_classifier_on_held_out_rows(spark):
    import pandas as pd

    d = "/root/testdata/sf0.01"
    m = pd.read_parquet(f"{d}/documents.parquet").merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    train, test = m[m.doc_id % 3 > 0], m[(m.doc_id % 3 == 0) & m.text.notna()]
    model = toxic.fit([t if isinstance(t, str) else None for t in train.text], train.toxic.to_numpy(int))
    got = [max(model.passages(p), default=-9) > 0 if (p := toxic.passages(t)) else False for t in test.text]
    assert np.mean(np.array(got) == (test.toxic == 1)) > 0.9
    again = toxic.Model.loads(model.dumps())
    assert np.allclose(again.passages(["你这种废物"]), model.passages(["你这种废物"]))


def test_scores_of_odd_texts(spark):
    docs = [(i, f"护理重点是保持干燥，第{i}天复查。") for i in range(30)] + [(i, f"你这种废物，滚出去！第{i}楼") for i in range(30, 50)] + [(60, None), (61, " \n "), (62, "干燥" * 20_000)]
    df = spark.createDataFrame(docs, "k long, text string").withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(50)] + [(60, 1), (63, None)], "k long, bad int")
    got = dict(rows(toxic.scored(df, labels, "k", "text", "bad")))
    assert len(got) == 53 and got[60] is None and got[61] is None and got[62] is not None
    assert all((got[i] > 0) == (i >= 30) for i in range(50))
    assert all(s is None for _, s in rows(toxic.scored(df, labels.limit(0), "k", "text", "bad")))
    assert toxic.scored(df.limit(0), labels, "k", "text", "bad").count() == 0
