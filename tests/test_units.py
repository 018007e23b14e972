import numpy as np
import pytest
from conftest import rows
from skein.operators import units

V = "id string, orgid string, reg_time string, pet_weight string, temperatures string, chief_complaint string, present_history string, doctor_advice string, state string"
C = "orgid string, note string, state string"
NOTES = [("A", "体重一栏按斤登记"), ("B", "药品按克计价，体重照常"), ("C", None), ("D", "small-animal scale, grams"), ("E", "scale reads pounds, typed in as shown"), ("F", "秤显示市斤，录入时换算成公斤")]


def found(spark, visits):
    v = spark.createDataFrame([(f"v{i}", o, f"2021-01-{i + 1:02d} 00:00:00.0", w, t, x, None, None, "s") for i, (o, w, t, x) in enumerate(visits)], V)
    return {(i, f): n for i, f, n in rows(units.converted(v, spark.createDataFrame([(o, n, "s") for o, n in NOTES], C)))}


def test_weights(spark):
    given = [
        ("A", "12.5", None, 6250), ("A", "12.5kg", None, None), ("B", "5.5", None, None), ("C", "12..5", None, None), ("C", "十一斤半", None, 5750), ("C", "9斤3两", None, 4650), ("C", "2 lb 8 oz", None, 1134),
        ("C", "３．５㎏", None, None), ("D", "2750", None, 2750), ("E", "10", None, 4536), ("F", "8.8", None, None), ("C", "7.6", "体重7.6(斤)", 3800), ("A", "7.6", "称重7.6公斤", None), ("C", "7.6", "称重9.9斤", None),
        ("Z", "4.2", None, None), (None, "4.2斤", None, 2100), ("C", "拒测", None, None), ("C", "", None, None), ("C", None, None, None), ("C", "5,68 kg", None, None), ("C", "18370 G", None, 18370), ("C", "9磅9盎司", None, 4337),
    ]
    got = found(spark, [(o, w, None, x) for o, w, x, _ in given])
    assert {k: v for k, v in got.items()} == {(f"v{i}", "pet_weight"): g for i, (*_, g) in enumerate(given) if g is not None}


def test_temperatures(spark):
    given = [("38.5", None), ("386", 3860), ("3940", 3940), ("101.8 f", 3878), ("103.1", 3950), ("摄氏39.4", None), ("37。1", None), ("408 /10", 4080), ("407(×0.1)", 4070), ("正常", None), ("nan", None), ("39..1", None), ("華氏", None), ("华氏103.8", 3989), ("39", None)]
    got = found(spark, [("C", None, t, None) for t, _ in given])
    assert got == {(f"v{i}", "temperatures"): g for i, (_, g) in enumerate(given) if g is not None}


def test_repeated_loads_and_empty_tables(spark):
    v = spark.createDataFrame([("v", "A", "2021", "3", None, None, None, None, "s")] * 3, V)
    c = spark.createDataFrame([(o, n, "s") for o, n in NOTES], C)
    assert rows(units.converted(v, c)) == [("v", "pet_weight", 1500)]
    assert rows(units.converted(v.limit(0), c)) == []
    assert rows(units.converted(v, c.limit(0))) == []


@pytest.mark.parametrize("seed", range(5))
def test_decoding_in_pieces_is_exact(seed):
    """Stretches composed and decoded between their ends give a best path of the whole chain, wherever they are cut."""
    r = np.random.default_rng(seed)
    n, cost = 300, 2.0
    e = r.normal(0, 3, (n, units.K))
    cuts = np.r_[0, np.sort(r.choice(np.arange(1, n), 12, replace=False)), n]
    start, size = cuts[:-1], np.diff(cuts)
    m = units.transfer(e, start, size, np.full(len(start), cost))
    ends = units.ends_of(m, cost)
    path = units.viterbi(e, start, size, np.full(len(start), cost), ends)
    best = e[0].copy()
    for t in range(1, n):
        best = np.maximum(best, best.max() - cost) + e[t]
    assert e[np.arange(n), path].sum() - cost * (path[1:] != path[:-1]).sum() == pytest.approx(best.max())
    whole = m[0]
    for x in m[1:]:
        whole = units.chained(whole, x, cost)
    assert whole.max() == pytest.approx(best.max())


def grams_in_silence(spark):
    """A scale of grams of which nothing says so: most numbers are far off, small animals' numbers are not."""
    numbers = ["4200", "3900", "400", "5100", "4700", "420", "6100", "5500", "380", "4800"]
    kilos = ["6.1", "4.2", "30", "12", "420", "8.5", "41", "3.3", "5.0", "7.7"]
    v = [(f"g{i}", "C", f"2021-01-{i + 1:02d} 00:00:00.0", w, None, None, None, None, "s") for i, w in enumerate(numbers)]
    v += [(f"k{i}", "Z", f"2021-01-{i + 1:02d} 00:00:00.0", w, None, None, None, None, "s") for i, w in enumerate(kilos)]
    return spark.createDataFrame(v, V), spark.createDataFrame([(o, n, "s") for o, n in NOTES], C), numbers


def test_neighbours_give_the_unit(spark):
    """Only the chain tells 420 among grams (0.42 kg) from 420 among kilograms; without it these readings are lost."""
    v, c, numbers = grams_in_silence(spark)
    got = dict((r[0], r[2]) for r in rows(units.converted(v, c)))
    assert got == {f"g{i}": int(n) for i, n in enumerate(numbers)}
    alone = {r[0] for r in rows(units.converted(v, c, costs={"pet_weight": 0.0, "temperatures": 0.0}))}
    assert alone == {f"g{i}" for i, n in enumerate(numbers) if int(n) > 1000}


def test_level_gives_the_unit(spark):
    """At a scale of heavy animals 700 is a weight in kilograms; at the prior level it would be one in grams."""
    known = [(f"h{i}", "C", f"2021-01-{i // 4 + 1:02d} 0{i % 4}:00:00.0", w, None, None, None, None, "s") for i, w in enumerate(["410kg", "530公斤", "480kg", "505kg"] * 10)]
    v = spark.createDataFrame([*known, ("x", "C", "2021-01-05 12:00:00.0", "700", None, None, None, None, "s")], V)
    c = spark.createDataFrame([(o, n, "s") for o, n in NOTES], C)
    assert rows(units.converted(v, c)) == []
    assert rows(units.converted(v, c, level=False)) == [("x", "pet_weight", 700)]


def test_hot_day_and_order(spark, monkeypatch):
    """A crowded day is cut by hour and id, blocks of few rows are decoded as one chain: unlabelled readings come out alike."""
    v, c, numbers = grams_in_silence(spark)
    monkeypatch.setattr(units, "STEP", 3)
    want = rows(units.converted(v, c))
    monkeypatch.setattr(units, "CROWDED", 0)
    assert rows(units.converted(v, c)) == want
