"""Quantities recorded in different units: a hidden Markov model per device, with the unit as hidden state.

A device is a clinic's scale or thermometer (``orgid`` and field). Its readings, in time order, are the observations, and
the unit or scale in which it is read is the hidden state. A reading's log-potential for a unit is the squared jump of its
log-value from the smooth level of the device at that time, over the spread of such values, plus the evidence of the
clinic's note, or, without one, a slight preference for the standard unit, all in nats. A switch between two readings costs
what the data show (``levels``). Viterbi decodes the units. A reading with a unit in the value or in the visit's texts keeps
that unit; it takes part in the level, not in the chain. So notes decide where there are some, and level and neighbours
decide the readings that nothing is said about; a reading that fits no unit stays as recorded.

The chain is never cut: a device's days are spread over tasks, each gives the matrix of best scores by first and last state,
the matrices of a device are composed in order (max-plus products are associative), and each day is decoded between the
states that the best path of the whole chain has at its two ends. So the result is that of one Viterbi run over all of a
device's readings, however hot the device. A device and day of more than ``CROWDED`` readings is cut further, by hour and id.

Edge cases: null, blank, words, two decimal points in a row or no number -> no reading. Repeated loads of a visit give
one row. Null times come first, in order of id. A visit of an unknown clinic has no note. Empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.session import BROADCAST_ROWS, cut, ship, small

#: The words of the weight units, longer words first, and grams per unit.
WEIGHT_WORDS = {"kg": "kilograms?|kgs?|公斤|千克", "jin": "市斤|斤|jin", "lb": "pounds?|lbs?|磅", "g": "grams?|公克|克|g"}
WEIGHT_STATES = ["kg", "jin", "lb", "g"]
GRAMS = [1000.0, 500.0, 453.59237, 1.0]
LIANG, OZ = "市?两", "ounces?|oz|盎司"
#: Temperature states: unit, and by how much the recorded number is too large.
TEMPERATURE_STATES = ["c", "f", "c10", "c100", "f10", "f100"]
#: States at most; prior levels and spreads of the log-values; a jump counts no more than OUTLIER (weights, temperatures).
K, BODY_KG, SPREAD_KG, BODY_C, SPREAD, OUTLIER = 6, 8.0, 0.9, 38.9, 0.04, (1e6, 60.0)
#: Log-potentials: of a unit against a note, for the standard unit where nothing is said; bounds of the learned cost of a switch.
CERTAIN, DEFAULT, COST = 40.0, 5.0, (1.0, 8.0)
#: Days on both sides and prior readings of the level; rows decoded at a time; readings of a device and day that are cut further.
SMOOTH, PRIOR, STEP, CROWDED = 15, 20.0, 256, 200_000
NEVER = -1e9
_UNIT = "(?<![a-z])(" + "|".join(WEIGHT_WORDS.values()) + ")(?![a-z])"
_NUM = r"(\d+(?:\.\d+)?)"
SCHEMA = "id string, field string, state string, value double"


def plain(c: Column) -> Column:
    """Half-width, lower case, one kind of decimal point."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    half = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " "
    s = F.lower(F.translate(c, wide, half))
    for a, b in (("㎏", "kg"), ("℃", "°c"), ("℉", "°f")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r"(?<=\d)[,。](?=\d)", ".")


def weight_unit(c: Column) -> Column:
    """The state number of a unit word; -1 for none."""
    return reduce(lambda out, i: F.when(c.rlike(f"^(?:{WEIGHT_WORDS[WEIGHT_STATES[i]]})$"), F.lit(i)).otherwise(out), range(4), F.lit(-1))


def han_number(c: Column) -> Column:
    """Han numerals up to 999 as a double; null for anything else."""
    digits = "零一二三四五六七八九"
    c = F.translate(c, "两〇", "二零")
    form = f"^(?:([{digits}])百)?零?(?:([{digits}]?)(十))?([{digits}]?)$"
    part = lambda k: F.regexp_extract(c, form, k)
    value = lambda s: reduce(lambda out, i: F.when(s == digits[i], F.lit(i)).otherwise(out), range(10), F.lit(0))
    tens = F.when(part(3) == "", F.lit(0)).otherwise(F.greatest(value(part(2)), F.lit(1)) * 10)
    return F.when(c == "半", F.lit(0.5)).when((F.length(c) > 0) & c.rlike(form), (value(part(1)) * 100 + tens + value(part(4))).cast("double"))


def note_unit(note: Column) -> Column:
    """The unit which a clinic's note states for its weights: the first clause with a unit that isn't about drugs, food or prices; 'converted to kg' wins."""
    s = plain(note)
    clauses = F.filter(F.split(s, r"[,，;；。.]"), lambda x: x.rlike(_UNIT) & ~x.rlike("药|处方|粮|计价|毫升|剂量|drug|medic|dose|dosage|food|price|feed|prescri"))
    to_kg = s.rlike("(?<![不未没])换算(?:成|为|到)?(?:公斤|千克|kg)|convert(?:ed|s)? (?:in)?to k") & ~s.rlike("not converted")
    return F.when(to_kg, F.lit(0)).when(F.size(clauses) > 0, weight_unit(F.regexp_extract(clauses[0], _UNIT, 1))).otherwise(F.lit(-1))


def readings(visits: DataFrame, clinics: DataFrame) -> DataFrame:
    """(id, field, device, t, num, unit, strength): one row per readable value; unit is a state number or -1 (temperatures: 0 Celsius, 1 Fahrenheit)."""
    notes = small(clinics.where("orgid is not null").groupBy("orgid").agg(F.max("note").alias("note")).select("orgid", note_unit(F.col("note")).alias("note_unit")))
    v = visits.where("id is not null").select("id", "orgid", "reg_time", plain(F.trim("pet_weight")).alias("w"), plain(F.trim("temperatures")).alias("t"), "chief_complaint", "present_history", "doctor_advice").join(notes, "orgid", "left")
    # weights
    first = rf"{_NUM}\s*{_UNIT}?\s*(?:(半)|{_NUM}\s*({LIANG}|{OZ}))?"
    han = f"([零一二三四五六七八九十百半两]+?)({'|'.join(WEIGHT_WORDS.values())})(半|[一二三四五六七八九]市?两)?"
    g = lambda pattern, k: F.regexp_extract("w", pattern, k)
    digital = F.col("w").rlike(r"\d")
    number, rest = F.expr("try_cast(regexp_extract(w, '([0-9]+(?:[.][0-9]+)?)', 1) as double)"), g(first, 4)
    half = F.when(g(first, 3) == "半", F.lit(0.5)).otherwise(0.0)
    more = F.when(rest == "", F.lit(0.0)).otherwise(F.coalesce(rest.try_cast("double"), F.lit(0.0)) / F.when(g(first, 5).rlike(OZ), F.lit(16.0)).otherwise(F.lit(10.0)))
    alone = F.when(F.col("w").rlike(rf"^\D*{_NUM}\s*(?:{LIANG})"), F.lit(10.0)).when(F.col("w").rlike(rf"^\D*{_NUM}\s*(?:{OZ})"), F.lit(16.0)).otherwise(F.lit(1.0))
    han_more = F.when(g(han, 3) == "半", F.lit(0.5)).otherwise(F.coalesce(han_number(F.regexp_replace(g(han, 3), "市?两", "")) / 10, F.lit(0.0)))
    num = F.when(F.col("w").rlike(r"\d\.\.+"), None).when(digital, (number + half + more) / alone).otherwise(han_number(g(han, 1)) + han_more)
    written = F.when(digital, F.when(alone == 10, F.lit(1)).when(alone == 16, F.lit(2)).otherwise(weight_unit(F.regexp_extract("w", _UNIT, 1)))).otherwise(weight_unit(g(han, 2)))
    v = v.withColumns({"num": num, "written": written})
    texts = plain(F.concat_ws("\n", "chief_complaint", "present_history", "doctor_advice"))
    pair = r"(?<![\d.])(\d+(?:\.\d+)?)\s*\(?\s*" + _UNIT
    said = F.filter(F.arrays_zip(F.regexp_extract_all(texts, F.lit(pair), F.lit(1)).alias("n"), F.regexp_extract_all(texts, F.lit(pair), F.lit(2)).alias("u")), lambda x: x["n"].try_cast("double") == F.col("num"))
    v = v.withColumn("said", F.when((F.col("written") < 0) & F.col("num").isNotNull(), F.coalesce(F.try_element_at(said, F.lit(1))["u"], F.lit(""))))
    by_text, by_note = weight_unit(F.coalesce("said", F.lit(""))), F.coalesce("note_unit", F.lit(-1))
    unit = F.when(F.col("written") >= 0, F.col("written")).when(by_text >= 0, by_text).when(by_note >= 0, by_note).otherwise(F.lit(-1))
    strength = F.when(F.col("written") >= 0, F.lit(3)).when(by_text >= 0, F.lit(2)).when(by_note >= 0, F.lit(1)).otherwise(F.lit(0))
    # temperatures
    degrees = F.when(F.col("t").rlike(r"\d\.\.+"), None).otherwise(F.expr("try_cast(regexp_extract(t, '([0-9]+(?:[.][0-9]+)?)', 1) as double)"))
    scale = F.when(F.col("t").rlike("华氏|(?<![a-z])f(?:ahrenheit)?(?![a-z])"), F.lit(1)).when(F.col("t").rlike("摄氏|(?<![a-z])c(?:elsius)?(?![a-z])"), F.lit(0)).otherwise(F.lit(-1))
    each = F.array(
        F.struct(F.lit("pet_weight").alias("field"), F.col("num").alias("num"), unit.alias("unit"), strength.alias("strength")),
        F.struct(F.lit("temperatures").alias("field"), degrees.alias("num"), scale.alias("unit"), F.when(scale >= 0, F.lit(3)).otherwise(F.lit(0)).alias("strength")),
    )
    return v.select("id", F.coalesce("orgid", F.lit("")).alias("device"), F.coalesce("reg_time", F.lit("")).alias("t"), F.inline(each)).where("num is not null and num > 0")


def _logs(num: Column, weight: bool) -> list[Column]:
    """ln of the value in kilograms or degrees Celsius, for each state."""
    if weight:
        return [F.ln(num * (g / 1000.0)) for g in GRAMS]
    f = lambda x: (x - 32.0) * 5.0 / 9.0
    return [F.ln(F.greatest(x, F.lit(1e-6))) for x in (num, f(num), num / 10, num / 100, f(num / 10), f(num / 100))]


def guessed(r: DataFrame) -> DataFrame:
    """r with ``guess``, the best state of each reading by itself (evidence and the prior level), and ``log``, its log-value in that state."""
    sides = []
    for weight in (True, False):
        centre, spread = (np.log(BODY_KG), SPREAD_KG) if weight else (np.log(BODY_C), SPREAD)
        scored = []
        for i, x in enumerate(_logs(F.col("num"), weight)):
            miss = F.least(F.pow((x - centre) / spread, 2.0) / 2, F.lit(OUTLIER[not weight]))
            given = F.when(F.col("unit") == (i if weight else int(TEMPERATURE_STATES[i][0] == "f")), 0.0).when(F.col("strength") >= 2, NEVER).when(F.col("unit") >= 0, -CERTAIN).otherwise(DEFAULT if i == 0 else 0.0)
            scored.append(F.struct((given - miss).alias("score"), F.lit(-i).alias("i"), F.least(F.greatest(x, F.lit(centre - 5 * spread)), F.lit(centre + 5 * spread)).alias("log")))
        sides.append(F.array_max(F.array(*scored)))
    best = F.when(F.col("field") == "pet_weight", sides[0]).otherwise(sides[1])
    return r.withColumn("_best", best).withColumns({"guess": -F.col("_best.i"), "log": F.col("_best.log")}).drop("_best")


def levels(g: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The smooth level of every device, field and day, (device, field, day, level, n), and the cost of a switch per field.

    The level is the mean log-value of the ``SMOOTH`` days before and after, drawn to the prior as by ``PRIOR`` further
    readings. A device has one row per day here, however many readings. The cost is learned from how often two readings
    of one device and day without a unit differ in their best state.
    """
    free = lambda i: F.count_if((F.col("strength") < 2) & (F.col("guess") == i)).alias(f"s{i}")
    daily = cut(g.groupBy("device", "field", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("log").alias("sum"), *[free(i) for i in range(K)]))
    number = F.coalesce(F.unix_date(F.expr("try_cast(day as date)")), F.lit(-1_000_000))
    w = W.partitionBy("device", "field").orderBy("number").rangeBetween(-SMOOTH, SMOOTH)
    prior = F.when(F.col("field") == "pet_weight", float(np.log(BODY_KG))).otherwise(float(np.log(BODY_C)))
    level = (prior * PRIOR + F.sum("sum").over(w)) / (PRIOR + F.sum("n").over(w))
    smooth = daily.withColumn("number", number).select("device", "field", "day", "n", level.alias("level"))
    m = reduce(lambda a, b: a + b, [F.col(f"s{i}") for i in range(K)])
    pairs = daily.withColumns({"m": m.cast("double"), "same": reduce(lambda a, b: a + b, [F.col(f"s{i}") * (F.col(f"s{i}") - 1.0) for i in range(K)])}).where("m > 1")
    rate = pairs.groupBy("field").agg(F.sum(F.col("m") - F.col("same") / (F.col("m") - 1)).alias("differ"), F.sum("m").alias("m")).collect()  # two rows
    costs = {}
    for name, k in (("pet_weight", len(GRAMS)), ("temperatures", K)):
        differ, n = next(((r["differ"], r["m"]) for r in rate if r["field"] == name), (0.0, 0.0))
        p = (differ + 1.0) / (n + k)
        costs[name] = float(np.clip(np.log((1 - p) * (k - 1) / p), *COST))
    return smooth, costs


def _standard(num: np.ndarray, weight: bool) -> np.ndarray:
    """[rows, states]: the value in kilograms or degrees Celsius, for each state."""
    if weight:
        return num[:, None] * (np.array(GRAMS) / 1000.0)[None, :]
    f = lambda x: (x - 32.0) * 5.0 / 9.0
    return np.stack([num, f(num), num / 10, num / 100, f(num / 10), f(num / 100)], axis=1)


def emissions(num: np.ndarray, unit: np.ndarray, strength: np.ndarray, level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-potentials [rows, K] of the states, and the state of the readings that name their unit themselves (-1 for the others).

    Readings with a unit of their own say nothing on the unit in which the device is read, so they're flat in the chain.
    """
    n = len(num)
    e = np.full((n, K), NEVER)
    own = np.full(n, -1)
    for w in (True, False):
        at = np.flatnonzero(weight == w)
        if not len(at):
            continue
        x = _standard(num[at], w)
        jump = np.minimum(((np.log(np.maximum(x, 1e-6)) - level[at, None]) / (SPREAD_KG if w else SPREAD)) ** 2 / 2, OUTLIER[not w])
        u, s = unit[at], strength[at]
        said = np.arange(x.shape[1])[None, :] == u[:, None] if w else (np.array([c[0] == "f" for c in TEMPERATURE_STATES])[None, :] == (u == 1)[:, None])
        given = np.where(u[:, None] >= 0, np.where(said, 0.0, np.where(s >= 2, NEVER, -CERTAIN)[:, None]), 0.0)
        given[:, 0] += np.where(u < 0, DEFAULT, 0.0)
        score = given - jump
        e[at, : x.shape[1]] = np.where((s >= 2)[:, None], 0.0, score)
        own[at] = np.where(s >= 2, score.argmax(1), -1)
    return e, own


def transfer(e: np.ndarray, start: np.ndarray, size: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """[blocks, K, K]: the best score of a path through each block of rows, by its first and its last state; all blocks at once."""
    order = np.argsort(-size, kind="stable")
    s, c = start[order], cost[order, None, None]
    m = np.full((len(s), K, K), NEVER)
    m[:, np.arange(K), np.arange(K)] = e[s]
    for step in range(1, int(size.max(initial=0))):
        live = int(np.searchsorted(-size[order], -step, side="left"))
        a = m[:live]
        m[:live] = np.maximum(a, a.max(2, keepdims=True) - c[:live]) + e[s[:live] + step][:, None, :]
    out = np.empty_like(m)
    out[order] = m
    return out


def chained(a: np.ndarray, b: np.ndarray, cost: float) -> np.ndarray:
    """The transfer matrix of two neighbouring stretches; composing is associative, so a chain may be cut anywhere."""
    a = np.maximum(a, a.max(1, keepdims=True) - cost)
    return (a[:, :, None] + b[None, :, :]).max(1)


def ends_of(m: np.ndarray, cost: float, first: int = -1, last: int = -1) -> np.ndarray:
    """[stretches, 2]: the states at both ends of each stretch on the best path; first and last are given states of the whole, -1 for none."""
    n = len(m)
    best, entry, before = np.zeros((n, K)), np.zeros((n, K), int), np.zeros((n, K), int)
    v = np.zeros(K) if first < 0 else np.where(np.arange(K) == first, 0.0, 2 * NEVER)
    for b in range(n):
        if b:
            top = int(best[b - 1].argmax())
            jump = best[b - 1, top] - cost > best[b - 1]
            before[b] = np.where(jump, top, np.arange(K))
            v = np.where(jump, best[b - 1, top] - cost, best[b - 1])
        t = v[:, None] + m[b]
        entry[b], best[b] = t.argmax(0), t.max(0)
    out = np.zeros((n, 2), int)
    z = int(best[-1].argmax()) if last < 0 else last
    for b in range(n - 1, -1, -1):
        out[b] = entry[b, z], z
        z = int(before[b, out[b, 0]])
    return out


def viterbi(e: np.ndarray, start: np.ndarray, size: np.ndarray, cost: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best path through each block from its given first to its given last state; all blocks at once."""
    order = np.argsort(-size, kind="stable")
    s, z, c, ends = start[order], size[order], cost[order, None], ends[order]
    best = np.where(np.arange(K)[None, :] == ends[:, :1], e[s], 2 * NEVER)
    back = np.zeros((int(z.max(initial=0)), len(s), K), np.int8)
    for step in range(1, len(back)):
        live = int(np.searchsorted(-z, -step, side="left"))
        a = best[:live]
        top = a.argmax(1)[:, None]
        away = np.take_along_axis(a, top, 1) - c[:live]
        back[step, :live] = np.where(away > a, top, np.arange(K)[None, :])
        best[:live] = np.maximum(a, away) + e[s[:live] + step]
    path, state = np.zeros(len(e), int), ends[:, 1].copy()
    for step in range(len(back) - 1, -1, -1):
        live = int(np.searchsorted(-z, -step, side="left"))
        path[s[:live] + step] = state[:live]
        if step:
            state[:live] = back[step, np.arange(live), state[:live]]
    return path


def _stretches(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows and sizes of the blocks of at most ``STEP`` rows, and which run (device, field, bucket) each belongs to."""
    n = len(pdf)
    new = np.zeros(n, bool)
    for c in ("device", "field", "bucket"):
        x = pdf[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    new[:1] = True
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    place = np.arange(n) - first[run]
    start = np.flatnonzero(place % STEP == 0)
    return start, np.diff(np.r_[start, n]), run[start]


def _prepare(pdf: pd.DataFrame, costs: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, own states, cost per row, and which rows repeat the row before (the same visit loaded again; flat in the chain)."""
    weight = (pdf["field"] == "pet_weight").to_numpy()
    e, own = emissions(pdf["num"].to_numpy(float), pdf["unit"].to_numpy(int), pdf["strength"].to_numpy(int), pdf["level"].to_numpy(float), weight)
    again = np.zeros(len(pdf), bool)
    if len(pdf) > 1:
        again[1:] = np.logical_and.reduce([pdf[c].to_numpy()[1:] == pdf[c].to_numpy()[:-1] for c in ("id", "device", "field", "num", "unit", "strength")])
    e[again] = np.where(e[again] > NEVER, 0.0, NEVER)
    return e, own, np.where(weight, costs["pet_weight"], costs["temperatures"]), again


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows with every run of a device, field and bucket whole; a bucket is bounded, so what is held back is too."""
    rest: pd.DataFrame | None = None
    for pdf in frames:
        pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
        if not len(pdf):
            continue
        tail = pdf.iloc[-1]
        open_ = ((pdf["device"] == tail["device"]) & (pdf["field"] == tail["field"]) & (pdf["bucket"] == tail["bucket"])).to_numpy()
        if not open_.all():
            yield pdf[~open_].reset_index(drop=True)
        rest = pdf[open_].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def standardise(visits: DataFrame, clinics: DataFrame, costs: dict[str, float] | None = None, level: bool = True) -> DataFrame:
    """(id, field, state, value): every readable weight in kilograms and temperature in degrees Celsius, with the decoded unit or scale.

    ``costs`` sets the costs of a switch instead of learning them; ``level`` False leaves the level at its prior. Both serve comparison.
    """
    spark = visits.sparkSession
    ship(spark)
    r = cut(guessed(readings(visits, clinics).withColumn("day", F.substring("t", 1, 10))))
    smooth, learned = levels(r)
    costs = costs or learned
    if not level:
        smooth = smooth.withColumn("level", F.when(F.col("field") == "pet_weight", float(np.log(BODY_KG))).otherwise(float(np.log(BODY_C))))
    crowded = F.concat(F.substring("t", 1, 13), F.lit("#"), F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(256))), 2, "0"))
    j = r.join(small(smooth, settle=True), ["device", "field", "day"]).withColumn("bucket", F.when(F.col("n") > CROWDED, crowded).otherwise(F.col("day")))
    j = j.select("id", "field", "device", "bucket", "t", "num", "unit", "strength", "level")
    in_order = lambda x: x.repartition("device", "field", "bucket").sortWithinPartitions("device", "field", "bucket", "t", "id", "num")
    rows = cut(in_order(j))

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(frames):
            e, _, cost, _ = _prepare(pdf, costs)
            start, size, run = _stretches(pdf)
            m = transfer(e, start, size, cost[start])
            heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            whole = list(m[heads])
            for b in np.flatnonzero(np.r_[False, run[1:] == run[:-1]]):
                whole[run[b]] = chained(whole[run[b]], m[b], cost[start[b]])
            yield pdf.iloc[start[heads]][["device", "field", "bucket"]].assign(m=[x.ravel().tolist() for x in whole])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        ends = ends_of(np.stack(pdf["m"].to_numpy()).reshape(-1, K, K), costs[pdf["field"].iloc[0]])
        return pdf[["device", "field", "bucket"]].assign(first=ends[:, 0], last=ends[:, 1])

    key = "device string, field string, bucket string"
    # a device has one row per bucket here, so its days are what one task holds
    ends = cut(rows.mapInPandas(matrices, f"{key}, m array<double>").groupBy("device", "field").applyInPandas(stitch, f"{key}, first int, last int"))
    fits = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    with_ends = rows.join(F.broadcast(ends) if fits else ends, ["device", "field", "bucket"])

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(frames):
            e, own, cost, again = _prepare(pdf, costs)
            start, size, run = _stretches(pdf)
            outer = pdf[["first", "last"]].to_numpy()[start]
            ends = outer.copy()
            many = np.flatnonzero(np.bincount(run)[run] > 1)
            if len(many):
                m = transfer(e, start, size, cost[start])
                for x in np.unique(run[many]):
                    at = np.flatnonzero(run == x)
                    ends[at] = ends_of(m[at], cost[start[at[0]]], *outer[at[0]])
            state = viterbi(e, start, size, cost[start], ends)
            state = np.where(own >= 0, own, state)
            weight = (pdf["field"] == "pet_weight").to_numpy()
            num = pdf["num"].to_numpy(float)
            value, name = np.zeros(len(pdf)), np.empty(len(pdf), object)
            for w in (True, False):
                at = np.flatnonzero(weight == w)
                value[at] = _standard(num[at], w)[np.arange(len(at)), state[at]]
                name[at] = np.array(WEIGHT_STATES if w else TEMPERATURE_STATES, object)[state[at]]
            yield pd.DataFrame({"id": pdf["id"], "field": pdf["field"], "state": name, "value": value})[~again]

    return (with_ends if fits else in_order(with_ends)).mapInPandas(decode, SCHEMA)


def converted(visits: DataFrame, clinics: DataFrame, costs: dict[str, float] | None = None, level: bool = True) -> DataFrame:
    """(id, field, value_std): the values not recorded in kilograms or degrees Celsius, as whole grams or hundredths of a degree."""
    scaled = F.when(F.col("field") == "pet_weight", F.col("value") * 1000).otherwise(F.col("value") * 100)
    return standardise(visits, clinics, costs, level).where("state not in ('kg', 'c')").select("id", "field", F.floor(scaled + 0.5 + 1e-7).cast("long").alias("value_std")).distinct()
