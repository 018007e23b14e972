"""Abusive, hateful or sexual content: a character n-gram linear classifier with naive Bayes log-count ratios.

A document is as bad as its worst passage, so the classifier judges passages (sentences, or clauses of long sentences).
It is fitted on at most ``SAMPLE`` labelled documents per class (the smallest hashes of their ids; a documented bound):
features are hashed character n-grams of 1 to 4 characters, each scaled by its naive Bayes log-count ratio, with an L2
penalised logistic regression on top. Labels are per document and some are wrong, so of a document labelled bad only its
worst passage counts as bad, chosen anew in each round, and a document whose worst passage looks harmless to the model is
left out. Fitting takes one task of bounded size; the model (a few MB, fixed) is broadcast; every document is scored.

Edge cases: null and blank texts score -inf -> null score and are never found; a corpus without labels of both classes
gets null scores; very long texts are many passages; repeated ids are scored alike; empty tables give an empty result.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import ship

SAMPLE, BITS, ORDERS, FOLDS, ROUNDS, STEPS = 3_000, 19, (1, 2, 3, 4), 3, 3, 25
PENALTY, ALPHA = 1e-5, 0.5
_CUT = re.compile(r"[\n\r\x0b\x0c\x1c-\x1f\x85\u2028\u2029。！？；]+|(?<=[!?.;])(?=\s|$)|(?<=[!?])(?=[㐀-鿿])|(?<=[，。！？：、）】」])\s+(?=[㐀-鿿])")
_CLAUSE = re.compile(r"[，,：:]")
_BETWEEN = re.compile(r"(?<=[㐀-鿿])[\s.·*\-_~|/\\^+]{1,3}(?=[㐀-鿿])")
_LEET = {"0": "o", "1": "i", "!": "i", "@": "a", "$": "s", "3": "e", "5": "s", "*": "*"}
_LEET_RE = re.compile(r"(?<=[a-z])[01!@$35](?=[a-z])|\b[01@$35](?=[a-z]{2})")


def passages(text: str | None) -> list[str]:
    if not text or not text.strip():
        return []
    s = unicodedata.normalize("NFKC", text).lower()
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    out = []
    for p in _CUT.split(s):
        p = p.strip()
        if not p:
            continue
        parts = [p] if len(p) <= 60 else _CLAUSE.split(p)
        for q in parts:
            q = _LEET_RE.sub(lambda m: _LEET[m[0]], _BETWEEN.sub("", q.strip()))
            q = re.sub(r"\d+", "0", re.sub(r"\s+", " ", q))
            if len(q) > 1:
                out.append(q)
    return out


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each passage: (passage numbers, features)."""
    joined = "\x02".join(parts) + "\x02"
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    stop = code == 2
    which = (np.cumsum(stop) - stop).astype(np.int32)
    n = len(code)
    rows, keys = [], []
    h = np.zeros(n, dtype=np.uint64)
    ok = np.ones(n, dtype=bool)
    for k in range(min(max(ORDERS), n)):
        m = n - k
        h = (h[:m] * np.uint64(1_000_003)) ^ (code[k:] + np.uint64(0x9E3779B9))
        ok = ok[:m] & ~stop[k:]
        if k + 1 in ORDERS:
            at = np.flatnonzero(ok)
            x = h[at] * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(k)
            rows.append(which[at])
            keys.append(((x ^ (x >> np.uint64(33))) & np.uint64((1 << BITS) - 1)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(keys)


class Model:
    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight.astype(np.float32), bias

    def passages(self, parts: list[str]) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        rows, keys = grams(parts)
        size = np.bincount(rows, minlength=len(parts))
        return np.bincount(rows, self.weight[keys], minlength=len(parts)) / np.sqrt(np.maximum(size, 1)) + self.bias

    def dumps(self) -> bytes:
        b = io.BytesIO()
        at = np.flatnonzero(self.weight)
        np.savez_compressed(b, at=at.astype(np.int32), w=self.weight[at], bias=np.array([self.bias]))
        return b.getvalue()

    @staticmethod
    def loads(b: bytes) -> Model:
        z = np.load(io.BytesIO(b))
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[z["at"]] = z["w"]
        return Model(w, float(z["bias"][0]))


def _regression(rows: np.ndarray, keys: np.ndarray, scale: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (already times the log-count ratios) and bias, fitted on the used passages with both classes of equal weight."""
    dim, n = 1 << BITS, len(y)
    within = used[rows]
    r, k = rows[within], keys[within]
    p = ALPHA + np.bincount(k, y[r], minlength=dim)
    q = ALPHA + np.bincount(k, 1 - y[r], minlength=dim)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    v = ratio[k] * scale[r]
    share = np.where(y > 0, 0.5 / max(1.0, y[used].sum()), 0.5 / max(1, (used & (y == 0)).sum())) * used
    w, bias = np.zeros(dim), 0.0
    m1, m2, b1, b2 = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(r, w[k] * v, minlength=n) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, gb = np.bincount(k, e[r] * v, minlength=dim) + PENALTY * w, e.sum()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m1 / a) / (np.sqrt(m2 / c) + 1e-6)
        bias -= 0.1 * (b1 / a) / (np.sqrt(b2 / c) + 1e-6)
    return w * ratio, bias


def fit(texts: list[str], bad: np.ndarray) -> Model:
    """Fits the classifier; bad is 0 or 1 per document.

    The worst passage of a bad document is chosen by models fitted without that document's fold, so that a passage of a
    wrongly labelled document can't confirm itself. The cut is where such scores disagree least with the labels.
    """
    per = [list(dict.fromkeys(passages(t))) for t in texts]
    doc = np.repeat(np.arange(len(per)), [len(p) for p in per])
    names: dict[str, int] = {}
    uid = np.array([names.setdefault(p, len(names)) for x in per for p in x], dtype=np.int64)
    parts = list(names)
    rows, keys = grams(parts)
    seen = np.bincount(keys, np.bincount(uid, minlength=len(parts))[rows], minlength=1 << BITS) > 1
    rows, keys = rows[seen[keys]], keys[seen[keys]]
    n = len(parts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    fold = np.arange(len(per)) % FOLDS
    harmless = np.bincount(uid[bad[doc] == 0], minlength=n)
    row_fold, row_bad = fold[doc], bad[doc] == 1
    chosen = row_bad & (harmless[uid] == 0)
    best = np.zeros(len(uid))
    for turn in range(ROUNDS):
        for f in range(FOLDS):
            y, used = np.zeros(n), np.zeros(n, bool)
            y[uid[chosen & (row_fold != f)]] = 1
            used[uid[(chosen | ~row_bad) & (row_fold != f)]] = True
            w, bias = _regression(rows, keys, scale, y, used)
            score = np.bincount(rows, w[keys], minlength=n) * scale + bias
            best[row_fold == f] = score[uid[row_fold == f]]
        top = pd.Series(best).groupby(doc).transform("max").to_numpy()
        order = pd.Series(top[np.r_[True, doc[1:] != doc[:-1]]], index=doc[np.r_[True, doc[1:] != doc[:-1]]])
        cut = _cut(order.to_numpy(), bad[order.index.to_numpy()])
        chosen = row_bad & (best > cut) & (harmless[uid] <= 1)
        if not chosen.any():
            chosen = row_bad & (best == top)
    y, used = np.zeros(n), np.zeros(n, bool)
    y[uid[chosen]] = 1
    used[uid[chosen | ~row_bad]] = True
    w, bias = _regression(rows, keys, scale, y, used)
    return Model(w, bias - cut)


def _cut(score: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the fewest disagreements with the labels; of several, the middle."""
    o = np.argsort(score)
    s, y = score[o], bad[o]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    edge = np.r_[s[0] - 1, (s[1:] + s[:-1]) / 2, s[-1] + 1]
    least = np.flatnonzero(wrong <= wrong.min())
    return float(edge[least].mean())


def train(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int = SAMPLE) -> bytes | None:
    """The fitted model, from at most ``sample`` labelled documents per class."""
    ship(df.sparkSession)
    one = labels.where(f"{label} in (0, 1)").groupBy(id).agg(F.max(label).cast("int").alias("bad"))
    keep = one.where("bad = 1").orderBy(F.xxhash64(id), id).limit(sample).unionByName(one.where("bad = 0").orderBy(F.xxhash64(id), id).limit(sample))
    rows = df.select(F.col(id), F.col(text).alias("text")).join(F.broadcast(keep), id).where("text is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*frames, pd.DataFrame({"id": [], "text": [], "bad": []})]).sort_values("id")
        if pdf["bad"].nunique() == 2:
            yield pd.DataFrame({"model": [fit(pdf["text"].tolist(), pdf["bad"].to_numpy(int)).dumps()]})

    got = rows.select(F.col(id).alias("id"), "text", "bad").repartition(1).mapInPandas(run, "model binary").head()
    return bytes(got["model"]) if got else None


_MODELS: dict[int, Model] = {}


def scored(df: DataFrame, labels: DataFrame, id: str, text: str, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, score): the score of each document's worst passage; above 0 it is bad. Null where there is no text or no model."""
    model = train(df, labels, id, text, label, sample)
    given = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(given.value)
        if given.value is not None and key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Model.loads(given.value)
        for pdf in frames:
            out = np.full(len(pdf), np.nan)
            if given.value is not None:
                for a in range(0, len(pdf), 500):
                    per = [passages(t) for t in pdf["text"].iloc[a : a + 500]]
                    flat = [p for x in per for p in x]
                    s, at = _MODELS[key].passages(flat), 0
                    for i, x in enumerate(per):
                        if x:
                            out[a + i] = s[at : at + len(x)].max()
                            at += len(x)
            yield pd.DataFrame({"id": pdf["id"], "score": pd.Series(out).astype(object).where(~np.isnan(out), None)})

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, score double")


def rates(scores: DataFrame, documents: DataFrame, id: str, source: str) -> DataFrame:
    """(source, documents, bad, rate) over all documents."""
    return documents.select(F.col(id).alias("id"), F.col(source).alias("source")).join(scores, "id").groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") > 0).alias("bad")).withColumn("rate", F.col("bad") / F.col("documents"))
