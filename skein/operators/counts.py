"""Word, n-gram and co-occurrence statistics; everything is counted with map-side combining."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import char_grams
from skein.session import cut

BEGIN, END = "<SOS>", "<EOS>"


def word_counts(df: DataFrame, tokens: str, least: int = 1) -> DataFrame:
    return df.select(F.explode(tokens).alias("word")).where("word is not null and trim(word) <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def bigrams(df: DataFrame, tokens: str) -> DataFrame:
    """(w1, w2, n), with marks for begin and end; the pair is the key, never its concatenation."""
    padded = F.concat(F.array(F.lit(BEGIN)), F.filter(F.col(tokens), lambda t: t.isNotNull()), F.array(F.lit(END)))
    pairs = df.where(F.col(tokens).isNotNull()).select(padded.alias("a")).select(F.explode(F.zip_with(F.slice("a", F.lit(1), F.size("a") - 1), F.slice("a", F.lit(2), F.size("a") - 1), lambda x, y: F.struct(x.alias("w1"), y.alias("w2")))).alias("p"))
    return pairs.select("p.w1", "p.w2").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))


def grams(df: DataFrame, text: str, longest: int) -> DataFrame:
    """(gram, n) of all character runs of 1 to ``longest``."""
    runs = F.flatten(F.array(*[char_grams(F.col(text), n) for n in range(1, longest + 1)]))
    return df.where(F.col(text).isNotNull()).select(F.explode(runs).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def pointwise_information(counted: DataFrame) -> DataFrame:
    """(gram, n, pmi): the least log10 of observed over expected frequency, over all splits of a gram of 2 or more characters."""
    by_length = counted.withColumn("k", F.length("gram"))
    totals = by_length.groupBy("k").agg(F.sum("n").alias("total"))
    p = by_length.join(F.broadcast(totals), "k").select("gram", "n", "k", (F.col("n") / F.col("total")).alias("p"))
    splits = p.where("k > 1").select("gram", "n", "p", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("i")).select("gram", "n", "p", F.expr("substring(gram, 1, i)").alias("l"), F.expr("substring(gram, i + 1)").alias("r"))
    left, right = p.select(F.col("gram").alias("l"), F.col("p").alias("pl")), p.select(F.col("gram").alias("r"), F.col("p").alias("pr"))
    return splits.join(left, "l").join(right, "r").groupBy("gram", "n").agg(F.min(F.log10(F.col("p") / (F.col("pl") * F.col("pr")))).alias("pmi"))


def branching_entropy(counted: DataFrame, side: str) -> DataFrame:
    """(gram, entropy): log10 entropy of the characters that follow (right) or precede (left) a gram."""
    g = counted.where(F.length("gram") > 1)
    part = F.expr("substring(gram, 1, length(gram) - 1)") if side == "right" else F.expr("substring(gram, 2)")
    children = g.select(part.alias("parent"), "n")
    totals = children.groupBy("parent").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return children.join(totals, "parent").groupBy(F.col("parent").alias("gram")).agg(F.sum(-p * F.log10(p)).alias("entropy"))


def new_words(df: DataFrame, text: str, longest: int = 5, least_n: int = 5, least_pmi: float = 1.5, least_entropy: float = 0.5) -> DataFrame:
    """(gram, n, pmi, left, right, score): grams that stick together inside and vary outside."""
    counted = grams(df, text, longest)
    kept = pointwise_information(counted).where((F.col("n") >= least_n) & (F.col("pmi") >= least_pmi) & ~F.col("gram").rlike("^[a-z]+$|^[0-9]+$"))
    left, right = branching_entropy(counted, "left").withColumnRenamed("entropy", "left"), branching_entropy(counted, "right").withColumnRenamed("entropy", "right")
    j = kept.join(left, "gram").join(right, "gram").where((F.col("left") >= least_entropy) & (F.col("right") >= least_entropy))
    apart = F.abs(F.col("left") - F.col("right"))
    score = F.when(apart < 1e-9, F.col("pmi") + F.col("left") + F.col("right")).otherwise(F.col("pmi") + F.col("right") * F.ln(F.col("left") / apart) + F.col("left") * F.ln(F.col("right") / apart))
    return j.withColumn("score", score)


def cooccurrence(df: DataFrame, tokens: str, window: int = 3) -> DataFrame:
    """(a, b, weight): undirected, a <= b; each ordered pair of places within the window adds window - distance + 1, so every pair counts from both sides."""
    clean = df.select(F.filter(F.col(tokens), lambda t: t.isNotNull() & (F.trim(t) != "")).alias("w")).where("size(w) > 1")
    places = clean.select("w", F.posexplode("w").alias("i", "x"))
    pairs = places.select("x", F.posexplode(F.slice("w", F.col("i") + 2, F.lit(window))).alias("k", "y")).withColumn("v", window - F.col("k"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "v").groupBy("a", "b").agg((F.sum("v") * 2).alias("weight"))


#: Products of edges, and cells of a table of pairs, that a task holds at once: few enough to stay in a CPU's cache.
PRODUCTS, CELLS = 250_000, 250_000
#: Edges that a node counts as at least when blocks are made: those of few edges are many, and a task's time grows with its pairs of nodes.
LIGHT = 8


def _similar(t: pa.Table, least: float) -> pa.Table:
    """(x, y, similarity) of the nodes of one block, or of each node of one block with each of the other: a sparse product by rows of bounded size."""
    if len(t) and t["lo"][0].as_py() != t["hi"][0].as_py() and pc.count_distinct(t["block"]).as_py() < 2:
        return pa.table({"x": pa.array([], pa.string()), "y": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
    t = t.take(pc.sort_indices(t["a"])).combine_chunks()  # a node's place tells its order by name
    links = t["l"].combine_chunks()
    d, flat = pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64), links.flatten()
    n, node, w = len(t), np.repeat(np.arange(len(t)), d), flat.field("weight").to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.field("b").dictionary_encode()
    b, kinds = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    total = np.bincount(node, w, n)
    own = t["block"].to_numpy() == t["lo"][0].as_py()
    one = t["lo"][0].as_py() == t["hi"][0].as_py()
    other = np.flatnonzero(one | ~own[node])
    other = other[np.lexsort((node[other], b[other]))]  # edges of the other side by neighbour, then by node
    cols = np.arange(n) if one else np.flatnonzero(~own)
    column = np.empty(n, np.int64)
    column[cols] = np.arange(len(cols))
    ny, wy, at = column[node[other]], w[other], np.searchsorted(b[other], np.arange(kinds + 1))
    if one:  # only nodes that come after a node in the order
        first = np.empty(len(b), np.int64)
        first[other] = np.arange(len(other)) + 1
    else:
        first = at[b]
    edges = np.flatnonzero(own[node])
    many = at[b[edges] + 1] - first[edges]
    edges, many = edges[many > 0], many[many > 0]
    of, share, fewest = node[edges], max(least, 0) / (1 + max(least, 0)) * (1 - 1e-9), d[cols].min() if len(cols) else 0
    out, i, done = [], 0, np.append(0, np.cumsum(many))
    while i < len(edges):
        low = of[i]
        base = low if one else 0  # the first column that is met
        width = len(cols) - base
        # whole nodes up to the bounds, one at least
        stop = min(np.searchsorted(done, done[i] + PRODUCTS, "right") - 1, np.searchsorted(of, low + max(CELLS // width, 1)))
        stop = max(np.searchsorted(of, of[stop]) if stop < len(edges) else stop, np.searchsorted(of, low, "right"))
        e, k, begin = edges[i:stop], many[i:stop], done[i:stop] - done[i]
        place = np.repeat(first[e] - begin, k) + np.arange(k.sum())
        rows = of[stop - 1] - low + 1
        key, cells = np.repeat((of[i:stop] - low) * width - base, k) + ny[place], rows * width
        if sparse := len(key) * 16 < cells:
            order = np.argsort(key)
            keys = key[order]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            pair, c = keys[start], np.diff(np.append(start, len(keys)))
        else:
            c = np.bincount(key, minlength=cells)
            pair = np.flatnonzero(c > int(share * (d[of[i:stop]].min() + fewest)))  # no more common neighbours than this are too few for any pair here
            c = c[pair]
        p, q = np.divmod(pair, width)
        p, q = p + low, cols[q + base]
        near = c / (d[p] + d[q] - c)
        kept = np.flatnonzero(near > least)  # the shares are 1 at most
        pair, p, q, near, c = pair[kept], p[kept], q[kept], near[kept], c[kept]
        if sparse:
            at_hit = np.repeat(np.arange(len(pair)), c)
            used = order[np.repeat(start[kept] - np.cumsum(c) + c, c) + np.arange(len(at_hit))]
        else:
            number, met = np.empty(cells, np.int32), np.zeros(cells, bool)
            number[pair], met[pair] = np.arange(len(pair)), True
            used = np.flatnonzero(met[key])
            at_hit = number[key[used]]
        cp, cq = np.bincount(at_hit, w[e[np.searchsorted(begin, used, "right") - 1]], len(pair)), np.bincount(at_hit, wy[place[used]], len(pair))
        sp, sq = cp / total[p], cq / total[q]
        s = near * np.where(p < q, sp, sq) * np.where(p < q, sq, sp)
        kept = s > least
        out.append((np.minimum(p, q)[kept], np.maximum(p, q)[kept], s[kept]))
        i = stop
    x, y, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    names = t["a"].combine_chunks()
    return pa.table({"x": names.take(pa.array(x)), "y": names.take(pa.array(y)), "similarity": s})


def network_similarity(edges: DataFrame, least: float = 0.25, block: tuple[int, int] = (50_000, 1_000_000)) -> DataFrame:
    """(x, y, similarity): jaccard of the neighbour sets times the shares of each one's edge weight that goes to common neighbours; exact, all pairs above ``least``.

    A pair and a neighbour of both never become a row. Nodes are put into blocks by the number of binary digits of their degree, and by
    hash where a class has more edges than ``block`` allows (a sixteenth of all, between its two bounds); a task multiplies two blocks.
    The jaccard is at most the ratio of the degrees, so classes that are too far apart don't meet, and hubs meet hubs only.
    """
    both = edges.where("a <> b").select("a", "b", "weight").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    nodes = cut(both.groupBy("a").agg(F.collect_list(F.struct("b", "weight")).alias("l")).withColumn("class", F.length(F.bin(F.size("l").cast("long")))))
    sizes = {r[0]: r[1] for r in nodes.groupBy("class").agg(F.sum(F.greatest(F.size("l"), F.lit(LIGHT)))).collect()}  # a row for each number of digits
    most, span = min(max(sum(sizes.values()) // 16, block[0]), block[1]), math.ceil(math.log2(1 / least)) if least > 0 else 64
    parts = [(c, i, -(-size // most)) for c, size in sorted(sizes.items()) for i in range(-(-size // most))]
    met = [(c, i, n, p, min(p, q), max(p, q)) for p, (c, i, n) in enumerate(parts) for q, (o, _, _) in enumerate(parts) if abs(c - o) <= span]
    meet = F.broadcast(edges.sparkSession.createDataFrame(met, "class int, i int, n int, block int, lo int, hi int"))
    sides = nodes.join(meet, (nodes["class"] == meet["class"]) & (F.pmod(F.xxhash64("a"), F.col("n")) == F.col("i"))).select("a", "l", "block", "lo", "hi")
    return sides.groupBy("lo", "hi").applyInArrow(lambda t: _similar(t, least), "x string, y string, similarity double")


def sentence_probability(df: DataFrame, id: str, tokens: str) -> DataFrame:
    """(id, log_probability, perplexity) by bigrams, each over the count of its first word."""
    counted = bigrams(df, tokens)
    firsts = counted.groupBy("w1").agg(F.sum("n").alias("n1"))
    p = counted.join(firsts, "w1").select("w1", "w2", F.ln(F.col("n") / F.col("n1")).alias("lp"))
    padded = F.concat(F.array(F.lit(BEGIN)), F.filter(F.col(tokens), lambda t: t.isNotNull()), F.array(F.lit(END)))
    rows = df.where(F.col(tokens).isNotNull()).select(id, padded.alias("a")).select(id, F.inline(F.zip_with(F.slice("a", F.lit(1), F.size("a") - 1), F.slice("a", F.lit(2), F.size("a") - 1), lambda x, y: F.struct(x.alias("w1"), y.alias("w2")))))
    return rows.join(p, ["w1", "w2"]).groupBy(id).agg(F.sum("lp").alias("log_probability"), F.exp(-F.avg("lp")).alias("perplexity"))


def sif_weight(n: Column, total: Column, a: float = 1e-3) -> Column:
    """Smooth inverse frequency."""
    return a / (a + n / total)
