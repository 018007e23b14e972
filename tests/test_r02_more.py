"""What the second round of review found, second part."""

import math
import random

import pytest
from conftest import rows


def _graph(spark, n, hubs, seed):
    r = random.Random(seed)
    edges = {}
    for i in range(n):
        for j in r.sample(range(40), r.choice((0, 1, 2, 12))) + r.sample(range(hubs), 2):
            a, b = sorted((f"n{i}", f"n{j}"))
            edges[a, b] = r.randrange(1, 9)  # some of a node with itself
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a string, b string, weight long"), edges


@pytest.mark.parametrize("block", [(50_000, 1_000_000), (40, 90)])
@pytest.mark.parametrize("least", [0.25, 0.04, 0.0])
def test_network_similarity_is_that_of_all_pairs(spark, least, block):
    from skein.operators import counts

    df, edges = _graph(spark, 160, 5, 3)
    near = {}
    for (a, b), w in edges.items():
        if a != b:
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
    want = []
    for x in near:
        for y in near:
            both = near[x].keys() & near[y].keys()
            if x < y and both:
                s = len(both) / (len(near[x]) + len(near[y]) - len(both)) * (sum(near[x][b] for b in both) / sum(near[x].values())) * (sum(near[y][b] for b in both) / sum(near[y].values()))
                if s > least:
                    want.append((x, y, s))
    assert len(want) > 3
    assert rows(counts.network_similarity(df, least, block)) == sorted(want, key=repr)


def test_network_similarity_makes_no_row_for_a_pair_and_a_neighbour(spark):
    """Fails where the nodes of a hub meet as rows: 3,000 nodes of one hub are 4,498,500 pairs."""
    from skein.operators import counts

    df = spark.range(3000).selectExpr("concat('n', id) as a", "'z' as b", "1L as weight").unionByName(spark.range(3000).selectExpr("concat('n', id) as a", "concat('o', id) as b", "9L as weight"))
    got = counts.network_similarity(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan
    assert got.count() == 0


def test_products_in_small_pieces_are_the_same(spark, monkeypatch):
    import pyarrow as pa

    from skein.operators import counts

    r = random.Random(7)
    t = pa.table({"a": [f"n{i}" for i in range(60)], "l": pa.array([[{"b": f"m{j}", "weight": r.randrange(1, 5)} for j in r.sample(range(30), r.randrange(1, 9))] for _ in range(60)], pa.list_(pa.struct([("b", pa.string()), ("weight", pa.int64())]))), "block": [i % 2 for i in range(60)], "lo": [0] * 60, "hi": [1] * 60})
    whole = counts._similar(t, 0.02).to_pylist()
    monkeypatch.setattr(counts, "PRODUCTS", 5)
    monkeypatch.setattr(counts, "CELLS", 7)
    key = lambda d: (d["x"], d["y"])
    assert len(whole) > 5 and sorted(whole, key=key) == sorted(counts._similar(t, 0.02).to_pylist(), key=key)


def test_cooccurrence_counts_every_place_of_the_window(spark):
    from skein.operators import counts

    data = [["a", "b", "a", "c", "d", None, " ", "a"], ["a"], [], None, ["b", "b"]]
    want = {}
    for w in data:
        w = [t for t in w or [] if t and t.strip()]
        for i in range(len(w)):
            for j in range(i + 1, min(i + 4, len(w))):
                k = tuple(sorted((w[i], w[j])))
                want[k] = want.get(k, 0) + 2 * (4 - (j - i))
    assert rows(counts.cooccurrence(spark.createDataFrame([(w,) for w in data], "t array<string>"), "t")) == sorted(((*k, v) for k, v in want.items()), key=repr)
    assert math.isclose(sum(want.values()), 2 * sum((3 if j - i == 1 else 2 if j - i == 2 else 1) for n in (6, 2) for i in range(n) for j in range(i + 1, min(i + 4, n))))


def test_synonyms_make_no_row_for_a_pair_and_a_neighbour(spark, sf):
    from skein.plans import queries as core

    got = core.QUERIES["q_synonyms"](spark, sf)
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    net = got.where("method = 'network'").drop("method")
    assert rows(net) == rows(core.QUERIES["q_network_similarity"](spark, sf)) and net.count() > 0


def test_terms_held_by_documents_of_the_same_key(spark):
    from skein.operators import retrieve

    r = random.Random(11)
    words = ["ab", "bc", "呕吐", "吐", "zz", "a"]
    docs = [(i, "".join(r.choices(words, k=3)) if i % 9 else None, r.choice(("", "", "", "d1", "d2", None))) for i in range(300)] + [(400, "", "d1"), (401, "ab", "alone")]
    asks = [(i, r.sample(words, r.randrange(4)), r.choice(("", "d1", "d2", "other", None))) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, s string, k string").repartition(3)
    qs = spark.createDataFrame(asks, "qid long, t array<string>, k string")
    want = sorted(((q, i, sum(w in s for w in t), len(t)) for q, t, k in asks for i, s, m in docs if k is not None and k == m and s is not None), key=repr)
    for side in (2_000, 7):
        assert rows(retrieve.held_terms(df, "id", "s", qs, "qid", "t", "k", side)) == want


def test_a_hot_key_is_spread_over_tasks(spark):
    """Fails where all pairs of a key are made in one task."""
    from pyspark.sql import functions as F

    from skein.operators import retrieve

    df = spark.range(6000).selectExpr("id", "concat('x', id) as s", "'' as k")
    got = retrieve.held_terms(df, "id", "s", df.selectExpr("id", "array('x1') as t", "k").where("id % 60 = 0"), "id", "t", "k", side=500)
    per_task = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(per_task) == 600_000 and len(per_task) > 1


def test_proximity_spreads_the_questions_of_a_disease(spark, sf):
    from skein.plans import queries as core

    assert "FlatMapCoGroupsInArrow" in core.QUERIES["q_proximity"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_empty_tables_and_queries_without_terms(spark):
    from skein.operators import counts, retrieve

    assert rows(counts.network_similarity(spark.createDataFrame([], "a string, b string, weight long"))) == []
    df = spark.createDataFrame([(1, "x", "k"), (2, "", "k")], "id long, s string, k string")
    qs = spark.createDataFrame([(7, [], "k")], "qid long, t array<string>, k string")
    assert rows(retrieve.held_terms(df, "id", "s", qs, "qid", "t", "k")) == [(7, 1, 0, 0), (7, 2, 0, 0)]
    assert rows(retrieve.held_terms(df.limit(0), "id", "s", qs, "qid", "t", "k")) == []


@pytest.mark.parametrize("hubs", [12, 400])  # many products per pair of nodes, and few
@pytest.mark.parametrize("sides", [1, 2])
def test_similar_nodes_are_found_in_pieces_of_bounded_size(hubs, sides):
    """Fails where a piece of the product outgrows a CPU's cache: pieces of 2,000,000 products took over 80 MB."""
    import tracemalloc

    import pyarrow as pa

    from skein.operators import counts

    r = random.Random(hubs)
    near = {f"n{i}": {f"h{j}": r.randrange(1, 9) for j in r.sample(range(hubs), 3)} for i in range(3000)}
    want = {}
    for x in near:
        for y in near:
            both = near[x].keys() & near[y].keys() if x < y and (sides == 1 or int(x[1:]) % 2 != int(y[1:]) % 2) else ()
            if both:
                s = len(both) / (6 - len(both)) * (sum(near[x][b] for b in both) / sum(near[x].values())) * (sum(near[y][b] for b in both) / sum(near[y].values()))
                if s > 0.25:
                    want[x, y] = s
    block = [int(x[1:]) % sides for x in near]
    t = pa.table({"a": list(near), "l": [[{"b": b, "weight": w} for b, w in near[x].items()] for x in near], "block": pa.array(block, pa.int32()), "lo": pa.array([0] * 3000, pa.int32()), "hi": pa.array([sides - 1] * 3000, pa.int32())})
    tracemalloc.start()
    got = counts._similar(t, 0.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(x["x"], x["y"]): x["similarity"] for x in got.to_pylist()} == want and len(want) > 50
    assert peak < 60e6
