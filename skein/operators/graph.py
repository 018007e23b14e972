"""Edge lists (src, rel, dst): hop templates as joins, in-degrees, topological levels, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.session import cut, small


def one_hop(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path, answer)."""
    return edges.join(starts.select(F.col("name").alias("src")), "src").select(F.col("src").alias("start"), F.col("rel").alias("path"), F.col("dst").alias("answer"))


def two_hops(edges: DataFrame, starts: DataFrame, not_rel: tuple[str, ...] = ()) -> DataFrame:
    """(start, path, answer) along two edges; the first one's relation isn't excluded."""
    first = one_hop(edges.where(~F.col("rel").isin(list(not_rel))) if not_rel else edges, starts).select("start", F.col("path").alias("r1"), F.col("answer").alias("src"))
    return first.join(edges, "src").select("start", F.concat_ws("|", "r1", "rel").alias("path"), F.col("dst").alias("answer"))


def siblings(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path, answer): what else the nodes that point at a start point at; no edge is used twice."""
    back = edges.join(starts.select(F.col("name").alias("dst")), "dst").select(F.col("dst").alias("start"), F.col("rel").alias("r1"), "src")
    return back.join(edges, "src").where("not (rel = r1 and dst = start)").select("start", F.concat_ws("|", "r1", "rel").alias("path"), F.col("dst").alias("answer")).distinct()


def grouped_paths(paths: DataFrame) -> DataFrame:
    """(start, path, answers): the answers of each path, tab-joined in order."""
    return paths.groupBy("start", "path").agg(F.array_join(F.array_sort(F.collect_set("answer")), "\t").alias("answers"))


def in_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree), 0 for vertices without incoming edges."""
    d = edges.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return vertices.select("name").join(d, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def topological_levels(vertices: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(name, level): the round in which a vertex has no unplaced predecessor left; vertices on cycles don't come out. State is checkpointed each round."""
    left, todo = cut(vertices.select("name").distinct()), cut(edges.select("src", "dst").distinct())
    out = None
    for level in range(most):
        free = cut(left.join(todo.select(F.col("dst").alias("name")).distinct(), "name", "left_anti"))
        if free.isEmpty():
            break
        part = free.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(free, "name", "left_anti"))
        todo = cut(todo.join(free.select(F.col("name").alias("src")), "src", "left_anti"))
    else:
        raise ValueError(f"the graph is deeper than {most} levels")
    return out if out is not None else left.withColumn("level", F.lit(0)).limit(0)


def shortest_paths(edges: DataFrame, start: str, most: int = 1000) -> DataFrame:
    """(name, distance) from one vertex by repeated relaxation; only vertices improved in the last round are joined with their edges."""
    spark = edges.sparkSession
    best = cut(spark.createDataFrame([(start, 0.0)], "name string, distance double"))
    front = best
    for _ in range(most):
        reach = front.join(edges, front["name"] == edges["src"]).groupBy(F.col("dst").alias("name")).agg(F.min(F.col("distance") + F.col("cost")).alias("new"))
        front = cut(reach.join(best, "name", "left").where("distance is null or new < distance").select("name", F.col("new").alias("distance")))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("name").agg(F.min("distance").alias("distance")))
    else:
        raise ValueError(f"some shortest path has more than {most} edges, or a cycle has a negative cost")
    return best


def hop_back(edges: DataFrame, starts: DataFrame, via: str) -> DataFrame:
    """(start, path, answer): an edge to p, back along an edge ``via`` that also leads to p, and on from there."""
    first = one_hop(edges, starts).select("start", F.col("path").alias("r1"), F.col("answer").alias("p"))
    back = edges.where(F.col("rel") == via).select(F.col("src").alias("q"), F.col("dst").alias("p"))
    third = first.join(back, "p").where("q <> start").join(edges.select(F.col("src").alias("q"), F.col("rel").alias("r2"), "dst"), "q")
    return third.select("start", F.concat_ws("|", "r1", F.lit(via), "r2").alias("path"), F.col("dst").alias("answer")).distinct()


def named_loop(edges: DataFrame, starts: DataFrame, via: str) -> DataFrame:
    """(start, path, answer): nodes that name a start by an edge ``via`` and have an edge to themselves, and where they lead on."""
    back = edges.where(F.col("rel") == via).join(starts.select(F.col("name").alias("dst")), "dst").select(F.col("dst").alias("start"), F.col("src").alias("q"))
    loops = edges.where("src = dst").select(F.col("src").alias("q"), F.col("rel").alias("r1"))
    on = edges.where("src <> dst").select(F.col("src").alias("q"), F.col("rel").alias("r2"), "dst")
    return back.join(loops, "q").join(on, "q").select("start", F.concat_ws("|", F.lit(via), "r1", "r2").alias("path"), F.col("dst").alias("answer")).distinct()


def templates(found: dict[str, DataFrame], most: int = 30_000) -> DataFrame:
    """(start, template, path, answer) of several templates; an entity's template with more than ``most`` answers says nothing and is left out, by a count with map-side combining."""
    rows = None
    for name, df in found.items():
        part = df.select("start", F.lit(name).alias("template"), "path", "answer")
        rows = part if rows is None else rows.unionByName(part)
    too_many = rows.groupBy("start", "template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("start", "template")
    return rows.join(small(too_many), ["start", "template"], "left_anti")


def relation_counts(edges: DataFrame) -> DataFrame:
    """(name, relations, facts): distinct relations and all edges of each entity, in whichever direction."""
    ends = edges.where("dst is not null").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("name"), "rel")
    return ends.groupBy("name", "rel").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.count(F.lit(1)).alias("relations"), F.sum("n").alias("facts"))


def edited(edges: DataFrame, add: DataFrame | None = None, drop: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Edges after adding and dropping edges and removing vertices (name) with all their edges."""
    out = edges if add is None else edges.unionByName(add)
    if drop is not None:
        out = out.join(small(drop), ["src", "rel", "dst"], "left_anti")
    if without is not None:
        for end in ("src", "dst"):
            out = out.join(small(without.select(F.col("name").alias(end))), end, "left_anti")
    return out.select("src", "rel", "dst").distinct()


def path_triples(paths: DataFrame) -> DataFrame:
    """(start, path, part, text): each path as a whole, its first and its second step."""
    step = lambda i: F.try_element_at(F.split("path", r"\|"), F.lit(i))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), x.alias("text")) for n, x in (("path", F.col("path")), ("first", step(1)), ("second", step(2)))])
    return paths.select("start", "path").distinct().select("start", "path", F.inline(parts)).where("text is not null")


def best_paths(paths: DataFrame, score: str, k: int = 2) -> DataFrame:
    """The best ``k`` paths of each start by score, ties by path."""
    r = paths.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy(F.desc(F.round(score, 9)), "path")))
    return r.where(F.col("rank") <= k)
