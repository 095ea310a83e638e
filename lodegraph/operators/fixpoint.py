"""Iterative graph algorithms over edge tables (src, dst). Every loop keeps a narrow frontier, writes each
round to the shared checkpoint folder and stops when a round adds nothing. Joins broadcast only what is
counted and short (storage.side): what a loop makes has no size that the planner could know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import cut, side, together


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(reverse(edges))


def closure(start: DataFrame, edges: DataFrame, max_depth: int | None = None, min_depth: int = 0) -> DataFrame:
    """(id, depth) of everything reachable from start (id), at its least number of steps; min_depth 1 leaves the
    start out unless a cycle leads back to it."""
    edges = edges.select("src", "dst").distinct()
    front = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    levels, depth = ([front] if min_depth == 0 else []), 0  # each round is a table; now and then they become one
    rows = front.count()
    seen = rows if levels else 0
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = side(front, rows).join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        if levels:
            step = step.join(side(together(levels).select("id"), seen), "id", "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth)))
        rows = front.count()
        if rows:
            levels, seen = [*levels, front], seen + rows
        if len(levels) > 8:
            levels = [cut(together(levels))]
    return together(levels) if levels else front.limit(0)


def shortest_paths(start: DataFrame, edges: DataFrame, max_depth: int | None = None, order: Column | None = None) -> DataFrame:
    """(id, depth, path) of all but the start: the shortest path, of several the one through the parent found
    first (rank within its level), then the smaller name. The path includes both ends."""
    edges = edges.select("src", "dst").distinct()
    front = cut(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.array(F.col("id")).alias("rank")))
    seen, depth, rows = front, 0, front.count()
    n_seen = rows
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        step = side(front, rows * depth).join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.concat("rank", F.array("dst")).alias("rank"))
        step = step.join(side(seen.select("id"), n_seen), "id", "left_anti")
        front = cut(step.groupBy("id").agg(F.min_by(F.struct("depth", "path", "rank"), "rank").alias("b")).select("id", "b.*"))
        if rows := front.count():
            seen, n_seen = cut(seen.union(front)), n_seen + rows
    return seen.where("depth > 0").select("id", "depth", "path")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the weakly connected component, by hooking on the least neighbour and jumping."""
    both = cut(both_ways(edges).where("src <> dst").distinct())
    label = cut(nodes.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(side(label.select(F.col("id").alias("dst"), "component")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        hooked = label.join(side(near), "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        roots = hooked.select(F.col("id").alias("r"), F.col("component").alias("up"))
        new = cut(hooked.join(side(roots), hooked["component"] == roots["r"]).select("id", "was", F.least("component", "up").alias("component")))
        if new.where("was <> component").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")


def strongly_connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, component) with the smallest id of the strongly connected component: each round colours every open node
    by the least id that reaches it, then collects what reaches back within a colour."""
    left, links = cut(nodes.select("id").distinct()), cut(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        colour = cut(left.withColumn("c", F.col("id")))
        while True:
            near = links.join(side(colour), links["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("near"))
            new = cut(colour.join(side(near), "id", "left").select("id", F.col("c").alias("was"), F.least("c", F.coalesce("near", "c")).alias("c")))
            colour = new.select("id", "c")
            if new.where("was <> c").isEmpty():
                break
        inside = links.join(side(colour.select(F.col("id").alias("src"), F.col("c").alias("cs"))), "src").join(side(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))), "dst").where("cs = cd").select("src", "dst")
        found = closure(colour.where("id = c").select("id"), reverse(cut(inside))).select("id")
        part = cut(found.join(side(colour), "id").select("id", F.col("c").alias("component")))
        done = part if done is None else cut(together([done, part]))
        left = cut(left.join(side(part), "id", "left_anti"))
        links = cut(links.join(side(left.select(F.col("id").alias("src"))), "src", "left_semi").join(side(left.select(F.col("id").alias("dst"))), "dst", "left_semi"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component")).limit(0)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank), starting at 1 a node; nodes without out-edges keep their rank to themselves."""
    n = nodes.select("id").distinct()
    out = edges.select("src", "dst").distinct()
    weighted = cut(out.join(side(out.groupBy("src").count()), "src").select("src", "dst", (1.0 / F.col("count")).alias("w")))
    rank = cut(n.withColumn("rank", F.lit(1.0)))
    for _ in range(rounds):
        got = weighted.join(side(rank), weighted["src"] == rank["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        rank = cut(n.join(side(got), n["id"] == got["dst"], "left").select("id", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return rank


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) with zeros."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(side(n), "id", "left").select("id", zero("n_in"), zero("n_out"))


def topological_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, level) by peeling nodes without predecessors; nodes on or behind a cycle are left out."""
    left, links, done = cut(nodes.select("id").distinct()), cut(edges.select("src", "dst").distinct()), []
    for level in range(max_rounds):
        free = cut(left.join(side(links.select(F.col("dst").alias("id")).distinct()), "id", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if not (rows := free.count()):
            break
        done = [*done, free] if len(done) < 8 else [cut(together([*done, free]))]
        left = cut(left.join(side(free, rows), "id", "left_anti"))
        links = cut(links.join(side(free.select(F.col("id").alias("src")), rows), "src", "left_anti"))
    return together(done) if done else nodes.select("id", F.lit(0).cast("long").alias("level")).limit(0)


def similarity(edges: DataFrame, min_shared: int = 1) -> DataFrame:
    """(a, b, jaccard) of nodes that share out-neighbours; meant for neighbours of bounded in-degree."""
    e = edges.select("src", "dst").distinct()
    size = e.groupBy("src").count()
    pair = e.select(F.col("src").alias("a"), "dst").join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    sized = pair.join(size.select(F.col("src").alias("a"), F.col("count").alias("na")), "a").join(size.select(F.col("src").alias("b"), F.col("count").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))
