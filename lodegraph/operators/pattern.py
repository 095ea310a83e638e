"""Pattern matching on a graph as joins: hops, optional hops, absence, bounded and unbounded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.graph import Graph
from lodegraph.operators.fixpoint import closure


def renamed(nodes: DataFrame, name: str) -> DataFrame:
    """Columns of the nodes as <name>_<column>."""
    return nodes.select(*[F.col(c).alias(f"{name}_{c}") for c in nodes.columns])


def hop(graph: Graph, left: DataFrame, a: str, rel_types: list[str], right: DataFrame, b: str, undirected: bool = False, optional: bool = False, where: Column | None = None) -> DataFrame:
    """left (with columns <a>_id) joined over edges to right nodes, named b; predicates of an optional hop are part of its join."""
    e = graph.edges.where(F.col("rel_type").isin(rel_types)) if rel_types else graph.edges
    e = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "rel_type")
    if undirected:
        e = e.union(e.select(F.col("_d"), F.col("_s"), "rel_type"))
    to = renamed(right, b)
    pairs = e.join(to, e["_d"] == to[f"{b}_id"])
    if where is not None:
        pairs = pairs.where(where)
    return left.join(pairs, left[f"{a}_id"] == pairs["_s"], "left" if optional else "inner").drop("_s", "_d")


def without(graph: Graph, nodes: DataFrame, rel_types: list[str], direction: str = "any") -> DataFrame:
    """Nodes that no such edge touches: absence is an anti join."""
    e = graph.edges.where(F.col("rel_type").isin(rel_types)) if rel_types else graph.edges
    ends = {"out": [e["src"]], "in": [e["dst"]], "any": [e["src"], e["dst"]]}[direction]
    touched = e.select(F.explode(F.array(*ends)).alias("id")).distinct()
    return nodes.join(touched, "id", "left_anti")


def path(graph: Graph, start: DataFrame, rel_types: list[str], least: int, most: int | None, undirected: bool = False) -> DataFrame:
    """(id, depth) over a bounded number of hops, or any number of hops of a containment relationship."""
    e = graph.edges.where(F.col("rel_type").isin(rel_types)).select("src", "dst")
    if undirected:
        e = e.union(e.select("dst", "src"))
    return closure(start.select("id"), e, most, 1 if least else 0).where(F.col("depth") >= least)
