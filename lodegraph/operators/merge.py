"""Upserts, deletes and incremental maintenance of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.graph import Graph
from lodegraph.operators.fixpoint import closure
from lodegraph.operators.flow import spread
from lodegraph.storage import dealt, side


def merge_nodes(old: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old with the batch merged in: a null never overwrites, and of several values the last by seq wins. Rows without a key are skipped."""
    fields = [c for c in old.columns if c not in keys]
    have = batch.dropna(subset=keys)
    last = have.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in fields])
    both = old.join(last, keys, "full")
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def merge_edges(batch: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges whose ends exist, one for each (src, rel_type, dst, via, kind); nulls are a value of their own. rows: of the batch, where known."""
    ends, key = nodes.select("id").distinct(), ["src", "rel_type", "dst", "via", "kind"]
    # inner joins with distinct ends: the planner would push a semi join below dealt() and deal the rows twice
    there = dealt(batch, rows, "src").join(side(ends.withColumnRenamed("id", "src")), "src")
    there = dealt(there, rows, "dst").join(side(ends.withColumnRenamed("id", "dst")), "dst")
    return there.select(*batch.columns).dropDuplicates(key)


def attempted_and_created(batch: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(rel_type, attempted, created): rows of the batch, and those whose ends exist. rows: of the batch, where known."""
    ends = nodes.select("id").distinct()
    a, b = ends.select(F.col("id").alias("src"), F.lit(True).alias("_a")), ends.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    there = dealt(dealt(batch, rows, "src").join(side(a), "src", "left"), rows, "dst").join(side(b), "dst", "left")
    return there.groupBy("rel_type").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("_a") & F.col("_b")).alias("created"))


def delete_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """Without these nodes (id) and every edge at them."""
    gone = gone.select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*graph.edges.columns)
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges)


def delete_subtree(graph: Graph, roots: DataFrame, rel_types: list[str]) -> Graph:
    """Without the roots and all that they contain over these relationships."""
    return delete_nodes(graph, closure(roots.select("id"), graph.typed(*rel_types)))


def delete_orphan_externals(graph: Graph) -> Graph:
    """Without external modules that nothing refers to."""
    free = graph.labelled("ExternalModule").select("id").join(graph.edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
    return delete_nodes(graph, free)


def delete_unanchored_resources(graph: Graph, hops: int = 8) -> Graph:
    """Without resources from which no other node is reached over so many FLOWS_TO edges in any direction."""
    flows = graph.typed("FLOWS_TO").select("src", "dst")
    anchors = graph.nodes.where("label <> 'Resource'").select("id")
    near = closure(anchors, flows.union(flows.select("dst", "src")), hops).select("id")
    return delete_nodes(graph, graph.labelled("Resource").select("id").join(near, "id", "left_anti"))


def file_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) from two tables (path, hash): new, gone, changed or same."""
    both = before.withColumnRenamed("hash", "h0").join(after.withColumnRenamed("hash", "h1"), "path", "full")
    return both.select("path", F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "gone").when(F.col("h0") == F.col("h1"), "same").otherwise("changed").alias("state"))


def affected_callers(graph: Graph, changed: DataFrame) -> DataFrame:
    """(path) of the files whose definitions refer to a definition in a changed file (path); one level, no more."""
    e = graph.typed("CALLS", "REFERENCES", "INSTANTIATES", "INHERITS", "IMPORTS")
    path = lambda x: graph.nodes.select(F.col("id").alias(x), F.col("path").alias(f"{x}_path"))
    hit = e.join(path("dst"), "dst").join(changed.select(F.col("path").alias("dst_path")).distinct(), "dst_path", "left_semi")
    return hit.join(path("src"), "src").where("src_path is not null").select(F.col("src_path").alias("path")).distinct().join(changed.select("path"), "path", "left_anti")


def restore_inbound(before: Graph, after: Graph, changed: DataFrame) -> Graph:
    """After a re-parse of changed files: the edges that led into their definitions from elsewhere come back if both ends still exist."""
    here = before.nodes.join(changed.select("path"), "path", "left_semi").select("id")
    into = before.edges.join(here.withColumnRenamed("id", "dst"), "dst", "left_semi").join(here.withColumnRenamed("id", "src"), "src", "left_anti").select(*before.edges.columns)
    ids = after.nodes.select("id")
    back = into.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*before.edges.columns)
    return Graph(after.nodes, after.edges.union(back).distinct())


def append_edges(old: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """CREATE: every row of the batch whose ends exist is an edge of its own, whatever is there."""
    ends = nodes.select("id").distinct()
    there = batch.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.unionByName(there.select(*old.columns))


def with_and_without_key(batch: DataFrame, key_of: dict[str, str]) -> DataFrame:
    """(label, written, skipped) of a batch with a column label: rows without the key property of their label are skipped and counted."""
    key = F.lit(None).cast("string")
    for label, column in key_of.items():
        key = F.when(F.col("label") == label, F.col(column).cast("string")).otherwise(key)
    return batch.groupBy("label").agg(F.count_if(key.isNotNull()).alias("written"), F.count_if(key.isNull()).alias("skipped"))


CONTAINS = ["CONTAINS_PACKAGE", "CONTAINS_FOLDER", "CONTAINS_FILE", "CONTAINS_MODULE"]


def purge_shared(graph: Graph, labels: tuple[str, ...] = ("Folder", "File"), key: str = "absolute_path") -> Graph:
    """Without nodes of these labels that more than one project contains, or that have no key. Owners spread down the containment edges together."""
    down = graph.typed(*CONTAINS).select(F.col("dst").alias("caller"), F.col("src").alias("callee")).distinct()
    owners = spread(graph.labelled("Project").select(F.col("id").alias("fn"), F.col("id").alias("project")), down, ["project"])
    shared = owners.groupBy("fn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("fn").alias("id"))
    these = graph.labelled(*labels)
    gone = these.join(shared, "id", "left_semi").select("id")
    if key in graph.nodes.columns:
        gone = gone.union(these.where(F.col(key).isNull()).select("id"))
    return delete_nodes(graph, gone)


def prune_vanished(graph: Graph, listing: DataFrame, rel_types: list[str], labels: tuple[str, ...] = ("Module", "File", "Folder", "Package")) -> Graph:
    """Without the nodes of these labels whose path isn't listed (path) any more, and all that they contain."""
    gone = graph.labelled(*labels).where("path is not null").join(listing.select("path").distinct(), "path", "left_anti").select("id")
    return delete_subtree(graph, gone, rel_types)


def replace_files(before: Graph, changed: DataFrame, parsed: Graph, rel_types: list[str]) -> Graph:
    """A re-parse: the changed files' modules go with all that they define, what was parsed anew comes, and edges from elsewhere come back."""
    old = before.nodes.join(changed.select("path").distinct(), "path", "left_semi").select("id")
    kept = delete_subtree(before, old, rel_types)
    after = Graph(kept.nodes.unionByName(parsed.nodes), kept.edges.unionByName(parsed.edges))
    return restore_inbound(before, after, changed)


def relink(edges: DataFrame, rel_type: str, sources: DataFrame, fresh: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges of the type that leave these sources (id) are dropped and the fresh ones take their place. rows: edges at most, where known."""
    such = F.col("rel_type").eqNullSafe(rel_type)
    gone = sources.select(F.col("id").alias("src"), F.lit(True).alias("_gone")).distinct()
    kept = dealt(edges.where(such), rows, "src").join(side(gone), "src", "left").where("_gone is null")  # an anti join would be pushed below dealt()
    new = edges.where(~such).unionByName(kept.select(*edges.columns)).unionByName(fresh.select(*edges.columns))
    return dealt(new, rows, *edges.columns).distinct()
