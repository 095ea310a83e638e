"""Checks of a graph against its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph import schema


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids at edges of which both ends exist."""
    ids = nodes.select("id").distinct()
    there = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return there.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge; a project may stand alone, and an edge to a missing node doesn't count."""
    return nodes.where("label <> 'Project'").join(connected(nodes, edges), "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that doesn't exist, each once."""
    a, b = nodes.select(F.col("id").alias("src"), F.lit(1).alias("_a")).distinct(), nodes.select(F.col("id").alias("dst"), F.lit(1).alias("_b")).distinct()
    return edges.select("src", "rel_type", "dst").distinct().join(a, "src", "left").join(b, "dst", "left").where("_a is null or _b is null").select("src", "rel_type", "dst")


def undocumented_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = lambda x: nodes.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
    known = nodes.sparkSession.createDataFrame(sorted(schema.TRIPLES), "src_label string, rel_type string, dst_label string")
    seen = edges.join(label("src"), "src").join(label("dst"), "dst").select("src_label", "rel_type", "dst_label").distinct()
    return seen.join(F.broadcast(known), ["src_label", "rel_type", "dst_label"], "left_anti")


def undocumented_labels(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("label").isin(list(schema.LABELS))).select("label").distinct()


def property_violations(nodes: DataFrame) -> DataFrame:
    """(label, property, check, n): required properties that are missing, and ones that the label doesn't document."""
    out = []
    for p in [c for c in nodes.columns if c not in ("id", "label", "key")]:
        required = [label for label, spec in schema.PROPERTIES.items() if spec.get(p)]
        documented = [label for label, spec in schema.PROPERTIES.items() if p in spec]
        known = F.col("label").isin(list(schema.PROPERTIES))
        out.append(F.struct(F.lit(p).alias("property"), F.when(F.col(p).isNull() & F.col("label").isin(required), "missing_required_property").when(F.col(p).isNotNull() & known & ~F.col("label").isin(documented), "undocumented_property").alias("check")))
    rows = nodes.select("label", F.explode(F.array(*out)).alias("x")).where("x.check is not null")
    return rows.groupBy("label", "x.property", "x.check").agg(F.count(F.lit(1)).alias("n"))
