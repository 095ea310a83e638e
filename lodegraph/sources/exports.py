"""Graphs as JSON documents and as snapshot folders with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.graph import Graph

DOCUMENT = (
    "nodes array<struct<node_id: bigint, labels: array<string>, properties: map<string, string>>>, "
    "relationships array<struct<from_id: bigint, to_id: bigint, type: string, properties: map<string, string>>>, metadata struct<total_nodes: bigint, total_relationships: bigint, exported_at: string>"
)


def read_document(spark: SparkSession, path: str) -> Graph:
    """An exported graph: nodes (id, labels, label, properties and the common ones as columns), edges (src, rel_type, dst, properties)."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    n = doc.select(F.explode("nodes").alias("n")).select(F.col("n.node_id").alias("id"), F.col("n.labels").alias("labels"), F.get("n.labels", F.lit(0)).alias("label"), F.col("n.properties").alias("properties"))
    n = n.select("*", *[F.element_at("properties", p).alias(p) for p in ("name", "qualified_name", "path")])
    e = doc.select(F.explode("relationships").alias("r")).select(F.col("r.from_id").alias("src"), F.col("r.type").alias("rel_type"), F.col("r.to_id").alias("dst"), F.col("r.properties").alias("properties"))
    return Graph(n, e)


def edges_of(graph: Graph, node: int, direction: str = "both") -> DataFrame:
    """Edges out of, into, or both ways at a node: in both a loop comes twice."""
    out, into = graph.edges.where(F.col("src") == node), graph.edges.where(F.col("dst") == node)
    return out if direction == "out" else into if direction == "in" else out.union(into)


def write_snapshot(graph: Graph, path: str, schema_hash: str) -> dict:
    """Sorted Parquet by label and relationship type, and a manifest with counts, coverage and a hash of the rows that
    doesn't depend on their order or on the files."""
    graph.nodes.repartition("label").sortWithinPartitions("id").write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.repartition("rel_type").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")
    spark = graph.nodes.sparkSession
    manifest = {"schema_hash": schema_hash, **_digest(read_snapshot(spark, path))}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def verify_snapshot(spark: SparkSession, path: str) -> list[str]:
    """Names of manifest entries that the tables no longer match."""
    manifest, now = read_manifest(spark, path), _digest(read_snapshot(spark, path))
    return sorted(k for k, v in now.items() if manifest.get(k) != v)


def _digest(graph: Graph) -> dict:
    out = {}
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).alias("h")).first()
        out |= {name: r["n"], f"{name}_hash": str(r["h"] or 0)}
    return out


def capture(graph: Graph, labels_off: list[str] = (), types_off: list[str] = ()) -> Graph:
    """Without some labels and relationship types, nor edges at such nodes."""
    nodes = graph.nodes.where(~F.col("label").isin(list(labels_off))) if labels_off else graph.nodes
    edges = graph.edges.where(~F.col("rel_type").isin(list(types_off))) if types_off else graph.edges
    if labels_off:
        ids = nodes.select("id")
        edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*graph.edges.columns)
    return Graph(nodes, edges)


def source_lines(modules: DataFrame, spans: DataFrame, clamp: bool = True) -> DataFrame:
    """spans (path, start_line, end_line, …) with the text of these lines from modules (path, text). An end beyond the file
    is cut to it, or with clamp off gives null."""
    lines = F.split("text", "\n")
    ok = (F.col("start_line") >= 1) & (F.col("start_line") <= F.size(lines)) & (F.col("end_line") >= F.col("start_line"))
    ok = ok if clamp else ok & (F.col("end_line") <= F.size(lines))
    cut = F.array_join(F.slice(lines, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return spans.join(modules.select("path", "text"), "path").select(*spans.columns, F.when(ok, cut).alias("source"))
