"""The graph: nodes (id, label, qualified_name, name, path, ...) and edges (src, rel_type, dst, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.storage import dealt


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    rows: int | None = None  # edges at most, where that is known

    def labelled(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(list(labels)))

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("rel_type").isin(list(types)))


def from_tables(spark: SparkSession, sf_dir: str, once: bool = True) -> Graph:
    """The star schema as a code graph: regions are projects, nations packages, customers modules, suppliers classes
    and parts functions; customers call the parts they order, parts reference the suppliers that ship them.
    once: no edge is repeated; what doesn't ask for that saves its shuffle."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    region, nation = t("region"), t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    package = F.concat_ws(".", "r_name", "n_name")
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    no = F.lit(None)

    def node(df, id_, label, qn, name, path=no, line=no, end=no, flag=no):
        return df.select(id_.alias("id"), F.lit(label).alias("label"), qn.alias("qualified_name"), name.alias("name"), path.cast("string").alias("path"), line.cast("long").alias("start_line"), end.cast("long").alias("end_line"), flag.cast("boolean").alias("flow_covered"))

    c = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    nodes = node(region, c("r", "r_regionkey"), "Project", F.col("r_name"), F.col("r_name"))
    nodes = nodes.union(node(nation, c("n", "n_nationkey"), "Package", package, F.col("n_name"), F.concat_ws("/", "r_name", "n_name")))
    nodes = nodes.union(node(customer, c("c", "c_custkey"), "Module", F.concat_ws(".", package, "c_name"), F.col("c_name"), F.concat(F.concat_ws("/", "r_name", "n_name", "c_name"), F.lit(".py")), flag=F.col("c_acctbal") > 0))
    nodes = nodes.union(node(supplier, c("s", "s_suppkey"), "Class", F.concat_ws(".", package, "s_name"), F.col("s_name"), F.concat(F.concat_ws("/", "r_name", "n_name", "s_name"), F.lit(".ts"))))
    part_path = F.concat(F.lit("part/"), F.col("p_brand"), F.lit(".go"))
    nodes = nodes.union(node(t("part"), c("p", "p_partkey"), "Function", F.concat_ws(".", F.lit("part"), F.col("p_brand"), c("f", "p_partkey")), c("f", "p_partkey"), part_path, F.col("p_partkey") * 10, F.col("p_partkey") * 10 + F.col("p_size")))
    edge = lambda df, s, rel, d: df.select(s.alias("src"), F.lit(rel).alias("rel_type"), d.alias("dst"))
    edges = edge(nation, c("r", "n_regionkey"), "CONTAINS_PACKAGE", c("n", "n_nationkey"))
    edges = edges.union(edge(t("customer"), c("n", "c_nationkey"), "CONTAINS_MODULE", c("c", "c_custkey")))
    edges = edges.union(edge(t("supplier"), c("n", "s_nationkey"), "DEFINES", c("s", "s_suppkey")))
    n = t("lineitem").count()  # of the files' footers
    each = lambda df: dealt(df, n, *df.columns).distinct() if once else df
    line, order = dealt(t("lineitem").select("l_orderkey", "l_partkey"), n, "l_orderkey"), t("orders").select("o_orderkey", "o_custkey")
    ordered = each(line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey"))
    edges = edges.union(edge(ordered, c("c", "o_custkey"), "CALLS", c("p", "l_partkey")))
    edges = edges.union(edge(each(t("lineitem").select("l_partkey", "l_suppkey")), c("p", "l_partkey"), "REFERENCES", c("s", "l_suppkey")))
    return Graph(nodes, edges, 2 * n + t("customer").count() + t("supplier").count() + t("nation").count())
