"""Registered queries over the star schema seen as a graph, each with the SQL of the same result.

table expressions, nodes and edges, as lodegraph.graph.from_tables does with DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.graph import Graph, from_tables
from lodegraph.operators import fixpoint, pattern

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NODES = """nodes AS (
SELECT 'r' || r_regionkey AS id, 'Project' AS label, r_name AS qualified_name, r_name AS name, NULL::VARCHAR AS path, NULL::BIGINT AS start_line, NULL::BIGINT AS end_line, NULL::BOOLEAN AS flow_covered FROM region
UNION ALL SELECT 'n' || n_nationkey, 'Package', r_name || '.' || n_name, n_name, r_name || '/' || n_name, NULL, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, 'Module', r_name || '.' || n_name || '.' || c_name, c_name, r_name || '/' || n_name || '/' || c_name || '.py', NULL, NULL, c_acctbal > 0 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, 'Class', r_name || '.' || n_name || '.' || s_name, s_name, r_name || '/' || n_name || '/' || s_name || '.ts', NULL, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'p' || p_partkey, 'Function', 'part.' || p_brand || '.f' || p_partkey, 'f' || p_partkey, 'part/' || p_brand || '.go', p_partkey * 10, p_partkey * 10 + p_size, NULL FROM part)"""
EDGES = """edges AS (
SELECT 'r' || n_regionkey AS src, 'CONTAINS_PACKAGE' AS rel_type, 'n' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'CONTAINS_MODULE', 'c' || c_custkey FROM customer
UNION ALL SELECT 'n' || s_nationkey, 'DEFINES', 's' || s_suppkey FROM supplier
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'CALLS', 'p' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'p' || l_partkey, 'REFERENCES', 's' || l_suppkey FROM lineitem)"""
# Small graphs over parts: a tree (parent is half the key) and a cyclic one with two successors each.
TREE = "tree AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0)"
RING = "ring AS (SELECT p_partkey AS src, (2 * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, (3 * p_partkey + 2) % (SELECT count(*) FROM part) FROM part)"
# Events of users in order: who is active after whom.
NEXT = "flow AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"


def query(sql: str | None, *parts: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            recursive = "RECURSIVE " if "RECURSIVE" in parts else ""
            with_ = [p for p in parts if p != "RECURSIVE"]
            SQL[f.__name__] = f"WITH {recursive}{', '.join(with_)} {sql}" if with_ else sql
        return f

    return register


def graph(spark: SparkSession, d: str) -> Graph:
    return from_tables(spark, d)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tree(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where("p_partkey > 0").selectExpr("p_partkey div 2 AS src", "p_partkey AS dst")


def ring(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select("p_partkey")
    n = part.count()
    return part.selectExpr("p_partkey AS src", f"(2 * p_partkey + 1) % {n} AS dst").union(part.selectExpr("p_partkey", f"(3 * p_partkey + 2) % {n}")).distinct()


def parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"))


# Scans, projection and predicates


@query("SELECT id, name FROM nodes WHERE label = 'Package'", NODES)
def s1_label_scan(spark, d):
    return graph(spark, d).labelled("Package").select("id", "name")


@query("SELECT src, dst, rel_type FROM edges WHERE rel_type IN ('CONTAINS_PACKAGE', 'DEFINES')", EDGES)
def s2_edge_scan(spark, d):
    return graph(spark, d).typed("CONTAINS_PACKAGE", "DEFINES").select("src", "dst", "rel_type")


@query("SELECT id, label, qualified_name, name, path, start_line, end_line, flow_covered FROM nodes", NODES)
def s3_export_nodes(spark, d):
    return graph(spark, d).nodes


@query("SELECT a.qualified_name AS from_qn, rel_type, b.qualified_name AS to_qn FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id", NODES, EDGES)
def s4_export_relationships(spark, d):
    g = graph(spark, d)
    a, b = pattern.renamed(g.nodes.select("id", "qualified_name"), "a"), pattern.renamed(g.nodes.select("id", "qualified_name"), "b")
    return g.edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).select(F.col("a_qualified_name").alias("from_qn"), "rel_type", F.col("b_qualified_name").alias("to_qn"))


@query("SELECT id AS node, qualified_name AS qn FROM nodes WHERE name = 'NATION_3'", NODES)
def g2_equality(spark, d):
    return graph(spark, d).nodes.where(F.col("name") == "NATION_3").select(F.col("id").alias("node"), F.col("qualified_name").alias("qn"))


@query("SELECT id, qualified_name FROM nodes WHERE starts_with(qualified_name, 'ASIA.NATION_2.')", NODES)
def g3_starts_with(spark, d):
    return graph(spark, d).nodes.where(F.col("qualified_name").startswith("ASIA.NATION_2.")).select("id", "qualified_name")


@query("SELECT id, path FROM nodes WHERE suffix(path, '7.py')", NODES)
def g4_ends_with(spark, d):
    return graph(spark, d).nodes.where(F.col("path").endswith("7.py")).select("id", "path")


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'r#00000001')", NODES)
def g5_contains_lower(spark, d):
    return graph(spark, d).nodes.where(F.lower("name").contains("r#00000001")).select("id", "name")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def g6_array_membership(spark, d):
    return t(spark, d, "part").where(F.array_contains(F.split("p_name", " "), "ring")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE len([x for x in string_split(p_name, ' ') if starts_with(x, 'r')]) > 0")
def g7_any_in_list(spark, d):
    return t(spark, d, "part").where(F.exists(F.split("p_name", " "), lambda x: x.startswith("r"))).select("p_partkey")


@query("SELECT id, name FROM nodes WHERE name IN ('NATION_1', 'NATION_9', 'ASIA', 'none')", NODES)
def g8_value_in_list(spark, d):
    return graph(spark, d).nodes.where(F.col("name").isin("NATION_1", "NATION_9", "ASIA", "none")).select("id", "name")


@query("SELECT id FROM nodes WHERE path IS NOT NULL AND NOT (start_line IS NULL OR end_line < 100)", NODES)
def g9_three_valued_logic(spark, d):
    return graph(spark, d).nodes.where(F.col("path").isNotNull() & ~(F.col("start_line").isNull() | (F.col("end_line") < 100))).select("id")


@query("SELECT id FROM nodes WHERE coalesce(flow_covered, FALSE) = FALSE AND label IN ('Module', 'Class')", NODES)
def g10_coalesce_flag(spark, d):
    return graph(spark, d).labelled("Module", "Class").where(~F.coalesce("flow_covered", F.lit(False))).select("id")


@query("SELECT count(*) AS n, count(DISTINCT label) AS n_labels FROM nodes WHERE label IN ('Function', 'Class')", NODES)
def g11_label_disjunction(spark, d):
    return graph(spark, d).labelled("Function", "Class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("n_labels"))


@query("SELECT label, count(path) > 0 AS has_path, count(start_line) > 0 AS has_start_line, count(flow_covered) > 0 AS has_flow_covered FROM nodes GROUP BY label", NODES)
def g12_keys_of_labels(spark, d):
    return graph(spark, d).nodes.groupBy("label").agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in ("path", "start_line", "flow_covered")])


@query("SELECT DISTINCT string_split(qualified_name, '.')[1] AS project FROM nodes", NODES)
def g13_head_of_split(spark, d):
    return graph(spark, d).nodes.select(F.split("qualified_name", r"\.")[0].alias("project")).distinct()


@query("SELECT DISTINCT a.label AS src, rel_type AS rel, b.label AS dst FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id", NODES, EDGES)
def g14_distinct_triples(spark, d):
    g = from_tables(spark, d, once=False)
    a, b = pattern.renamed(g.nodes.select("id", "label"), "a"), pattern.renamed(g.nodes.select("id", "label"), "b")
    return g.edges.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).select(F.col("a_label").alias("src"), F.col("rel_type").alias("rel"), F.col("b_label").alias("dst")).distinct()


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def g15_unwind(spark, d):
    return t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, qualified_name FROM nodes WHERE id IN ('c5', 'p17', 's3', 'zz') ORDER BY qualified_name", NODES)
def g16_nodes_by_id(spark, d):
    ids = spark.createDataFrame([("c5",), ("p17",), ("s3",), ("zz",)], "id string")
    return graph(spark, d).nodes.join(F.broadcast(ids), "id").select("id", "qualified_name").orderBy("qualified_name")


@query("SELECT dst AS other, rel_type FROM edges WHERE src = 'n3' UNION ALL SELECT src, rel_type FROM edges WHERE dst = 'n3'", EDGES)
def g17_edges_of_a_node(spark, d):
    e = graph(spark, d).edges
    return e.where("src = 'n3'").select(F.col("dst").alias("other"), "rel_type").union(e.where("dst = 'n3'").select("src", "rel_type"))


@query("SELECT f.qualified_name, m.qualified_name AS module_qn FROM nodes f JOIN nodes m ON m.label = 'Package' AND starts_with(f.qualified_name, m.qualified_name || '.') WHERE f.label = 'Class'", NODES)
def g18_owning_module_by_prefix(spark, d):
    """R29 as well: the dotted prefixes of a name are joined by equality, the longest one that is a module owns it."""
    g = graph(spark, d)
    name = F.split("qualified_name", r"\.")
    prefixes = g.labelled("Class").select("qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(name) - 1), lambda n: F.array_join(F.slice(name, 1, n), "."))).alias("prefix"))
    owner = prefixes.join(g.labelled("Package").select(F.col("qualified_name").alias("module_qn")), F.col("prefix") == F.col("module_qn"))
    return owner.groupBy("qualified_name").agg(F.max_by("module_qn", F.length("module_qn")).alias("module_qn"))


@query("SELECT b.qualified_name, b.path, a.name AS package FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type = 'DEFINES'", NODES, EDGES)
def g19_source_location(spark, d):
    g = graph(spark, d)
    return pattern.hop(g, pattern.renamed(g.labelled("Package"), "a"), "a", ["DEFINES"], g.labelled("Class"), "b").select(F.col("b_qualified_name").alias("qualified_name"), F.col("b_path").alias("path"), F.col("a_name").alias("package"))


@query("SELECT name FROM nodes WHERE label = 'Project' ORDER BY name", NODES)
def g20_list_projects(spark, d):
    return graph(spark, d).labelled("Project").select("name").orderBy("name")


@query("SELECT qualified_name FROM nodes WHERE suffix(qualified_name, '.f17') OR suffix(qualified_name, '.Customer#000000017') ORDER BY qualified_name", NODES)
def g22_suffix_lookup(spark, d):
    return graph(spark, d).nodes.where(F.substring_index("qualified_name", ".", -1).isin("f17", "Customer#000000017")).select("qualified_name").orderBy("qualified_name")


@query("SELECT qualified_name FROM nodes WHERE qualified_name = 'EUROPE.NATION_3' OR starts_with(qualified_name, 'EUROPE.NATION_3.')", NODES)
def g23_segment_prefix(spark, d):
    qn = F.col("qualified_name")
    return graph(spark, d).nodes.where((qn == "EUROPE.NATION_3") | qn.startswith("EUROPE.NATION_3.")).select("qualified_name")


# Joins


@query("SELECT a.name AS package, b.name AS module FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type = 'CONTAINS_MODULE'", NODES, EDGES)
def j1_single_hop(spark, d):
    g = graph(spark, d)
    return pattern.hop(g, pattern.renamed(g.nodes, "a"), "a", ["CONTAINS_MODULE"], g.nodes, "b").select(F.col("a_name").alias("package"), F.col("b_name").alias("module"))


@query("SELECT a.name AS project, c.name AS class FROM edges e JOIN nodes a ON e.src = a.id JOIN edges f ON f.src = e.dst AND f.rel_type = 'DEFINES' JOIN nodes c ON f.dst = c.id WHERE e.rel_type = 'CONTAINS_PACKAGE'", NODES, EDGES)
def j2_two_hops(spark, d):
    g = graph(spark, d)
    one = pattern.hop(g, pattern.renamed(g.labelled("Project"), "a"), "a", ["CONTAINS_PACKAGE"], g.labelled("Package"), "b").drop("rel_type")
    return pattern.hop(g, one, "b", ["DEFINES"], g.labelled("Class"), "c").select(F.col("a_name").alias("project"), F.col("c_name").alias("class"))


@query("SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE rel_type <> 'CALLS' UNION ALL SELECT dst FROM edges WHERE rel_type <> 'CALLS') GROUP BY id", EDGES)
def j3_undirected_hop(spark, d):
    e = graph(spark, d).edges.where("rel_type <> 'CALLS'")
    return fixpoint.both_ways(e).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.id, count(b.id) AS n_covered FROM nodes a LEFT JOIN (SELECT src, n.id FROM edges JOIN nodes n ON dst = n.id WHERE rel_type = 'CONTAINS_MODULE' AND flow_covered) b ON b.src = a.id WHERE a.label = 'Package' GROUP BY a.id", NODES, EDGES)
def j4_optional_hop(spark, d):
    g = graph(spark, d)
    return pattern.hop(g, pattern.renamed(g.labelled("Package"), "a"), "a", ["CONTAINS_MODULE"], g.nodes, "b", optional=True, where=F.col("b_flow_covered")).groupBy(F.col("a_id").alias("id")).agg(F.count("b_id").alias("n_covered"))


@query("SELECT id FROM nodes WHERE label = 'Function' AND id NOT IN (SELECT dst FROM edges WHERE rel_type = 'CALLS')", NODES, EDGES)
def j5_absent_edge_all(spark, d):
    g = graph(spark, d)
    return pattern.without(g, g.labelled("Function"), ["CALLS"], "in").select("id")


@query("SELECT id FROM nodes WHERE label = 'Function' AND id IN (SELECT dst FROM edges WHERE rel_type = 'CALLS')", NODES, EDGES)
def j6_existence(spark, d):
    g = graph(spark, d)
    return g.labelled("Function").join(g.typed("CALLS").select(F.col("dst").alias("id")), "id", "left_semi").select("id")


@query("SELECT id, min(depth) AS depth FROM r GROUP BY id", "RECURSIVE", TREE, "r AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN tree ON src = id WHERE depth < 4)")
def j7_bounded_path(spark, d):
    g = Graph(parts(spark, d), tree(spark, d).withColumn("rel_type", F.lit("INHERITS")))
    return pattern.path(g, spark.createDataFrame([(1,)], "id long"), ["INHERITS"], 0, 4)


@query("SELECT id, depth FROM r", "RECURSIVE", NODES, EDGES, "r AS (SELECT id, 0 AS depth FROM nodes WHERE label = 'Project' AND name = 'ASIA' UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = r.id AND rel_type IN ('CONTAINS_PACKAGE', 'CONTAINS_MODULE', 'DEFINES'))")
def j8_containment_closure(spark, d):
    g = graph(spark, d)
    return pattern.path(g, g.labelled("Project").where("name = 'ASIA'"), ["CONTAINS_PACKAGE", "CONTAINS_MODULE", "DEFINES"], 0, None)


@query("SELECT a.id AS a, b.id AS b FROM nodes a, nodes b WHERE a.label = 'Package' AND a.name = 'NATION_4' AND b.label = 'Class' AND b.name = 'Supplier#000000004'", NODES)
def j9_keyed_ends(spark, d):
    g = graph(spark, d)
    keys = spark.createDataFrame([("NATION_4", "Supplier#000000004")], "ka string, kb string")
    a, b = g.labelled("Package").select(F.col("id").alias("a"), F.col("name").alias("ka")), g.labelled("Class").select(F.col("id").alias("b"), F.col("name").alias("kb"))
    return F.broadcast(keys).join(a, "ka").join(b, "kb").select("a", "b")


SPANS = "spans AS (SELECT o_orderkey AS span, o_custkey AS file, epoch(o_orderdate)::BIGINT AS s, epoch(o_orderdate)::BIGINT + 86400 * (30 + o_orderkey % 400) AS e FROM orders), points AS (SELECT o_custkey AS file, l_orderkey, l_linenumber, l_partkey, epoch(l_shipdate)::BIGINT AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def spans_and_points(spark, d):
    orders, line = t(spark, d, "orders"), t(spark, d, "lineitem")
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    spans = orders.select(F.col("o_orderkey").alias("span"), F.col("o_custkey").alias("file"), seconds("o_orderdate").alias("s"), (seconds("o_orderdate") + 86400 * (30 + F.col("o_orderkey") % 400)).alias("e"))
    points = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file"), "l_orderkey", "l_partkey", seconds("l_shipdate").alias("at"))
    return spans, points


@query("SELECT span, count(*) AS n_points, sum(l_partkey)::BIGINT AS parts FROM (SELECT l_orderkey, l_partkey, max_by(span, (s, span)) AS span FROM (SELECT DISTINCT file, l_orderkey, l_partkey, pos FROM points) JOIN spans USING (file) WHERE s <= pos AND pos <= e GROUP BY l_orderkey, l_partkey, pos) GROUP BY span", SPANS)
def j10_innermost_span(spark, d):
    from lodegraph.operators.spans import innermost

    spans, points = spans_and_points(spark, d)
    return innermost(points.distinct(), spans).groupBy("span").agg(F.count(F.lit(1)).alias("n_points"), F.sum("l_partkey").alias("parts"))


@query("SELECT span, count(*) AS n_points FROM (SELECT l_orderkey, l_partkey, min_by(span, (e - s, span)) AS span FROM (SELECT DISTINCT file, l_orderkey, l_partkey, pos FROM points) JOIN spans USING (file) WHERE s <= pos AND pos <= e GROUP BY l_orderkey, l_partkey, pos) GROUP BY span", SPANS)
def j11_tightest_span(spark, d):
    from lodegraph.operators.spans import innermost

    spans, points = spans_and_points(spark, d)
    return innermost(points.distinct(), spans, tightest=True).groupBy("span").agg(F.count(F.lit(1)).alias("n_points"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def j13_first_by_rank(spark, d):
    """W1 too: the candidate that comes first by (abstract, distance, name)."""
    rank = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") == "P", "o_totalprice", "o_orderkey")
    return t(spark, d, "orders").withColumn("n", F.row_number().over(rank)).where("n = 1").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS ok, max(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS any_ok FROM orders) WHERE ok = any_ok")
def j14_prefer_else_all(spark, d):
    ok = F.col("o_orderstatus") == "F"
    return t(spark, d, "orders").withColumn("any_ok", F.max(ok).over(Window.partitionBy("o_custkey"))).where(ok == F.col("any_ok")).select("o_custkey", "o_orderkey")


@query("SELECT a.c_custkey AS child, b.s_suppkey AS parent FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND a.c_custkey % 100 = b.s_suppkey")
def j15_exact_location(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    return c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 100 == F.col("s_suppkey"))).select(F.col("c_custkey").alias("child"), F.col("s_suppkey").alias("parent"))


@query("SELECT p_name AS symbol, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def j16_partial_groups(spark, d):
    return t(spark, d, "part").groupBy(F.col("p_name").alias("symbol")).agg(F.size(F.collect_set("p_brand")).cast("long").alias("n")).where("n > 1")


# Aggregation, windows, top-k, sets


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label ORDER BY n DESC, label", NODES)
def a1_counts_by_label(spark, d):
    return graph(spark, d).nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query("SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type ORDER BY n DESC, rel_type", EDGES)
def a1_counts_by_type(spark, d):
    return graph(spark, d).edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type")


@query("SELECT count(*) AS n FROM nodes WHERE label = 'Module' AND starts_with(qualified_name, 'ASIA.')", NODES)
def a2_filtered_count(spark, d):
    return graph(spark, d).labelled("Module").where(F.col("qualified_name").startswith("ASIA.")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dst, count(DISTINCT src) AS n FROM edges WHERE rel_type = 'CALLS' GROUP BY dst HAVING count(DISTINCT src) >= 20", EDGES)
def a3_count_distinct_having(spark, d):
    return graph(spark, d).typed("CALLS").groupBy("dst").agg(F.countDistinct("src").alias("n")).where("n >= 20")


@query("SELECT count(*) > 0 AS shared FROM (SELECT dst FROM edges WHERE rel_type LIKE 'CONTAINS%' GROUP BY dst HAVING count(*) > 1)", EDGES)
def a4_any_shared_structure(spark, d):
    e = graph(spark, d).edges.where(F.col("rel_type").startswith("CONTAINS"))
    return e.groupBy("dst").count().where("count > 1").limit(1).agg((F.count(F.lit(1)) > 0).alias("shared"))


@query("SELECT dst, array_to_string(list_sort(list(DISTINCT string_split(qualified_name, '.')[1])), ',') AS projects FROM edges JOIN nodes ON src = id WHERE rel_type = 'CALLS' GROUP BY dst", NODES, EDGES)
def a5_collect_distinct(spark, d):
    g = graph(spark, d)
    project = g.nodes.select("id", F.split("qualified_name", r"\.")[0].alias("project"))
    return g.typed("CALLS").join(project, F.col("src") == F.col("id")).groupBy("dst").agg(F.array_join(F.sort_array(F.collect_set("project")), ",").alias("projects"))


@query("SELECT 'node' AS what, label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type UNION ALL SELECT 'node', '*', count(*) FROM nodes UNION ALL SELECT 'edge', '*', count(*) FROM edges", NODES, EDGES)
def a6_graph_summary(spark, d):
    g = graph(spark, d)
    per = lambda df, c, what: df.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return per(g.nodes.select(F.explode(F.array("label", F.lit("*"))).alias("l")), "l", "node").union(per(g.edges.select(F.explode(F.array("rel_type", F.lit("*"))).alias("l")), "l", "edge"))


TRACE = "trace AS (SELECT event_type AS callee, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS caller, user_id FROM events)"


@query("SELECT caller, callee, count(*) AS dynamic_call_count, count(DISTINCT user_id) AS dynamic_workload_count, array_to_string(list_sort(list(DISTINCT user_id::VARCHAR))[1:20], ',') AS workloads FROM trace WHERE caller IS NOT NULL GROUP BY caller, callee", TRACE)
def a7_edge_statistics(spark, d):
    from lodegraph.operators.trace import edge_statistics

    e = t(spark, d, "events")
    caller = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(caller.alias("caller"), F.col("event_type").alias("callee"), F.lit(1).cast("long").alias("count"), F.array(F.col("user_id").cast("string")).alias("workloads"), F.array().cast("array<string>").alias("receiver_types")).where("caller is not null")
    return edge_statistics(rows).select("caller", "callee", "dynamic_call_count", "dynamic_workload_count", F.array_join("dynamic_workloads", ",").alias("workloads"))


@query("SELECT regexp_extract(path, '[^.]*$') AS ext, count(*) AS modules, count(*) FILTER (flow_covered) AS flow_covered FROM nodes WHERE label IN ('Module', 'Class') GROUP BY 1", NODES)
def a8_coverage_by_language(spark, d):
    n = graph(spark, d).labelled("Module", "Class")
    return n.groupBy(F.substring_index("path", ".", -1).alias("ext")).agg(F.count(F.lit(1)).alias("modules"), F.count_if("flow_covered").alias("flow_covered"))


@query("SELECT lang AS category, count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM (SELECT lang, n_chars > 1500 AS p, quality = 1 AS e FROM documents JOIN labels USING (doc_id)) GROUP BY lang HAVING count(*) FILTER (p OR e) > 0")
def a9_precision_recall_counts(spark, d):
    from lodegraph.operators.scoring import score_sets

    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    key = lambda df: df.select(F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("key"))
    return score_sets(key(rows.where("n_chars > 1500")), key(rows.where("quality = 1"))).select("category", "tp", "fp", "fn")


@query("SELECT count(*) AS n, count(*) FILTER (x = 0) AS exact, count(*) FILTER (x <= 1) AS within_one, round(avg(x), 6) AS mean_delta, max(x) AS max_delta FROM (SELECT abs(l_linenumber - (l_orderkey % 7 + 1))::BIGINT AS x FROM lineitem)")
def a10_location_statistics(spark, d):
    from lodegraph.operators.scoring import location_statistics

    return location_statistics(t(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("found"), (F.col("l_orderkey") % 7 + 1).alias("expected")))


@query("SELECT label, count(*) AS missing FROM nodes WHERE (label IN ('Package', 'Module', 'Class', 'Function') AND (path IS NULL OR start_line IS NULL)) GROUP BY label", NODES)
def a11_missing_required(spark, d):
    n = graph(spark, d).labelled("Package", "Module", "Class", "Function")
    return n.groupBy("label").agg(F.count_if(F.col("path").isNull() | F.col("start_line").isNull()).alias("missing")).where("missing > 0")


@query("SELECT user_id, event_id, (SELECT max_by(f.event_type, (f.ts, f.event_id)) FROM events f WHERE f.user_id = e.user_id AND f.event_type <> 'view' AND (f.ts, f.event_id) < (e.ts, e.event_id)) AS above FROM events e")
def w3_nearest_ancestor(spark, d):
    above = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    name = F.when(F.col("event_type") != "view", F.col("event_type"))
    return t(spark, d, "events").select("user_id", "event_id", F.last(name, ignorenulls=True).over(above).alias("above"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER w AS n, min(CASE WHEN s > 2000 AND k > 1 THEN k END) OVER (PARTITION BY user_id) AS stop FROM (SELECT *, sum(length(props) * 20) OVER (PARTITION BY user_id ORDER BY event_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE stop IS NULL OR n < stop")
def w7_token_budget(spark, d):
    from lodegraph.operators.limits import within_budget

    rows = t(spark, d, "events").select("user_id", "event_id", (F.length("props") * 20).alias("tokens"))
    return within_budget(rows, "tokens", 2000, ["event_id"], ["user_id"]).select("user_id", "event_id")


@query("SELECT qualified_name FROM nodes ORDER BY qualified_name LIMIT 50", NODES)
def l1_order_limit(spark, d):
    return graph(spark, d).nodes.select("qualified_name").orderBy("qualified_name").limit(50)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 10")
def l5_top_candidates(spark, d):
    rank = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("n", F.row_number().over(rank)).where("n <= 10").select("o_custkey", "o_orderkey")


@query("SELECT src, dst FROM edges WHERE rel_type = 'CALLS' UNION SELECT dst, src FROM edges WHERE rel_type = 'REFERENCES'", EDGES)
def u1_union(spark, d):
    g = graph(spark, d)
    return g.typed("CALLS").select("src", "dst").union(g.typed("REFERENCES").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


SNAPSHOTS = "old AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 3), new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 5)"


def snapshots(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.where("id % 10 <> 3"), o.where("id % 10 <> 5").withColumn("o_orderstatus", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))


@query("SELECT coalesce(n.o_orderkey, p.o_orderkey) AS id, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old p FULL JOIN new n ON p.o_orderkey = n.o_orderkey WHERE p.o_orderkey IS NULL OR n.o_orderkey IS NULL OR p.o_orderstatus <> n.o_orderstatus", SNAPSHOTS)
def u2_snapshot_diff(spark, d):
    from lodegraph.operators.diff import diff_rows

    return diff_rows(*snapshots(spark, d), ["id"]).select("id", "change")


@query("SELECT p.o_orderkey AS id, 'o_orderstatus' AS field, p.o_orderstatus AS old, n.o_orderstatus AS new FROM old p JOIN new n ON p.o_orderkey = n.o_orderkey WHERE p.o_orderstatus <> n.o_orderstatus", SNAPSHOTS)
def u4_field_deltas(spark, d):
    from lodegraph.operators.diff import diff_rows

    changed = diff_rows(*snapshots(spark, d), ["id"]).where("change = 'changed'")
    return changed.select("id", F.explode("delta").alias("field", "v")).select("id", "field", F.col("v.old").alias("old"), F.col("v.new").alias("new"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount < 0.01)")
def u7_expected_minus_stored(spark, d):
    stored = t(spark, d, "lineitem").where("l_quantity >= 50 and l_discount < 0.01").select(F.col("l_suppkey").alias("s_suppkey"))
    return t(spark, d, "supplier").select("s_suppkey").join(stored, "s_suppkey", "left_anti")


# Recursion


@query("SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY id", "RECURSIVE", TREE, "r AS (SELECT 3::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN tree ON src = r.id)")
def r1_reachable(spark, d):
    """To the end, however deep: a round a level."""
    return fixpoint.closure(spark.createDataFrame([(3,)], "id long"), tree(spark, d))


@query("SELECT id, depth, array_to_string(path, '>') AS path FROM r WHERE depth > 0", "RECURSIVE", TREE, "r AS (SELECT 3::BIGINT AS id, 0 AS depth, [3::BIGINT] AS path UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM r JOIN tree ON src = r.id WHERE depth < 5)")
def r7_shortest_paths(spark, d):
    return fixpoint.shortest_paths(spark.createDataFrame([(3,)], "id long"), tree(spark, d), 5).select("id", "depth", F.array_join("path", ">").alias("path"))


@query("SELECT id, min(top) AS component FROM up GROUP BY id", "RECURSIVE", "up AS (SELECT p_partkey AS id, p_partkey AS top FROM part UNION ALL SELECT id, top // 2 FROM up WHERE top % 8 <> 0)")
def r26_weak_components(spark, d):
    """A forest: the tree over all parts without the edges above every eighth."""
    return fixpoint.components(parts(spark, d), tree(spark, d).where("dst % 8 <> 0"))


@query("SELECT id, count(*) FILTER (side = 'i') AS n_in, count(*) FILTER (side = 'o') AS n_out FROM (SELECT p_partkey AS id, NULL AS side FROM part UNION ALL SELECT src, 'o' FROM ring UNION ALL SELECT dst, 'i' FROM ring) GROUP BY id", RING)
def r26_degrees(spark, d):
    return fixpoint.degrees(parts(spark, d), ring(spark, d))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN 0 ELSE floor(log2(p_partkey) + 1e-12) + 1 END::BIGINT AS level FROM part")
def r26_topological_levels(spark, d):
    return fixpoint.topological_levels(parts(spark, d), tree(spark, d))


def _pagerank_sql() -> str:
    steps = ["r0 AS (SELECT p_partkey AS id, 1.0::DOUBLE AS rank FROM part)", "w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM ring)"]
    for i in range(10):
        steps.append(f"r{i + 1} AS (SELECT p.id, 0.15 + 0.85 * coalesce(sum(q.rank * w.w), 0) AS rank FROM r0 p LEFT JOIN w ON w.dst = p.id LEFT JOIN r{i} q ON q.id = w.src GROUP BY p.id)")
    return ", ".join(steps)


@query("SELECT id, round(rank, 6) AS rank FROM r10", RING, _pagerank_sql())
def r26_pagerank(spark, d):
    return fixpoint.pagerank(parts(spark, d), ring(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@query("SELECT DISTINCT a.id AS a, b.id AS b, greatest(len(a.p), len(b.p)) - (SELECT count(*) FROM range(1, 5) x(i) WHERE list_slice(a.p, 1, i) = list_slice(b.p, 1, i) AND i <= least(len(a.p), len(b.p))) - (starts_with(a.q, array_to_string(b.p[1:len(b.p) - 1], '.') || '.'))::INTEGER AS distance FROM (SELECT id, qualified_name AS q, string_split(qualified_name, '.') AS p FROM nodes WHERE label = 'Class') a JOIN (SELECT src AS id, dst, string_split(qualified_name, '.') AS p FROM edges JOIN nodes ON src = id WHERE label = 'Package') b ON b.dst = a.id", NODES, EDGES)
def r22_import_distance_edges(spark, d):
    from lodegraph.operators.resolve import import_distance

    g = graph(spark, d)
    a, b = g.labelled("Class").select(F.col("id").alias("a"), F.col("qualified_name").alias("qa")), g.labelled("Package").select(F.col("id").alias("b"), F.col("qualified_name").alias("qb"))
    pairs = g.edges.select(F.col("src").alias("b"), F.col("dst").alias("a")).distinct().join(a, "a").join(b, "b")
    return pairs.select("a", "b", import_distance(F.col("qa"), F.col("qb")).cast("long").alias("distance"))


@query("SELECT a.qualified_name AS from_qn, b.qualified_name AS to_qn FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type IN ('CALLS', 'IMPORTS', 'REFERENCES') AND string_split(a.qualified_name, '.')[2] <> string_split(b.qualified_name, '.')[2] AND len(string_split(a.qualified_name, '.')) >= 3 AND len(string_split(b.qualified_name, '.')) >= 3", NODES, EDGES)
def r32_cross_package_all(spark, d):
    from lodegraph.operators.resolve import cross_package

    g = graph(spark, d)
    qn = lambda x: g.nodes.select(F.col("id").alias(x), F.col("qualified_name").alias(f"{x}_qn"))
    return cross_package(g.typed("CALLS", "IMPORTS", "REFERENCES").join(qn("src"), "src").join(qn("dst"), "dst").select(F.col("src_qn").alias("from_qn"), F.col("dst_qn").alias("to_qn")))


# Writes and maintenance


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'added', 'new' FROM customer WHERE c_custkey % 50 = 0")
def m1_merge_nodes(spark, d):
    from lodegraph.operators.merge import merge_nodes

    c = t(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("segment"), F.lit(1).cast("long").alias("seq"))
    more = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.lit("added").alias("name"), F.lit("new").alias("segment"), F.lit(2).cast("long").alias("seq"))
    return merge_nodes(old, new.union(more), ["id"], "seq")


@query("SELECT DISTINCT src, rel_type, dst FROM (SELECT 'p' || l_partkey AS src, 'REFERENCES' AS rel_type, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'p' || (l_partkey + 1000000), 'REFERENCES', 's' || l_suppkey FROM lineitem) WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)", NODES)
def m2_merge_edges(spark, d):
    from lodegraph.operators.merge import merge_edges

    line = t(spark, d, "lineitem")
    row = lambda k: line.select(F.concat(F.lit("p"), (F.col("l_partkey") + k).cast("string")).alias("src"), F.lit("REFERENCES").alias("rel_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("kind"))
    return merge_edges(row(0).union(row(1000000)), graph(spark, d).nodes.select("id")).select("src", "rel_type", "dst")


@query("SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM r)", "RECURSIVE", NODES, EDGES, "r AS (SELECT 'r2' AS id UNION SELECT dst FROM r JOIN edges ON src = r.id AND rel_type IN ('CONTAINS_PACKAGE', 'CONTAINS_MODULE', 'DEFINES'))")
def m7_delete_subtree(spark, d):
    from lodegraph.operators.merge import delete_subtree

    g = graph(spark, d)
    return delete_subtree(g, g.nodes.where("id = 'r2'"), ["CONTAINS_PACKAGE", "CONTAINS_MODULE", "DEFINES"]).nodes.select("id")


@query("SELECT coalesce(p.o_orderkey, n.o_orderkey) AS path, CASE WHEN p.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'gone' WHEN p.o_orderstatus = n.o_orderstatus THEN 'same' ELSE 'changed' END AS state FROM old p FULL JOIN new n ON p.o_orderkey = n.o_orderkey", SNAPSHOTS)
def m12_changed_files(spark, d):
    from lodegraph.operators.merge import file_states

    old, new = snapshots(spark, d)
    row = lambda df: df.select(F.col("id").alias("path"), F.sha2(F.col("o_orderstatus"), 256).alias("hash"))
    return file_states(row(old), row(new))


@query("SELECT label, count(*) AS orphans FROM nodes WHERE label <> 'Project' AND id NOT IN (SELECT src FROM edges WHERE rel_type = 'DEFINES' UNION SELECT dst FROM edges WHERE rel_type = 'DEFINES') GROUP BY label", NODES, EDGES)
def m16_orphans(spark, d):
    from lodegraph.operators.audit import orphans

    g = graph(spark, d)
    return orphans(g.nodes, g.typed("DEFINES")).groupBy("label").agg(F.count(F.lit(1)).alias("orphans"))


# Links and search


@query("SELECT page_id, template FROM (SELECT page_id, [x for x in string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/') if x <> ''] AS s FROM pages), (VALUES ('/{lang}/{id}'), ('/en/{id}'), ('/{lang}/1')) v(template) WHERE len(s) = 2 AND (CASE template WHEN '/{lang}/{id}' THEN FALSE WHEN '/en/{id}' THEN s[1] = 'en' ELSE s[2] = '1' END)")
def e2_template_match(spark, d):
    from lodegraph.operators.links import match_templates

    templates = spark.createDataFrame([("/{lang}/{id}",), ("/en/{id}",), ("/{lang}/1",)], "template string")
    return match_templates(t(spark, d, "pages").select("page_id", "url"), templates).where("how = 'exact'").select("page_id", "template")


QUERY_VECTOR = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 5", QUERY_VECTOR)
def v1_vector_top_k(spark, d):
    from lodegraph.operators.search import top_k

    e = t(spark, d, "embeddings")
    return top_k(e.select("vec_id", "embedding"), e.where("vec_id = 7").first()["embedding"], 5).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS score FROM embeddings, q WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 10", QUERY_VECTOR)
def l4_scoped_top_k(spark, d):
    from lodegraph.operators.search import top_k

    e = t(spark, d, "embeddings")
    return top_k(e.where("label = 3").select("vec_id", "embedding"), e.where("vec_id = 7").first()["embedding"], 10).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(the|der|las?) ')) AS n FROM documents WHERE regexp_matches(text, '(the|der|las?) ')")
def v10_grep(spark, d):
    from lodegraph.operators.search import grep

    return grep(t(spark, d, "documents").select("doc_id", "text"), "(the|der|las?) ").select("doc_id", "n")


# More of the inventory


@query("SELECT b.id, b.qualified_name, a.qualified_name AS holder FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type = 'CONTAINS_MODULE' AND starts_with(a.qualified_name, 'ASIA') ORDER BY holder, b.id", NODES, EDGES)
def g21_rehydration(spark, d):
    g = graph(spark, d)
    rows = pattern.hop(g, pattern.renamed(g.labelled("Package").where(F.col("qualified_name").startswith("ASIA")), "a"), "a", ["CONTAINS_MODULE"], g.nodes, "b")
    return rows.select(F.col("b_id").alias("id"), F.col("b_qualified_name").alias("qualified_name"), F.col("a_qualified_name").alias("holder")).orderBy("holder", "id")


@query("SELECT name, count(*) AS n, min(qualified_name) AS first_qn FROM (SELECT regexp_extract(qualified_name, '[^.]*$') AS name, qualified_name FROM nodes) GROUP BY name HAVING count(*) >= 1", NODES)
def g24_simple_names(spark, d):
    """The index of simple names is a derived column."""
    return graph(spark, d).nodes.groupBy(F.substring_index("qualified_name", ".", -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("first_qn"))


@query("SELECT count(*) FILTER (start_line IS NOT NULL) AS with_span, count(*) FILTER (start_line IS NULL) AS structural FROM nodes", NODES)
def a12_structural_tier(spark, d):
    return graph(spark, d).nodes.agg(F.count("start_line").alias("with_span"), F.count_if(F.col("start_line").isNull()).alias("structural"))


@query("SELECT caller, callee, count(*) AS count FROM (SELECT event_type AS callee, user_id, ts, event_id, (SELECT max_by(f.event_type, (f.ts, f.event_id)) FROM events f WHERE f.user_id = e.user_id AND f.event_type <> 'error' AND (f.ts, f.event_id) < (e.ts, e.event_id)) AS caller FROM events e WHERE event_type <> 'error') WHERE caller IS NOT NULL GROUP BY caller, callee")
def a13_weighted_adjacency(spark, d):
    """T8's fold: the events of a user are a stack, errors are frames outside the project."""
    from lodegraph.operators.trace import weighted_edges

    e = t(spark, d, "events")
    depth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return weighted_edges(e.select(F.col("user_id").alias("sample_id"), depth.alias("depth"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"), F.lit(1).cast("long").alias("weight")))


@query("SELECT CASE WHEN l_quantity < 5 THEN 'outside_repo' WHEN l_quantity < 20 THEN 'unknown_path' ELSE 'no_match' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def a14_unresolved_by_reason(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy(F.when(q < 5, "outside_repo").when(q < 20, "unknown_path").otherwise("no_match").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT o_custkey AS q, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), x AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F') SELECT count(k) AS hits, count(*) AS expected FROM x LEFT JOIN (SELECT * FROM r WHERE k <= 3) USING (q, item)")
def a15_recall_at_k(spark, d):
    from lodegraph.operators.scoring import recall_at_k

    o = t(spark, d, "orders")
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("position"))
    return recall_at_k(ranked, ranked.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item")), "item", "left_semi"), 3).select("hits", "expected")


@query("SELECT rel_type, count(*) AS attempted, count(*) FILTER (l_partkey < (SELECT count(*) FROM part)) AS created FROM (SELECT l_partkey FROM lineitem UNION ALL SELECT l_partkey + (SELECT count(*) FROM part) FROM lineitem), (SELECT 'REFERENCES' AS rel_type) GROUP BY rel_type")
def a16_attempted_and_created(spark, d):
    from lodegraph.operators.merge import attempted_and_created

    line, n = t(spark, d, "lineitem"), t(spark, d, "part").count()
    row = lambda k: line.select(F.concat(F.lit("p"), (F.col("l_partkey") + k).cast("string")).alias("src"), F.lit("REFERENCES").alias("rel_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return attempted_and_created(row(0).union(row(n)), graph(spark, d).nodes.select("id"), 2 * line.count())


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def w6_first_claimant(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("SELECT qualified_name FROM (SELECT qualified_name, sum(length(qualified_name)) OVER (ORDER BY qualified_name) AS s, row_number() OVER (ORDER BY qualified_name) AS n FROM (SELECT qualified_name FROM nodes ORDER BY qualified_name LIMIT 500)) WHERE s <= 4000 OR n = 1", NODES)
def l2_row_and_token_caps(spark, d):
    """Rows are capped first, then the budget cuts."""
    from lodegraph.operators.limits import within_budget

    top = graph(spark, d).nodes.select("qualified_name").orderBy("qualified_name").limit(500)
    return within_budget(top.select("qualified_name", F.length("qualified_name").alias("tokens"), F.lit(0).alias("all")), "tokens", 4000, ["qualified_name"], ["all"]).select("qualified_name")


@query("SELECT 'EDGE' AS rel_type, count(*) FILTER (o_orderkey NOT IN (SELECT o_orderkey FROM old)) AS added, (SELECT count(*) FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)) AS removed FROM new", SNAPSHOTS)
def u3_edge_differences(spark, d):
    old, new = snapshots(spark, d)
    rows = lambda df, other: df.select("id").join(other.select("id"), "id", "left_anti")
    both = rows(new, old).select(F.lit(1).alias("a"), F.lit(0).alias("r")).union(rows(old, new).select(F.lit(0), F.lit(1)))
    return both.groupBy(F.lit("EDGE").alias("rel_type")).agg(F.sum("a").alias("added"), F.sum("r").alias("removed"))


@query("SELECT c_custkey::VARCHAR AS key, c_acctbal > 0 AS old, c_acctbal > 100 AS new FROM customer WHERE (c_acctbal > 0) <> (c_acctbal > 100)")
def u5_coverage_flips(spark, d):
    from lodegraph.operators.diff import coverage_flips

    c = t(spark, d, "customer")
    side = lambda n: c.select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_acctbal") > n).alias("flow_covered"))
    return coverage_flips(side(0), side(100))


@query("SELECT count(*) AS n, count(*) FILTER (id IN (SELECT dst FROM r)) AS live, count(*) FILTER (id NOT IN (SELECT dst FROM r)) AS dead FROM nodes WHERE label IN ('Function', 'Class')", "RECURSIVE", NODES, EDGES, "r AS (SELECT dst FROM edges WHERE rel_type = 'CALLS' AND src LIKE '%77' UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.dst AND e.rel_type IN ('CALLS', 'REFERENCES'))")
def u8_candidates_minus_live(spark, d):
    g = graph(spark, d)
    roots = g.typed("CALLS").where(F.col("src").endswith("77")).select(F.col("dst").alias("id"))
    live = fixpoint.closure(roots, g.typed("CALLS", "REFERENCES")).select("id").withColumn("live", F.lit(True))
    return g.labelled("Function", "Class").join(live, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("live").alias("live"), F.count_if(F.col("live").isNull()).alias("dead"))


@query("SELECT id, min(depth)::INTEGER AS depth FROM r WHERE depth > 0 AND id <> 11 GROUP BY id", "RECURSIVE", RING, "r AS (SELECT 11::BIGINT AS id, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN ring ON dst = r.id WHERE depth < 3)")
def r8_reverse_bounded_search(spark, d):
    return fixpoint.shortest_paths(spark.createDataFrame([(11,)], "id long"), fixpoint.reverse(ring(spark, d)), 3).select("id", "depth")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def m9_orphan_externals(spark, d):
    from lodegraph.operators.merge import delete_orphan_externals

    c, o = t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 450000")
    nodes = c.select(F.col("c_custkey").alias("id"), F.lit("ExternalModule").alias("label"))
    left = delete_orphan_externals(Graph(nodes, o.select((-1 - F.col("o_orderkey")).alias("src"), F.lit("IMPORTS").alias("rel_type"), F.col("o_custkey").alias("dst")))).nodes
    return nodes.select("id").join(left, "id", "left_anti")


@query("SELECT DISTINCT a.path FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type = 'CALLS' AND b.path = 'part/Brand#3.go' AND a.path <> b.path", NODES, EDGES)
def m13_affected_callers(spark, d):
    from lodegraph.operators.merge import affected_callers

    return affected_callers(graph(spark, d), spark.createDataFrame([("part/Brand#3.go",)], "path string"))


@query("SELECT DISTINCT a.label AS src_label, rel_type, b.label AS dst_label FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE (a.label, rel_type, b.label) NOT IN (SELECT * FROM (VALUES ('Project', 'CONTAINS_PACKAGE', 'Package'), ('Package', 'CONTAINS_MODULE', 'Module'), ('Module', 'CALLS', 'Function'), ('Function', 'REFERENCES', 'Class')))", NODES, EDGES)
def m16_undocumented_triples(spark, d):
    from lodegraph.operators.audit import undocumented_triples

    g = from_tables(spark, d, once=False)
    return undocumented_triples(g.nodes, g.edges)


@query("SELECT key, CASE WHEN key IN (SELECT p_brand FROM part) THEN key ELSE regexp_replace(key, '/[^/]*$', '') END AS target FROM (SELECT DISTINCT p_brand || '/dev' AS key FROM part UNION SELECT DISTINCT p_brand FROM part)")
def e10_dispatch_keys(spark, d):
    from lodegraph.operators.links import link_dispatch_keys

    brand = t(spark, d, "part").select(F.col("p_brand").alias("key")).distinct()
    return link_dispatch_keys(brand.union(brand.select(F.concat("key", F.lit("/dev")))), brand)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def v4_embedding_cache(spark, d):
    from lodegraph.operators.search import cached

    e = t(spark, d, "embeddings").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    cache = e.where("vec_id % 5 <> 0").select(F.sha2("text", 256).alias("hash"), "embedding")
    return cached(e.select("vec_id", "label", "text"), cache).where("embedding is not null").select("vec_id", "label")


from lodegraph.plans import core  # noqa: E402,F401  more of them
