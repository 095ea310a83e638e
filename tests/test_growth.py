"""What a join broadcasts and what a task holds doesn't grow with the input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph import storage
from lodegraph.graph import from_tables
from lodegraph.operators import fixpoint, flow, merge, overrides, search
from lodegraph.plans import catalog


@pytest.fixture
def broadcasts(monkeypatch):
    """The joins that broadcast, of the tables that loops write and of those given to it, though no table counts as short."""
    found = []

    def planned(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found.extend(x.strip() for x in plan.split("\n") if "BroadcastExchange" in x)
        return found

    def recorded(df):
        planned(df)
        return storage.cut(df)

    monkeypatch.setattr(storage, "FEW", -1, raising=False)
    for module in (fixpoint, flow):
        monkeypatch.setattr(module, "cut", recorded)
    return planned


def half(spark, n):
    """A tree: the parent is half the key."""
    return spark.range(1, n).selectExpr("id div 2 AS src", "id AS dst")


def test_flow_verdicts_broadcast_nothing_that_grows(spark, broadcasts):
    pairs = spark.range(200).selectExpr("explode(array(1L, 3L, 777L)) AS source", "id AS sink")
    got = flow.verdicts(pairs, half(spark, 200).selectExpr("src AS source", "dst AS target"), spark.createDataFrame([("p",)], "path string"))
    assert broadcasts(got) == []

    def steps(a, b):
        return next((k for k in range(1, 9) if b >> k == a), None)

    want = {(a, b, "FOUND" if steps(a, b) else "UNKNOWN", steps(a, b)) for a in (1, 3, 777) for b in range(200)}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_closures_broadcast_nothing_that_grows(spark, broadcasts):
    start = spark.createDataFrame([(3,)], "id long")
    far = fixpoint.closure(start, half(spark, 200))
    paths = fixpoint.shortest_paths(start, half(spark, 200))
    assert broadcasts(far) == broadcasts(paths) == []
    want = {(b, k) for b in range(200) for k in range(8) if b >> k == 3}
    assert {tuple(r) for r in far.collect()} == want
    assert {(r["id"], r["depth"]) for r in paths.collect()} == want - {(3, 0)}


def test_pagerank_broadcasts_nothing_that_grows(spark, broadcasts):
    n = 60
    edges = {(i, (2 * i + 1) % n) for i in range(n)} | {(i, (3 * i + 2) % n) for i in range(n)}
    nodes, links = spark.range(n), spark.createDataFrame(sorted(edges), "src long, dst long")
    got, ends = fixpoint.pagerank(nodes, links), fixpoint.degrees(nodes, links)
    assert broadcasts(got) == broadcasts(ends) == []
    out = {i: [b for a, b in edges if a == i] for i in range(n)}
    rank = dict.fromkeys(range(n), 1.0)
    for _ in range(10):
        rank = {i: 0.15 + 0.85 * sum(rank[a] / len(out[a]) for a in out if i in out[a]) for i in rank}
    assert {r["id"]: r["rank"] for r in got.collect()} == pytest.approx(rank)
    assert {tuple(r) for r in ends.collect()} == {(i, sum(i in b for b in out.values()), len(out[i])) for i in range(n)}


def test_levels_and_components_broadcast_nothing_that_grows(spark, broadcasts):
    nodes = spark.range(100)
    levels = fixpoint.topological_levels(nodes, half(spark, 100))
    weak = fixpoint.components(nodes, half(spark, 100).where("dst % 8 <> 0"))
    strong = fixpoint.strongly_connected(spark.range(6), spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (4, 2)], "src long, dst long"))
    assert broadcasts(levels) == broadcasts(weak) == broadcasts(strong) == []
    assert {tuple(r) for r in levels.collect()} == {(k, k.bit_length()) for k in range(100)}
    top = lambda k: k if k % 8 == 0 else top(k // 2)
    assert {tuple(r) for r in weak.collect()} == {(k, top(k)) for k in range(100)}
    assert {tuple(r) for r in strong.collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)}


def test_one_name_of_a_protocol_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(overrides, "BLOCK", 8, raising=False)
    monkeypatch.setattr(overrides, "PAIRS", 256, raising=False)
    protocols = spark.range(60).selectExpr("concat('p', id) AS class")
    real = spark.range(50).selectExpr("concat('c', id) AS class", "'m' AS leaf", "concat('c', id, '.m') AS member")
    members = real.union(protocols.selectExpr("class", "'m'", "concat(class, '.m')")).union(spark.createDataFrame([("c", "n", "c.n")], real.schema))
    calls = protocols.withColumn("name", F.lit("m")).union(spark.createDataFrame([("p1", "n"), ("c1", "m"), ("p2", "x")], "class string, name string"))
    got = overrides.protocol_targets(calls, protocols, members).withColumn("task", F.spark_partition_id()).collect()
    want = [(f"p{p}", "m", f"c{c}.m") for p in range(60) for c in range(50)] + [("p1", "n", "c.n")]
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert len({r["task"] for r in got}) >= 8


def held(df):
    """Rows of each task that has some."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]


def test_edges_of_the_tables_are_dealt_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 200, raising=False)
    g = from_tables(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for kind in ("CALLS", "REFERENCES"):
        assert max(held(g.typed(kind))) < 2 * 200 < n // 8
    assert g.edges.count() <= g.rows
    assert g.edges.distinct().count() == g.edges.count() < from_tables(spark, sf_dir, once=False).edges.count()


def test_upkeep_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS", 50, raising=False)
    n = 2000
    nodes = spark.range(n).selectExpr("concat('p', id) AS id", "if(id % 2 = 0, 'Module', 'Function') AS label", "'q' AS qualified_name", "id AS start_line", "id AS end_line", "'f' AS path")
    batch = spark.range(n).selectExpr("concat('p', id) AS src", "'R' AS rel_type", "concat('p', id + 1) AS dst", "cast(null as string) AS via", "'k' AS kind")
    edges = batch.select("src", "rel_type", "dst")
    for got, rows in ((merge.merge_edges(batch.union(batch), nodes, 2 * n), n - 1), (merge.relink(edges, "R", nodes.where("label = 'Module'").select("id"), edges.limit(0), n), n // 2), (search.embedding_candidates(nodes, edges, n), n // 2)):
        assert got.count() == rows
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert tuple(merge.attempted_and_created(batch, nodes, n).first()) == ("R", n, n - 1)


def test_triples_shuffle_no_edges_to_drop_repeated_ones(spark, sf_dir):
    for name in ("g14_distinct_triples", "m16_undocumented_triples"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(o_custkey" not in plan and "hashpartitioning(l_partkey" not in plan
