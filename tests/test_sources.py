"""Sources, streams and the query guard."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodegraph.graph import from_tables
from lodegraph.plans import guard
from lodegraph.sources import exports, files, traces
from lodegraph.streaming import watch


def test_document(spark, tmp_path):
    nodes = [(40, "Class", {"qualified_name": "shop.cart.Cart", "name": "Cart"}), (41, "Method", {"qualified_name": "shop.cart.Cart.total", "name": "total"}), (42, "File", {"name": "cart.py"})]
    edges = [(40, 41, "DEFINES_METHOD", {}), (41, 41, "CALLS", {"line": 77})]
    doc = {"nodes": [{"node_id": i, "labels": [x], "properties": p} for i, x, p in nodes], "relationships": [{"from_id": a, "to_id": b, "type": t, "properties": p} for a, b, t, p in edges], "metadata": {"total_nodes": 3, "total_relationships": 2}}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = exports.read_document(spark, str(tmp_path / "g.json"))
    assert {(r["id"], r["label"], r["qualified_name"]) for r in g.nodes.collect()} == {(40, "Class", "shop.cart.Cart"), (41, "Method", "shop.cart.Cart.total"), (42, "File", None)}
    assert [exports.edges_of(g, 41, x).count() for x in ("in", "out", "both")] == [2, 1, 3]


def test_snapshot(spark, tmp_path, sf_dir):
    g = from_tables(spark, sf_dir)
    small = type(g)(g.nodes.where("label <> 'Function'"), g.edges.where("rel_type <> 'CALLS'"))
    path = str(tmp_path / "snap")
    manifest = exports.write_snapshot(small, path, "v1")
    assert manifest["nodes"] == small.nodes.count() and exports.read_manifest(spark, path) == manifest
    assert exports.verify_snapshot(spark, path) == []
    again = exports.write_snapshot(type(g)(small.nodes.repartition(7), small.edges), str(tmp_path / "two"), "v1")
    assert again == manifest
    small.nodes.limit(1).write.mode("append").partitionBy("label").parquet(f"{path}/nodes")
    assert exports.verify_snapshot(spark, path) == ["nodes", "nodes_hash"]
    kept = exports.capture(small, labels_off=["Class"])
    assert kept.edges.where("rel_type = 'DEFINES'").count() == 0 < kept.edges.count()


def test_source_lines(spark):
    m = spark.createDataFrame([("a", "1\n2\n3")], "path string, text string")
    s = spark.createDataFrame([("a", 2, 3), ("a", 2, 9), ("a", 5, 6)], "path string, start_line long, end_line long")
    assert [r["source"] for r in exports.source_lines(m, s).orderBy("end_line").collect()] == ["2\n3", None, "2\n3"]
    assert [r["source"] for r in exports.source_lines(m, s, clamp=False).orderBy("end_line").collect()] == ["2\n3", None, None]


def test_traces(spark, tmp_path):
    head = {"kind": "header", "version": 1, "language": "python", "repo_root": "/r", "tracer": "t"}
    call = {"kind": "call", "caller": {"path": "a", "qualname": "f", "line": 0}, "callee": {"path": "b", "qualname": "g", "line": 2}, "count": 3, "workloads": ["w"], "receiver_types": []}
    p = tmp_path / "t.jsonl"
    p.write_text("\n".join(map(json.dumps, [head, call])))
    header, rows = traces.read_trace(spark, str(p))
    assert header["sampled"] is False and [(r["caller"]["line"], r["count"], r["workloads"]) for r in rows.collect()] == [(0, 3, ["w"])]
    traces.write_trace(rows, str(tmp_path / "out"), "python", "/r", "t", True)
    header, again = traces.read_trace(spark, str(tmp_path / "out"))
    assert header["sampled"] and again.collect() == rows.collect()
    for bad in ({**call, "count": True}, {**call, "count": 0}, {**call, "caller": {"path": "a", "line": 1}}):
        p.write_text("\n".join(map(json.dumps, [head, bad])))
        with pytest.raises(Exception, match="malformed"):
            traces.read_trace(spark, str(p))[1].collect()
    p.write_text(json.dumps(call))
    with pytest.raises(ValueError, match="header"):
        traces.read_trace(spark, str(p))


def test_profiles(spark):
    doc = {"shared": {"frames": [{"name": "a", "file": "x", "line": 1}, {"name": "b"}]}, "profiles": [{"type": "sampled", "samples": [[0, 1], [0]], "weights": [2, 0]}, {"type": "evented", "startValue": 0, "events": [{"type": "O", "frame": 0, "at": 0}, {"type": "O", "frame": 1, "at": 3}, {"type": "C", "frame": 1, "at": 4}, {"type": "C", "frame": 0, "at": 9}]}]}
    got = traces.speedscope_samples(spark.createDataFrame([("p", json.dumps(doc))], "path string, text string"))
    assert sorted((r["sample_id"], r["depth"], r["name"], r["weight"]) for r in got.collect()) == [(0, 0, "a", 2.0), (0, 1, "b", 2.0), (1, 0, "a", 1.0), (2, 0, "a", 3.0), (3, 0, "a", 1.0), (3, 1, "b", 1.0), (4, 0, "a", 5.0)]
    frame = lambda f, u: {"functionName": f, "url": u, "lineNumber": 0}
    doc = {"nodes": [{"id": 1, "callFrame": frame("(root)", ""), "children": [2]}, {"id": 2, "callFrame": frame("a", "file:///r/a.js"), "children": [3]}, {"id": 3, "callFrame": frame("lib", "/x/l.js"), "children": [4], "hitCount": 1}, {"id": 4, "callFrame": frame("b", "file:///r/b.js"), "hitCount": 5}]}
    got = traces.cpuprofile_edges(spark.createDataFrame([("p", json.dumps(doc))], "path string, text string"), "/r")
    assert [(r["caller"], r["callee"], r["callee_line"], r["count"]) for r in got.collect()] == [("a", "b", 1, 5)]


def test_files(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/a.py").write_text("from pkg.b import help as h\n@dec(1)\nclass A(Base):\n    def f(self):\n        self.g()\n        h()\n    def g(self): A()\nclass Base: pass\n")
    (tmp_path / "pkg/b.py").write_text("def help():\n    def inner(): pass\n    inner()\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("x = 1")
    tree = files.read_tree(spark, str(tmp_path))
    kept = files.eligible(tree)
    assert {r["path"] for r in kept.collect()} == {"pkg/__init__.py", "pkg/a.py", "pkg/b.py", "bad.py"}
    assert files.eligible(tree, unignore=("node_modules",)).count() == 5
    folders, inside = files.structure(kept, "p")
    assert [tuple(r) for r in folders.collect()] == [("pkg", "Package", "pkg", "p.pkg")]
    assert ("", "pkg", "CONTAINS_PACKAGE") in {tuple(r) for r in inside.collect()} and inside.count() == 5
    nodes, edges = files.python_graph(files.python_facts(kept, "p"), "p")
    assert {(r["label"], r["qualified_name"]) for r in nodes.collect()} == {("Module", "p.pkg"), ("Module", "p.pkg.a"), ("Module", "p.pkg.b"), ("Module", "p.bad"), ("Class", "p.pkg.a.A"), ("Class", "p.pkg.a.Base"), ("Method", "p.pkg.a.A.f"), ("Method", "p.pkg.a.A.g"), ("Function", "p.pkg.b.help"), ("Function", "p.pkg.b.help.inner")}
    got = {tuple(r) for r in edges.collect()}
    assert {("p.pkg.a.A.f", "CALLS", "p.pkg.a.A.g"), ("p.pkg.a.A.f", "CALLS", "p.pkg.b.help"), ("p.pkg.a.A.g", "INSTANTIATES", "p.pkg.a.A"), ("p.pkg.a.A", "INHERITS", "p.pkg.a.Base"), ("p.pkg.b.help", "CALLS", "p.pkg.b.help.inner"), ("p.pkg.a.A", "DEFINES_METHOD", "p.pkg.a.A.f")} <= got


MANIFESTS = {
    "pyproject.toml": ('[project]\ndependencies = ["a>=1", "b[x]"]\n[tool.poetry.dependencies]\npython = "3"\nc = {version = "2"}', [("a", ">=1"), ("b", ""), ("c", "2")]),
    "x/requirements-dev.txt": ("# no\n-r other\nd==1 # why\n", [("d", "==1")]),
    "package.json": ('{"dependencies": {"e": "^1"}, "devDependencies": {"f": "2"}}', [("e", "^1"), ("f", "2")]),
    "Cargo.toml": ('[dependencies]\ng = "1"\nh = {version = "2"}', [("g", "1"), ("h", "2")]),
    "go.mod": ("module m\nrequire a.b/c v1.2.3\nrequire (\n\td.e/f v0.1.0 // indirect\n)", [("a.b/c", "v1.2.3"), ("d.e/f", "v0.1.0")]),
    "Gemfile": ("gem 'i', '~> 1'\ngem \"j\"", [("i", "~> 1"), ("j", "")]),
    "pubspec.yaml": ("dependencies:\n  k: ^1\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  l: any\n", [("k", "^1"), ("flutter", ""), ("l", "any")]),
    "A.csproj": ('<Project><ItemGroup><PackageReference Include="M" Version="3"/></ItemGroup></Project>', [("M", "3")]),
    "composer.json": ("{broken", []),
}


def test_manifests(spark):
    for path, (text, want) in MANIFESTS.items():
        assert files.parse_manifest(path, text) == want, path
    assert files.dependencies(spark.createDataFrame([(p, t) for p, (t, _) in MANIFESTS.items()], "path string, text string")).count() == sum(len(w) for _, w in MANIFESTS.values())


def test_bursts(spark, tmp_path):
    rows = [("a", "modified", "2024-01-01 00:00:00"), ("a", "deleted", "2024-01-01 00:00:03"), ("a", "created", "2024-01-01 00:00:20"), ("b", "modified", "2024-01-01 00:00:01")]
    frame = spark.createDataFrame(rows, "path string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r["path"], r["kind"], r["n_events"]) for r in watch.debounced(frame).collect()}
    assert got == {("a", "deleted", 2), ("a", "created", 1), ("b", "modified", 1)}
    busy = [("c", "modified", f"2024-01-01 00:00:{s:02}") for s in range(0, 60, 3)]
    spark.createDataFrame([*busy, *rows, ("z", "end", "2024-01-02 00:00:00")], "path string, kind string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, kind string, ts string").json(str(tmp_path / "in"))
    out = []
    q = watch.apply_in_order(watch.bounded(stream), lambda df, n: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    q.stop()
    assert {(p, k, n) for p, k, n, _ in out if p != "z"} >= {("a", "deleted", 2), ("c", "modified", 10)}
    assert max(n for p, _, n, _ in out if p == "c") == 10


def test_guard():
    for good in ("MATCH (n) RETURN n.name AS offset", "MATCH (a)-[:CALLS*1..3]->(b) RETURN b.x", "MATCH (a)-[*3]->(b) RETURN 'DELETE'", "CALL pagerank.get() YIELD rank RETURN rank"):
        guard.check(good)
    for bad in ("MATCH (n) DELETE n", "match (n) set n.x = 1", "MATCH (a)-[*]->(b) RETURN b", "MATCH (a)-[:T*1..]->(b) RETURN b", "CALL shell.run('x')"):
        with pytest.raises(ValueError):
            guard.check(bad)
