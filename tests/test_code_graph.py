"""Code-graph operators on small literal graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.graph import Graph
from lodegraph.operators import audit, crash, deadcode, diff, fixpoint, flow, limits, links, merge, resolve, scoring, search, trace

NODE = "label string, qualified_name string, name string, path string, decorators array<string>, is_exported boolean, overrides_external boolean, start_line long, end_line long, rust_cfg_test_mods array<string>, rust_ungated_mods array<string>"
EDGE = "src_label string, src string, rel_type string, dst_label string, dst string"


def node(label, qn, path="m.py", decorators=(), exported=None, external=None, start=None, end=None, gated=None, ungated=None):
    return (label, qn, qn.rsplit(".", 1)[-1], path, list(decorators) if decorators is not None else None, exported, external, start, end, gated, ungated)


F_, M_, C_, MOD = "Function", "Method", "Class", "Module"
CASES = {
    "orphan": ([node(MOD, "p.m"), node(F_, "p.m.main"), node(F_, "p.m.helper"), node(F_, "p.m.orphan")], [(MOD, "p.m", "CALLS", F_, "p.m.main"), (F_, "p.m.main", "CALLS", F_, "p.m.helper")], {}, {"p.m.orphan"}),
    "orphan chain": ([node(F_, "p.m.a"), node(F_, "p.m.b")], [(F_, "p.m.a", "CALLS", F_, "p.m.b")], {}, {"p.m.a", "p.m.b"}),
    "decorated": ([node(F_, "p.m.a", decorators=["@app.route('/x')"]), node(F_, "p.m.b", decorators=["@lru_cache"]), node(F_, "p.m.c", decorators=None)], [], {}, {"p.m.b", "p.m.c"}),
    "dunder and exported": ([node(M_, "p.m.C.__iter__"), node(F_, "p.m.__f__"), node(F_, "p.m.e", exported=True), node(M_, "p.m.C.o", external=True), node(M_, "p.m.C._missing_")], [], {}, {"p.m.__f__"}),
    "override of a live method": ([node(MOD, "p.m"), node(M_, "p.m.A.f"), node(M_, "p.m.B.f"), node(F_, "p.m.g"), node(M_, "p.m.C.h"), node(M_, "p.m.D.h")], [(MOD, "p.m", "CALLS", M_, "p.m.A.f"), (M_, "p.m.B.f", "OVERRIDES", M_, "p.m.A.f"), (M_, "p.m.B.f", "CALLS", F_, "p.m.g"), (M_, "p.m.D.h", "OVERRIDES", M_, "p.m.C.h")], {}, {"p.m.C.h", "p.m.D.h"}),
    "closures": ([node(MOD, "p.m"), node(F_, "p.m.live"), node(F_, "p.m.live.in", decorators=["@x"]), node(F_, "p.m.k"), node(F_, "p.m.dead"), node(F_, "p.m.dead.in", decorators=["@x"]), node(F_, "p.m.live.plain")], [(MOD, "p.m", "CALLS", F_, "p.m.live"), (F_, "p.m.live", "DEFINES", F_, "p.m.live.in"), (F_, "p.m.live", "DEFINES", F_, "p.m.live.plain"), (F_, "p.m.live.in", "CALLS", F_, "p.m.k"), (F_, "p.m.dead", "DEFINES", F_, "p.m.dead.in")], {}, {"p.m.dead", "p.m.dead.in", "p.m.live.plain"}),
    "protocol": ([node(M_, "p.m.P.f"), node(M_, "p.m.Q.f")], [(C_, "p.m.P", "INHERITS", "ExternalModule", "typing.Protocol"), (C_, "p.m.P", "DEFINES_METHOD", M_, "p.m.P.f"), (C_, "p.m.Q", "DEFINES_METHOD", M_, "p.m.Q.f")], {}, {"p.m.Q.f"}),
    "factory class": ([node(MOD, "p.m"), node(F_, "p.m.make"), node(C_, "p.m.make.K"), node(M_, "p.m.make.K.f"), node(F_, "p.m.u"), node(F_, "p.m.idle"), node(M_, "p.m.idle.K.f")], [(MOD, "p.m", "CALLS", F_, "p.m.make"), (F_, "p.m.make", "DEFINES", C_, "p.m.make.K"), (C_, "p.m.make.K", "DEFINES_METHOD", M_, "p.m.make.K.f"), (M_, "p.m.make.K.f", "CALLS", F_, "p.m.u"), (F_, "p.m.idle", "DEFINES", C_, "p.m.idle.K"), (C_, "p.m.idle.K", "DEFINES_METHOD", M_, "p.m.idle.K.f")], {}, {"p.m.idle", "p.m.idle.K.f"}),
    "tests excluded": ([node(MOD, "p.tests.t", "tests/t.py"), node(F_, "p.tests.t.test", "tests/t.py"), node(F_, "p.m.used"), node(F_, "p.m.contest", "contests/x.py")], [(MOD, "p.tests.t", "CALLS", F_, "p.m.used")], {}, {"p.m.used", "p.m.contest"}),
    "tests included": ([node(MOD, "p.tests.t", "tests/t.py"), node(F_, "p.tests.t.test", "tests/t.py"), node(F_, "p.m.used")], [(MOD, "p.tests.t", "CALLS", F_, "p.m.used")], {"include_tests": True}, set()),
    "excluded paths": ([node(F_, "p.g.a", "src/gen/a.ts"), node(F_, "p.m.b", "src/b.ts")], [], {"exclude_patterns": ("*/gen/*",)}, {"p.m.b"}),
    "entry points": ([node(F_, "p.m.start"), node(F_, "p.m.stop")], [], {"entry_points": (".start",)}, {"p.m.stop"}),
    "go and rust": ([node(F_, "p.a.init@51", "a.go"), node(F_, "p.a.f", "a.go"), node(F_, "p.r.main", "r.rs"), node(M_, "p.r.T.fmt", "r.rs"), node(M_, "p.r.T.main", "r.rs"), node(F_, "p.r.unit", "r.rs", decorators=["#[tokio :: test]"], start=10, end=20), node(F_, "p.r.nested", "r.rs", start=12, end=14), node(MOD, "p.r.tests", "r.rs"), node(F_, "p.r.tests.help", "r.rs")], [], {}, {"p.a.f", "p.r.T.main"}),
    "c entries": ([node(F_, "p.run.app.main", "run/app.c"), node(F_, "p.run.app.ns.main", "run/app.c"), node(F_, "p.x.operator==", "x.hpp")], [], {}, {"p.run.app.ns.main"}),
    "java and c#": ([node(M_, "p.A.readObject(In)", "A.java"), node(M_, "p.A.read(In)", "A.java"), node(M_, "p.B.Dispose()", "B.cs"), node(M_, "p.B.t", "B.cs", decorators=["[Fact]"]), node(M_, "p.B.~B", "B.cs"), node(M_, "p.B.u", "B.cs")], [], {}, {"p.A.read(In)", "p.B.u"}),
    "react and nest": ([node(M_, "p.V.render", "v.tsx"), node(M_, "p.W.render", "w.tsx"), node(M_, "p.X.render", "x.tsx"), node(C_, "p.S", "s.ts", decorators=["@Injectable()"]), node(M_, "p.S.constructor", "s.ts"), node(M_, "p.S.other", "s.ts"), node(M_, "p.O.create", "o.ts")], [(C_, "p.V", "INHERITS", C_, "p.W"), (C_, "p.W", "INHERITS", "ExternalModule", "React.Component"), *[(C_, q.rsplit(".", 1)[0], "DEFINES_METHOD", M_, q) for q in ("p.V.render", "p.W.render", "p.X.render", "p.S.constructor", "p.S.other", "p.O.create")], (C_, "p.O", "IMPLEMENTS", "ExternalModule", "nest.TypeOrmOptionsFactory")], {}, {"p.X.render", "p.S.other"}),
    "symbols": ([node(M_, "p.I.[Symbol.iterator]", "i.js"), node(M_, "p.I.[Symbol.own]", "i.js")], [], {}, {"p.I.[Symbol.own]"}),
    "classes": ([node(MOD, "p.m"), node(C_, "p.m.A"), node(C_, "p.m.B"), node(C_, "p.m.D")], [(MOD, "p.m", "INSTANTIATES", C_, "p.m.A"), (C_, "p.m.A", "INHERITS", C_, "p.m.B")], {"include_classes": True}, {"p.m.D"}),
}


def test_dead_code(spark):
    """All cases are projects of one table, so that the loops run once for each configuration."""
    groups = {}
    for name, (nodes, edges, config, want) in CASES.items():
        groups.setdefault(tuple(sorted(config.items())), []).append((name, nodes, edges, want))
    for config, cases in groups.items():
        for k in range(len(cases)) if config else [None]:
            part = cases if k is None else [cases[k]]
            tag = {name: f"p{i}x" for i, (name, *_) in enumerate(part)}
            move = lambda q, t: f"p.{t}{q[1:]}" if q.startswith("p.") else q
            rows, links_, want = [], [], set()
            for name, nodes, edges, dead in part:
                if name == "c entries":  # a file's place is part of its names
                    rows += nodes
                    want |= dead
                    continue
                t = tag[name]
                rows += [(n[0], move(n[1], t), *n[2:3], f"{t}/{n[3]}", *n[4:]) for n in nodes]
                links_ += [(a, move(s, t), r, b, move(d, t)) for a, s, r, b, d in edges]
                want |= {move(q, t) for q in dead}
            got = deadcode.dead_code(spark.createDataFrame(rows, NODE), spark.createDataFrame(links_, EDGE), "p.", deadcode.Config(**dict(config)))
            assert {r["qualified_name"] for r in got.collect()} == want, [c[0] for c in part]


def test_flow_verdict(spark):
    e = lambda *p: spark.createDataFrame(p, "source string, target string")
    none, gap = spark.createDataFrame([], "path string"), spark.createDataFrame([("b.py",), ("a.py",), (None,)], "path string")
    assert flow.verdict(e(("a", "b"), ("b", "c"), (None, "x")), gap, "a", "c") == ("FOUND", ["a", "b", "c"], [])
    assert flow.verdict(e(("a", "b")), none, "b", "a") == ("NO_FLOW", [], [])
    assert flow.verdict(e(("a", "b")), gap, "b", "a") == ("UNKNOWN", [], ["a.py", "b.py"])
    assert flow.verdict(e(("a", "b")), none, "a", "a") == ("NO_FLOW", [], [])
    assert flow.verdict(e(("a", "b"), ("b", "a")), none, "a", "a") == ("FOUND", ["a", "b", "a"], [])


def test_taint_summaries(spark):
    got = flow.return_origins(spark.createDataFrame([("c", "ENV", "T")], "fn string, kind string, identity string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "fn string, callee string"))
    assert {tuple(r) for r in got.collect()} == {(f, "ENV", "T") for f in "abc"}
    got = flow.param_sinks(spark.createDataFrame([("c", "q", "FILE", "f")], "fn string, param string, kind string, identity string"), spark.createDataFrame([("a", "p", "c", "q"), ("b", "r", "a", "other")], "fn string, param string, callee string, callee_param string"))
    assert {tuple(r) for r in got.collect()} == {("c", "q", "FILE", "f"), ("a", "p", "FILE", "f")}
    got = flow.bind_argument(spark.createDataFrame([("f", "arg:0"), ("f", "arg:5"), ("f", "kw:y"), ("f", "kw:z"), ("g", "arg:3")], "callee string, via string"), spark.createDataFrame([("f", ["x", "rest", "y"], 1), ("g", ["a"], None)], "fn string, names array<string>, variadic_index int"))
    assert {(r["callee"], r["via"]): r["param"] for r in got.collect()} == {("f", "arg:0"): "x", ("f", "arg:5"): "rest", ("f", "kw:y"): "y", ("f", "kw:z"): None, ("g", "arg:3"): None}


TRACEBACK = """Traceback (most recent call last):
  File "/r/a.py", line 1, in old
ValueError: first

During handling of the above exception, another exception occurred:

Traceback (most recent call last):
  File "/r/m.py", line 3, in top
    mid()
  File "/r/m.py", line 7, in mid
    low()
    ^^^^^
Ünicode.Error: boom: x
"""


def test_crash(spark):
    parsed = [(list(map(tuple, r["frames"])), r["exception"], r["message"]) for r in crash.parse_tracebacks(spark.createDataFrame([(1, TRACEBACK), (2, "KeyboardInterrupt"), (3, None)], "i int, text string")).orderBy("i").collect()]
    assert parsed == [([("/r/m.py", 3, "top"), ("/r/m.py", 7, "mid")], "Ünicode.Error", "boom: x"), ([], "KeyboardInterrupt", ""), ([], "", "")]
    calls = spark.createDataFrame([("top", "mid"), ("mid", "low"), ("x", "low"), ("y", "x"), ("y", "mid"), ("far", "y"), ("farther", "far")], "from_qn string, to_qn string")
    flows = spark.createDataFrame([("src", "low"), ("x", "low"), ("src", "else")], "source string, target string")
    got = [(r["qualified_name"], r["score"], r["call_path"]) for r in crash.rank_causes(["top", "mid", "low"], calls, flows).collect()]
    assert got == [("x", 1.0, ["x", "low"]), ("mid", 0.7, ["mid", "low"]), ("src", 0.6, []), ("top", 0.5, ["top", "mid", "low"]), ("y", 0.2, ["y", "mid", "low"]), ("far", 0.133, ["far", "y", "mid", "low"])]
    assert crash.rank_causes([], calls, flows).collect() == []
    (row,) = crash.surroundings(spark.createDataFrame([("low",)], "qualified_name string"), calls.union(calls), flows).collect()
    assert row["callers"] == ["mid", "mid", "x", "x"] and row["callees"] == [] and row["flow_sources"] == ["src", "x"]


URLS = [
    ("http://h/users/1", "/users/{id}", "exact"), ("http://h/users/1/", "/users/<int:id>", "exact"), ("/users/1?x=2", "/users/:id", "exact"), ("http://h/users", "/users/{id}", None), ("users/1", "/users/{id}", None), ("//cdn/users/1", "/users/{id}", None),
    ("http://h/a/users/7", "/**/users/{id}", "exact"), ("http://h/y/svc/review", "/review", "suffix"), ("http://h/x/y/z/review", "/review", None), ("http://h/api/otp", "/admin/api/otp", "mount"), ("http://h/otp", "/{p}/otp", None), ("http://h/1", "/{id}", None), ("http://h/1", "/x/{id}", None),
]


def test_url_templates(spark):
    for k, (url, template, how) in enumerate(URLS):
        URLS[k] = (url, template, how)
    urls = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "i int, url string")
    templates = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(URLS)], "j int, template string")
    got = {r["i"]: r["how"] for r in links.match_templates(urls, templates).where("i = j").collect()}
    assert got == {i: how for i, (*_, how) in enumerate(URLS) if how}


def test_route_decorators(spark):
    rows = [("@app.get('/a')",), ('@router.route("/b", methods=["GET", \'post\'])',), ("@route('/c')",), ("@app.get(prefix + '/d')",), ("@cache('/e')",), ("@app.route('/f', methods=[])",)]
    got = {(r["receiver"], r["method"], r["template"]) for r in links.parse_route_decorators(spark.createDataFrame(rows, "decorator string")).collect()}
    assert got == {("app", "GET", "/a"), ("router", "GET", "/b"), ("router", "POST", "/b"), (None, "GET", "/c")}


def test_link_endpoints(spark):
    net = "network string, url string, directions array<string>, caller_projects array<string>"
    end = "endpoint string, identity string, project string"
    run = lambda n, e: {tuple(r) for r in links.link_endpoints(spark.createDataFrame(n, net), spark.createDataFrame(e, end)).collect()}
    ends = [("u", "GET /users/{id}", "user_service__2ad"), ("o", "GET /users/{id}", "orders"), ("w", "POST /users/{id}", "user_service__2ad"), ("old", "GET /users/{id}", None), ("p", "GET /{a}/{b}", "orders")]
    nets = [("host", "http://user-service/users/1", ["READS_FROM"], []), ("any", "http://other/users/1", ["READS_FROM"], []), ("root", "/users/1", ["READS_FROM"], ["orders"])]
    assert run(nets, ends) == {("host", "u", None, None), ("host", "old", None, None), ("any", "u", None, None), ("any", "o", None, None), ("any", "old", None, None), ("root", "o", None, None), ("root", "old", None, None)}
    ends = [("a", "GET /review", "some-service"), ("b", "GET /review", "other"), ("c", "GET /admin/v1/otp", "x"), ("d", "POST /admin/v1/otp", "x"), ("e", "GET /one", "x"), ("f", "GET /two/one", "y")]
    nets = [("named", "http://gw/y/some-service/review", [], []), ("tie", "http://gw/y/review", [], []), ("group", "http://gw/v1/otp", [], []), ("suffix", "/z/one", ["READS_FROM"], ["x"])]
    assert run(nets, ends) == {("named", "a", "/y/some-service", None), ("group", "c", None, "/admin"), ("group", "d", None, "/admin"), ("suffix", "e", "/z", None)}


def test_dispatch_keys(spark):
    got = links.link_dispatch_keys(spark.createDataFrame([("a/dev",), ("b/dev",), ("c",), ("d/x",)], "key string"), spark.createDataFrame([("a",), ("b",), ("b/dev",), ("c",)], "key string"))
    assert {tuple(r) for r in got.collect()} == {("a/dev", "a"), ("b/dev", "b/dev"), ("c", "c")}


CALLABLES = [("Module", "p.m", "m.py", None, None), ("Function", "p.m.f", "m.py", 1, 20), ("Function", "p.m.f.g", "m.py", 5, 8), ("Method", "p.m.C.run@40", "m.py", 40, 50), ("Method", "p.m.D.run", "m.py", None, None), ("Function", "p.n.f", "n.py", 1, 9)]


def test_trace(spark):
    nodes = spark.createDataFrame(CALLABLES, "label string, qualified_name string, path string, start_line long, end_line long")
    frames = [("/r/m.py", "<module>", 1, "p.m", None), ("/r/m.py", "f.<locals>.g", 6, "p.m.f.g", None), ("/r/m.py", "run", 45, "p.m.C.run@40", None), ("/r/m.py", "run", 99, "p.m.C.run@40", None), ("/r/m.py", "C.run", 1, "p.m.C.run@40", None), ("/r/m.py", "who", 7, "p.m.f.g", None), ("/r/m.py", "who", 70, None, "no_match"), ("/r/m.py", "f.<lambda>", 3, None, "synthetic"), ("/x/m.py", "f", 3, None, "outside_repo"), ("/r/zz.py", "f", 3, None, "unknown_path")]
    got = trace.resolve(spark.createDataFrame([(i, *f[:3]) for i, f in enumerate(frames)], "frame_id long, path string, qualname string, line long"), nodes, "/r")
    assert {r["frame_id"]: (r["qualified_name"], r["reason"]) for r in got.collect()} == {i: f[3:] for i, f in enumerate(frames)}
    point = "struct<path: string, qualname: string, line: long>"
    f, g, out = ("/r/m.py", "f", 2), ("/r/m.py", "f.<locals>.g", 6), ("/lib/x.py", "z", 1)
    records = [(f, g, 2, ["w1"], ["R"]), (f, g, 3, ["w2", "w1"], []), (g, f, 1, [], []), (out, g, 1, [], []), (f, out, 1, [], []), (out, out, 1, [], [])]
    rows = spark.createDataFrame(records, f"caller {point}, callee {point}, count long, workloads array<string>, receiver_types array<string>")
    edges, failed = trace.ingest(rows, nodes, spark.createDataFrame([("p.m.f", "p.m.f.g")], "from_qn string, to_qn string"), "/r")
    got = {(r["from_qn"], r["to_qn"]): (r["dynamic_call_count"], r["dynamic_workload_count"], r["dynamic_workloads"], r["dynamic_receiver_types"], r["static_missed"]) for r in edges.collect()}
    assert got == {("p.m.f", "p.m.f.g"): (5, 2, ["w1", "w2"], ["R"], False), ("p.m.f.g", "p.m.f"): (1, 0, [], [], True)}
    assert {tuple(r) for r in failed.collect()} == {("outside_repo", 3)}


def test_weighted_edges(spark):
    rows = [(1, 0, "a", 5), (1, 1, None, 5), (1, 2, "b", 5), (1, 3, "c", 5), (2, 0, "a", 0), (2, 1, "b", 0)]
    got = trace.weighted_edges(spark.createDataFrame(rows, "sample_id int, depth int, name string, weight int"))
    assert {tuple(r) for r in got.collect()} == {("a", "b", 6), ("b", "c", 5)}


def test_fixpoints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    assert {tuple(r) for r in fixpoint.closure(spark.createDataFrame([(1,)], "id long"), edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert {tuple(r) for r in fixpoint.closure(spark.createDataFrame([(1,)], "id long"), edges, 3, 1).collect()} == {(2, 1), (3, 2), (1, 3), (4, 3)}
    assert {tuple(r) for r in fixpoint.strongly_connected(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8), (9, 9)}
    assert {tuple(r) for r in fixpoint.components(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 7), (8, 7), (9, 9)}
    assert {tuple(r) for r in fixpoint.topological_levels(nodes, edges).collect()} == {(7, 0), (8, 1), (9, 0)}
    assert abs(sum(r["rank"] for r in fixpoint.pagerank(nodes, edges, 3).collect()) - 9) < 3
    assert {tuple(r) for r in fixpoint.similarity(spark.createDataFrame([(1, 9), (2, 9), (1, 8)], "src long, dst long")).collect()} == {(1, 2, 0.5)}


def test_shortest_path_ties_follow_the_queue(spark):
    edges = spark.createDataFrame([("f", "b"), ("f", "a"), ("a", "z"), ("b", "c"), ("b", "z")], "src string, dst string")
    got = {r["id"]: r["path"] for r in fixpoint.shortest_paths(spark.createDataFrame([("f",)], "id string"), edges).collect()}
    assert got["z"] == ["f", "a", "z"] and got["c"] == ["f", "b", "c"]


def test_names(spark):
    row = spark.createDataFrame([("p.pkg.sib.f", "p.pkg.call", "p.m.f@12", "p.m.f@12_4", "p.m.f@x", "a.b(String, (x))", "a.b")], "a string, b string, c string, d string, e string, f string, g string")
    r = row.select(resolve.import_distance(F.col("a"), F.col("b")).alias("d"), *[resolve.first_definition(F.col(x)).alias(x) for x in "cde"], resolve.without_parameters(F.col("g")).alias("g")).first()
    assert tuple(r) == (1, "p.m.f", "p.m.f", "p.m.f@x", "a.b")


def test_inherited_members(spark):
    inherits = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("A", "D", 0)], "child string, parent string, base_index int")
    members = spark.createDataFrame([("A", "f", "A.f"), ("C", "f", "C.f"), ("A", "g", "A.g"), ("D", "h", "D.h")], "class string, name string, member string")
    wanted = spark.createDataFrame([("D", "f"), ("D", "g"), ("D", "h"), ("B", "f"), ("D", "none")], "class string, name string")
    assert {(r["class"], r["name"]): r["member"] for r in resolve.inherited_member(wanted, inherits, members).collect()} == {("D", "f"): "C.f", ("D", "g"): "A.g", ("D", "h"): "D.h", ("B", "f"): "A.f"}
    assert {tuple(r) for r in resolve.providers(wanted.where("name = 'f' and class = 'D'"), inherits, members).collect()} == {("D", "f", "C.f"), ("D", "f", "A.f")}


def small(spark):
    nodes = spark.createDataFrame([("p", "Project", None), ("m", "Module", "m.py"), ("n", "Module", "n.py"), ("f", "Function", "m.py"), ("g", "Function", "n.py"), ("x", "ExternalModule", None), ("r", "Resource", None), ("s", "Resource", None), ("t", "Resource", None)], "id string, label string, path string")
    edges = spark.createDataFrame([("p", "CONTAINS_MODULE", "m"), ("m", "DEFINES", "f"), ("n", "DEFINES", "g"), ("g", "CALLS", "f"), ("g", "FLOWS_TO", "r"), ("r", "FLOWS_TO", "s"), ("f", "CALLS", "gone")], "src string, rel_type string, dst string")
    return Graph(nodes, edges)


def test_maintenance(spark):
    g = small(spark)
    ids = lambda x: {r["id"] for r in x.nodes.collect()}
    assert ids(merge.delete_subtree(g, g.nodes.where("id = 'm'"), ["DEFINES"])) == {"p", "n", "g", "x", "r", "s", "t"}
    assert merge.delete_subtree(g, g.nodes.where("id = 'm'"), ["DEFINES"]).edges.count() == 3
    assert ids(merge.delete_orphan_externals(g)) == ids(g) - {"x"}
    assert ids(merge.delete_unanchored_resources(g)) == ids(g) - {"t"}
    changed = spark.createDataFrame([("m.py",)], "path string")
    assert {r["path"] for r in merge.affected_callers(g, changed).collect()} == {"n.py"}
    after = Graph(g.nodes, g.edges.where("src <> 'g'"))
    assert ("g", "CALLS", "f") in {tuple(r) for r in merge.restore_inbound(g, after, changed).edges.collect()}
    batch = spark.createDataFrame([("f", "CALLS", "g", None, None), ("f", "CALLS", "g", None, None), ("f", "CALLS", "g", "arg:0", "k"), ("f", "CALLS", "nowhere", None, None)], "src string, rel_type string, dst string, via string, kind string")
    assert merge.merge_edges(batch, g.nodes).count() == 2
    assert [tuple(r) for r in merge.attempted_and_created(batch, g.nodes).collect()] == [("CALLS", 4, 3)]
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, u string, v string")
    new = spark.createDataFrame([(1, None, "y", 1), (1, "c", None, 2), (3, "n", None, 3), (None, "skip", None, 4), (1, "older", None, 0)], "id int, u string, v string, seq int")
    assert {tuple(r) for r in merge.merge_nodes(old, new, ["id"], "seq").collect()} == {(1, "c", "y"), (2, "b", None), (3, "n", None)}


def test_audit(spark):
    g = small(spark)
    assert {r["id"] for r in audit.orphans(g.nodes, g.edges).collect()} == {"x", "t"}
    assert {tuple(r) for r in audit.dangling(g.nodes, g.edges).collect()} == {("f", "CALLS", "gone")}
    odd = g.edges.union(spark.createDataFrame([("f", "CONTAINS_FILE", "p")], "src string, rel_type string, dst string"))
    assert {tuple(r) for r in audit.undocumented_triples(g.nodes, odd).collect()} == {("Function", "CONTAINS_FILE", "Project")}
    assert [r["label"] for r in audit.undocumented_labels(g.nodes.union(spark.createDataFrame([("q", "Odd", None)], "id string, label string, path string"))).collect()] == ["Odd"]
    got = {tuple(r) for r in audit.property_violations(g.nodes.withColumn("path", F.when(F.col("id") != "n", F.coalesce("path", F.lit("z"))))).collect()}
    assert ("Module", "path", "missing_required_property", 1) in got and ("Resource", "path", "undocumented_property", 3) in got and ("Project", "path", "undocumented_property", 1) in got


def test_diff(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, None)], "key string, line int, doc string")
    new = spark.createDataFrame([("a", 1, None), ("b", 4, None), ("d", 9, None)], "key string, line int, doc string")
    got = {r["key"]: (r["change"], {k: tuple(v) for k, v in (r["delta"] or {}).items()}) for r in diff.diff_rows(old, new, ["key"]).collect()}
    assert got == {"b": ("changed", {"line": ("2", "4"), "doc": ("x", None)}), "c": ("removed", {}), "d": ("added", {})}
    assert diff.diff_rows(old, old, ["key"]).collect() == []
    flips = diff.coverage_flips(spark.createDataFrame([("m", None), ("n", True)], "key string, flow_covered boolean"), spark.createDataFrame([("m", True), ("n", True)], "key string, flow_covered boolean"))
    assert [tuple(r) for r in flips.collect()] == [("m", False, True)]
    for a, b in [({}, {"schema_hash": "x"}), ({"schema_hash": "x"}, {"schema_hash": "y"})]:
        with pytest.raises(ValueError, match="schema"):
            diff.check_schema_hashes(a, b)


def test_scores_and_limits(spark):
    s = lambda *r: spark.createDataFrame(r, "category string, key string")
    got = {r["category"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in scoring.score_sets(s(("a", "1"), ("a", "2"), ("b", "1")), s(("a", "1"), ("a", "3"))).collect()}
    assert got == {"a": (1, 1, 1, 0.5), "b": (0, 1, 0, 0.0)}
    rows = spark.createDataFrame([(1, 1, 500), (1, 2, 1), (2, 1, 10), (2, 2, 80), (2, 3, 20), (2, 4, 1)], "g int, n int, cost int")
    assert sorted((r["g"], r["n"]) for r in limits.within_budget(rows, "cost", 100, ["n"], ["g"]).collect()) == [(1, 1), (2, 1), (2, 2)]
    ranked = spark.createDataFrame([("q", "x", 0.5, 0), ("q", "y", 0.5, 1), ("q", "z", 0.9, 2)], "query string, item string, score double, position int")
    assert scoring.recall_at_k(ranked, spark.createDataFrame([("q", "x"), ("q", "y"), ("q", "y")], "query string, item string"), 2).first()["hits"] == 1


def test_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in search.top_k(rows, [1.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    found = search.findings(spark.createDataFrame([("p.m", "ok\n  eval(x)")], "qualified_name string, text string"), [("no-eval", "SecurityIssue", r"eval\(")]).collect()
    assert [(r["key"], r["line"], r["col"], r["snippet"]) for r in found] == [("p.m.2.3.no-eval", 2, 3, "  eval(x)")]


def test_schema():
    assert len(schema.LABELS) == 20 and len({r for r, *_ in schema.RELATIONSHIPS}) == 25
    assert {"label", "key", "flow_covered"} <= set(schema.nodes_schema().names)
    assert ("Module", "CALLS", "Function") in schema.TRIPLES and ("Function", "CALLS", "Module") not in schema.TRIPLES
