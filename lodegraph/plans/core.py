"""Registered queries of the code-graph core: dead code, flows, overrides, dispatch, callables, mounts, links and upkeep.

The facts come from the star-schema tables: classes are suppliers (a tree by half the key), functions are parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.graph import Graph
from lodegraph.operators import callables, crash, deadcode, flow, links, merge, mounts, overrides, resolve, search
from lodegraph.plans.catalog import EDGES, NODES, QUERY_VECTOR, TREE, graph, query, t

# Classes of suppliers: bases, members and interfaces.
PAR = "par AS (SELECT 'c' || s_suppkey AS child, 'c' || (s_suppkey // 2) AS parent, FALSE AS iface FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 'c' || s_suppkey, 'i' || (s_suppkey % 7), TRUE FROM supplier WHERE s_suppkey % 3 = 0)"
MEM = """mem AS (SELECT *, class || '.' || leaf AS member, string_split(leaf, '(')[1] AS name FROM (
SELECT 'c' || k AS class, k, m, CASE m WHEN 3 THEN CASE WHEN k % 2 = 1 THEN 'm3(T,Map<K,V>)' ELSE 'm3(A,Map<B,C>)' END WHEN 4 THEN 'm4()' ELSE 'm' || m END AS leaf, NOT (m = 2 AND k % 5 = 0) AS is_method, CASE m WHEN 3 THEN 2 WHEN 4 THEN 0 END AS n FROM (SELECT s_suppkey AS k FROM supplier), range(0, 5) r(m) WHERE (k + m) % 3 <> 0
UNION ALL SELECT 'i' || j, -1, m, CASE m WHEN 3 THEN 'm3(A,Map<B,C>)' ELSE 'm0' END, TRUE, CASE m WHEN 3 THEN 2 END FROM range(0, 7) x(j), (VALUES (0), (3)) v(m)))"""
ANC = "anc AS (SELECT child AS c, parent AS a, 1 AS depth FROM par WHERE NOT iface UNION ALL SELECT anc.c, par.parent, depth + 1 FROM anc JOIN par ON par.child = anc.a AND NOT iface)"


def parents(spark, d) -> DataFrame:
    s = t(spark, d, "supplier")
    bases = s.where("s_suppkey > 1").selectExpr("concat('c', s_suppkey) AS child", "concat('c', s_suppkey div 2) AS parent", "0 AS position", "false AS is_interface")
    return bases.union(s.where("s_suppkey % 3 = 0").selectExpr("concat('c', s_suppkey)", "concat('i', s_suppkey % 7)", "0", "true"))


def members(spark, d) -> DataFrame:
    own = t(spark, d, "supplier").selectExpr("s_suppkey AS k", "explode(sequence(0, 4)) AS m").where("(k + m) % 3 <> 0")
    own = own.selectExpr("concat('c', k) AS class", "case m when 3 then if(k % 2 = 1, 'm3(T,Map<K,V>)', 'm3(A,Map<B,C>)') when 4 then 'm4()' else concat('m', m) end AS leaf", "not (m = 2 and k % 5 = 0) AS is_method", "k")
    faces = spark.range(7).selectExpr("concat('i', id) AS class", "explode(array('m0', 'm3(A,Map<B,C>)')) AS leaf", "true AS is_method", "-1L AS k")
    return own.union(faces).withColumn("member", F.concat_ws(".", "class", "leaf"))


def inherits(spark, d) -> DataFrame:
    return parents(spark, d).where("not is_interface").select("child", "parent", F.col("position").alias("base_index"))


@query(
    """SELECT member, min_by(overridden, (depth, rank)) AS overridden FROM (
SELECT w.member, depth, rank, CASE WHEN e.member IS NULL THEN s.member WHEN e.is_method THEN e.member END AS overridden
FROM (SELECT mem.*, a, depth, rank FROM mem JOIN near ON near.c = mem.class WHERE is_method AND k >= 0 AND (k % 11 <> 0 OR rank = 1)) w
LEFT JOIN mem e ON e.class = w.a AND e.leaf = w.leaf
LEFT JOIN (SELECT class, name, n, min(member) AS member FROM mem WHERE is_method AND n IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1) s ON s.class = w.a AND s.name = w.name AND s.n = w.n)
WHERE overridden IS NOT NULL GROUP BY member""",
    "RECURSIVE", PAR, MEM, ANC,
    "near AS (SELECT c, a, min(depth) AS depth, rank FROM (SELECT c, a, depth, 0 AS rank FROM anc UNION ALL SELECT child, parent, 1, 1 FROM par WHERE iface UNION ALL SELECT c, par.parent, depth + 1, 1 FROM anc JOIN par ON par.child = anc.a AND iface) GROUP BY c, a, rank)",
)
def r16_method_overrides(spark, d):
    m = members(spark, d)
    methods = m.where("is_method and k >= 0").select("class", "leaf", "member", (F.col("k") % 11 == 0).alias("needs_modifier"))
    return overrides.overrides(methods, parents(spark, d), m)


@query(None)
def r17_mro_shadow(spark, d):
    """No SQL: the linear order of a diamond is an ordered walk. tests/test_core.py compares it with a plain one."""
    s = t(spark, d, "supplier").where("s_suppkey > 2")
    two = s.selectExpr("concat('c', s_suppkey) AS child", "posexplode(array(concat('c', s_suppkey div 2), concat('c', s_suppkey div 3))) AS (position, parent)").selectExpr("child", "parent", "position", "false AS is_interface")
    return overrides.shadowed(two.dropDuplicates(["child", "parent"]), members(spark, d))


@query("SELECT class, name, min_by(provider, depth) AS provider FROM (SELECT c.class, m.name, m.class AS provider, depth FROM (SELECT DISTINCT class FROM mem WHERE k >= 0) c JOIN (SELECT c, a, depth FROM anc UNION ALL SELECT DISTINCT class, class, 0 FROM mem WHERE k >= 0) w ON w.c = c.class JOIN mem m ON m.class = w.a WHERE m.name IN ('m0', 'm1')) GROUP BY class, name", "RECURSIVE", PAR, MEM, ANC)
def r18_inherited_member(spark, d):
    """W5 too: the first provider among the ancestors."""
    m = members(spark, d).where("k >= 0")
    wanted = m.select("class").distinct().select("class", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("name"))
    return resolve.inherited_member(wanted, inherits(spark, d), m.select("class", F.col("leaf").alias("name"), "member")).select("class", "name", "provider")


@query("SELECT DISTINCT w.c AS class, m.name, m.member FROM (SELECT c, a FROM anc UNION SELECT DISTINCT class, class FROM mem WHERE k >= 0) w JOIN mem m ON m.class = w.a WHERE m.name = 'm1'", "RECURSIVE", PAR, MEM, ANC)
def r19_all_providers(spark, d):
    m = members(spark, d).where("k >= 0")
    wanted = m.select("class", F.lit("m1").alias("name")).distinct()
    return resolve.providers(wanted, inherits(spark, d), m.select("class", F.col("leaf").alias("name"), "member"))


@query("SELECT a AS class, c AS subclass FROM anc WHERE c NOT IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)", "RECURSIVE", PAR, ANC)
def r20_concrete_subclasses(spark, d):
    abstract = t(spark, d, "supplier").where("s_suppkey % 4 = 0").selectExpr("concat('c', s_suppkey) AS class")
    return overrides.concrete_subclasses(parents(spark, d).where("not is_interface"), abstract)


@query(
    """SELECT DISTINCT class, name, member FROM (
SELECT class, 'm1' AS name, min_by(member, depth) AS member FROM (SELECT w.c AS class, m.member, depth FROM (SELECT c, a, depth FROM anc UNION ALL SELECT DISTINCT class, class, 0 FROM mem WHERE k >= 0) w JOIN mem m ON m.class = w.a AND m.name = 'm1') GROUP BY class
UNION ALL SELECT a, 'm1', m.member FROM anc JOIN mem m ON m.class = c AND m.name = 'm1')
WHERE member NOT IN (SELECT member FROM mem WHERE k % 6 = 0)""",
    "RECURSIVE", PAR, MEM, ANC,
)
def r21_self_dispatch(spark, d):
    m = members(spark, d).where("k >= 0")
    calls = m.select("class", F.lit("m1").alias("name")).distinct()
    return overrides.self_targets(calls, parents(spark, d).where("not is_interface"), m, m.where("k % 6 = 0").select("member"))


@query("SELECT p.class, 'm1' AS name, m.member FROM (SELECT 'c' || s_suppkey AS class FROM supplier WHERE s_suppkey % 9 = 0) p, mem m WHERE m.name = 'm1' AND (k < 0 OR k % 9 <> 0)", MEM)
def r21_protocol_dispatch(spark, d):
    protocols = t(spark, d, "supplier").where("s_suppkey % 9 = 0").selectExpr("concat('c', s_suppkey) AS class")
    return overrides.protocol_targets(protocols.withColumn("name", F.lit("m1")), protocols, members(spark, d))


@query(
    """SELECT f AS class, 'm0' AS name, min_by(member, depth) AS member FROM (SELECT 'f' || (s_suppkey % 60) AS f, min('c' || s_suppkey) AS impl FROM supplier GROUP BY 1 HAVING count(*) = 1)
JOIN (SELECT c, a, depth FROM anc UNION ALL SELECT DISTINCT class, class, 0 FROM mem WHERE k >= 0) w ON w.c = impl JOIN mem m ON m.class = w.a AND m.name = 'm0' GROUP BY f""",
    "RECURSIVE", PAR, MEM, ANC,
)
def r21_sole_implementer(spark, d):
    faces = t(spark, d, "supplier").selectExpr("concat('c', s_suppkey) AS child", "concat('f', s_suppkey % 60) AS parent", "0 AS position", "true AS is_interface")
    calls = faces.select(F.col("parent").alias("class"), F.lit("m0").alias("name")).distinct()
    return overrides.sole_targets(calls, parents(spark, d).where("not is_interface").union(faces), members(spark, d).where("k >= 0"))


CALLS = """defs AS (SELECT DISTINCT 'm.' || (p_partkey % 25) || '.f' || (p_partkey % 60) AS qn, 'm.' || (p_partkey % 25) AS module, 'f' || (p_partkey % 60) AS name FROM part),
imp AS (SELECT 'm.' || j AS module, 'f' || (j % 10) AS name, 'm.' || ((j + 1) % 25) || '.f' || (j % 10) AS target FROM range(0, 30) r(j) UNION ALL SELECT 'm.' || j, 'f' || (j % 10 + 10), NULL FROM range(0, 30) r(j) UNION ALL SELECT 'm.' || j, '*', 'm.' || (j * 7 % 25) FROM range(0, 30) r(j)),
calls AS (SELECT l_orderkey * 10 + l_linenumber AS call, 'm.' || (l_orderkey % 30) AS module, 'f' || (l_partkey % 60) AS name FROM lineitem)"""


@query(
    """SELECT call, rule, target FROM (SELECT *, row_number() OVER (PARTITION BY call ORDER BY rule, target NULLS FIRST) AS n FROM (
SELECT call, 1 AS rule, imp.target FROM calls JOIN imp USING (module, name) WHERE target IS NULL OR target IN (SELECT qn FROM defs)
UNION ALL SELECT call, 2, qn FROM calls JOIN defs USING (module, name)
UNION ALL SELECT call, 3, qn FROM calls JOIN imp ON imp.module = calls.module AND imp.name = '*' JOIN defs ON defs.module = imp.target AND defs.name = calls.name
UNION ALL SELECT call, 4, NULL FROM calls WHERE name IN ('f3', 'f33')
UNION ALL SELECT call, 5, (SELECT min(qn) FROM defs WHERE defs.name = calls.name) FROM calls WHERE name IN (SELECT name FROM defs))) WHERE n = 1""",
    CALLS,
)
def r23_call_cascade(spark, d):
    part, line = t(spark, d, "part"), t(spark, d, "lineitem")
    defs = part.selectExpr("concat('m.', p_partkey % 25, '.f', p_partkey % 60) AS qualified_name", "concat('m.', p_partkey % 25) AS module", "concat('f', p_partkey % 60) AS name").distinct()
    j = spark.range(30)
    imports = j.selectExpr("concat('m.', id) AS module", "concat('f', id % 10) AS name", "concat('m.', (id + 1) % 25, '.f', id % 10) AS target")
    imports = imports.union(j.selectExpr("concat('m.', id)", "concat('f', id % 10 + 10)", "cast(null as string)")).union(j.selectExpr("concat('m.', id)", "'*'", "concat('m.', id * 7 % 25)"))
    calls = line.selectExpr("l_orderkey * 10 + l_linenumber AS call", "concat('m.', l_orderkey % 30) AS module", "concat('f', l_partkey % 60) AS name")
    return resolve.resolve_calls(calls, defs, imports, spark.createDataFrame([("f3",), ("f33",)], "name string"))


@query(
    "SELECT fn, target FROM b", "RECURSIVE", TREE,
    "b AS (SELECT 'f' || p_partkey AS fn, 't' || (p_partkey % 5) AS target, p_partkey AS k FROM part WHERE p_partkey % 7 = 0 UNION SELECT 'f' || dst, target, dst FROM b JOIN tree ON src = k AND dst % 7 <> 0)",
)
def r27_callable_parameters(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey AS p", "concat('f', p_partkey) AS fn")
    seed = p.where("p % 7 = 0").selectExpr("fn AS callee", "0 AS position", "cast(null as string) AS keyword", "concat('t', p % 5) AS concrete", "cast(null as string) AS from_fn", "cast(null as string) AS from_param")
    passed = p.where("p % 7 <> 0").selectExpr("fn", "if(p % 2 = 0, 0, -1)", "if(p % 2 = 0, cast(null as string), 'cb')", "cast(null as string)", "concat('f', p div 2)", "'cb'")
    return callables.parameter_targets(seed.union(passed), p.selectExpr("fn", "array('cb', 'x') AS names"), p.selectExpr("fn", "'cb' AS param"))


@query(
    """SELECT k AS call, target FROM (SELECT s_suppkey AS k, 'c' || s_suppkey AS receiver, CASE WHEN s_suppkey % 3 = 0 THEN 'handler' ELSE 'h' END AS field FROM supplier) q
JOIN (SELECT DISTINCT owner, CASE WHEN okey % 2 = 0 THEN 'handler' ELSE 'h' END AS field, target FROM own) b USING (field)
WHERE b.owner = receiver OR (receiver NOT IN (SELECT owner FROM own o WHERE (okey % 2 = 0) = (q.field = 'handler')) AND 1 = (SELECT count(DISTINCT owner) FROM own o WHERE (okey % 2 = 0) = (q.field = 'handler')))""",
    "RECURSIVE",
    "up AS (SELECT s_suppkey AS k, s_suppkey AS a, 0 AS depth FROM supplier UNION ALL SELECT k, a // 2, depth + 1 FROM up WHERE a > 1)",
    "own AS (SELECT k, 'c' || okey AS owner, okey, 't' || (k % 4) AS target FROM (SELECT k, min_by(a, depth) AS okey FROM up WHERE a % 3 = 0 OR a = 1 GROUP BY k))",
)
def r28_callable_fields(spark, d):
    s = t(spark, d, "supplier").selectExpr("s_suppkey AS k", "concat('c', s_suppkey) AS class")
    given = s.selectExpr("class", "0 AS position", "cast(null as string) AS keyword", "concat('t', k % 4) AS target")
    made = s.where("k % 3 = 0 or k = 1").selectExpr("class", "array('h', 'z') AS names")
    attributes = s.where("k % 2 = 0").selectExpr("class", "'h' AS param", "'handler' AS field")
    bound = callables.field_bindings(given, made, attributes, inherits(spark, d))
    return callables.field_targets(s.selectExpr("k AS call", "class AS receiver", "if(k % 3 = 0, 'handler', 'h') AS field"), bound)


ROUTERS = """rt AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 10 = 0 THEN 'app' WHEN n_nationkey % 3 = 1 THEN 'blueprint' ELSE 'router' END AS kind, CASE WHEN n_nationkey % 8 <> 5 THEN '/p' || n_nationkey END AS prefix FROM nation),
mt AS (SELECT n_nationkey AS child, n_nationkey // 2 AS parent, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 6 <> 4 THEN '/m' || n_nationkey END AS prefix, n_nationkey % 2 = 0 AS given FROM nation WHERE n_nationkey > 0 AND n_nationkey <> 21 UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 29, '/z', TRUE FROM nation WHERE n_nationkey % 4 = 3),
up AS (SELECT child, parent, kind, CASE kind WHEN 'blueprint' THEN CASE WHEN given THEN mt.prefix ELSE rt.prefix END ELSE CASE WHEN given THEN mt.prefix ELSE '' END || rt.prefix END AS seg, CASE WHEN kind <> 'blueprint' AND rt.prefix IS NOT NULL THEN rt.prefix ELSE '' END AS rest FROM mt JOIN rt ON child = key),
st AS (SELECT key, key AS pos, '' AS tail, [key] AS way FROM rt UNION ALL SELECT key, parent, seg || tail, list_append(way, parent) FROM st JOIN up ON child = pos WHERE kind <> 'app' AND seg IS NOT NULL AND parent IN (SELECT key FROM rt) AND NOT list_contains(way, parent))"""


@query(
    """SELECT st.key, tail AS prefix FROM st JOIN rt ON pos = rt.key WHERE kind = 'app'
UNION SELECT st.key, coalesce(rt.prefix || tail, '/**' || tail) FROM st JOIN rt ON pos = rt.key WHERE kind <> 'app' AND pos NOT IN (SELECT child FROM mt)
UNION SELECT key, '/**' || coalesce(seg, rest) || tail FROM st JOIN up ON child = pos WHERE kind <> 'app' AND (seg IS NULL OR parent NOT IN (SELECT key FROM rt) OR list_contains(way, parent))""",
    "RECURSIVE", ROUTERS,
)
def r30_mount_prefixes(spark, d):
    n = t(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) AS n")
    routers = n.selectExpr("n AS key", "case when n % 10 = 0 then 'app' when n % 3 = 1 then 'blueprint' else 'router' end AS kind", "if(n % 8 <> 5, concat('/p', n), null) AS prefix")
    m = n.where("n > 0 and n <> 21").selectExpr("n AS child", "n div 2 AS parent", "if(n % 2 = 0 and n % 6 <> 4, concat('/m', n), null) AS prefix", "n % 2 = 0 AS given")
    return mounts.mount_prefixes(routers, m.union(n.where("n % 4 = 3").selectExpr("n", "(n * 3 + 1) % 29", "'/z'", "true")))


SCOPE = "CASE %s %% 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a.b' ELSE 'a.b.c' END"


@query(
    f"""SELECT use, key FROM (SELECT use, min(key) AS key, max(key) AS last, length(v.scope) AS depth, row_number() OVER (PARTITION BY use ORDER BY length(v.scope) DESC) AS n
FROM (SELECT o_orderkey AS use, 'm' || (o_custkey % 5) AS module, {SCOPE % 'o_orderkey'} AS scope, 'v' || (o_orderkey % 6) AS name FROM orders) q
JOIN (SELECT 'm' || (n_nationkey % 5) AS module, {SCOPE % 'n_nationkey'} AS scope, 'v' || (n_nationkey % 6) AS name, k || n_nationkey AS key FROM nation, (VALUES ('k'), ('q')) x(k) WHERE k = 'k' OR n_nationkey % 7 = 0) v
ON v.module = q.module AND v.name = q.name AND (v.scope = '' OR v.scope = q.scope OR starts_with(q.scope, v.scope || '.')) GROUP BY use, v.scope) WHERE n = 1 AND key = last"""
)
def r31_router_scope(spark, d):
    scope = lambda c: f"case {c} % 4 when 0 then '' when 1 then 'a' when 2 then 'a.b' else 'a.b.c' end AS scope"
    names = t(spark, d, "orders").selectExpr("o_orderkey AS use", "concat('m', o_custkey % 5) AS module", scope("o_orderkey"), "concat('v', o_orderkey % 6) AS name")
    n = t(spark, d, "nation").selectExpr("*", "explode(array('k', 'q')) AS k").where("k = 'k' or n_nationkey % 7 = 0")
    return mounts.router_of(names, n.selectExpr("concat('m', n_nationkey % 5) AS module", scope("n_nationkey"), "concat('v', n_nationkey % 6) AS name", "concat(k, n_nationkey) AS key"))


# Dead code: functions of parts, decorators, exports and tests by key


FNS = """fns AS (SELECT p_partkey AS k, 'proj.' || replace(p_brand, '#', '') || '.f' || p_partkey AS qn, CASE WHEN p_size > 45 THEN 'tests/' ELSE 'src/' END || replace(p_brand, '#', '') || '.py' AS path, p_partkey % 97 = 3 OR p_partkey % 89 = 0 AS root FROM part),
links AS (SELECT p_partkey AS a, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) AS b FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_partkey % 11 = 0 UNION SELECT p_partkey, p_partkey + 2 FROM part WHERE p_partkey % 5 = 1)"""


@query("SELECT qn AS qualified_name, 'Function' AS label, path FROM fns WHERE NOT starts_with(path, 'tests/') AND k NOT IN (SELECT k FROM live) AND NOT contains(path, 'Brand2')", "RECURSIVE", FNS, "live AS (SELECT k FROM fns WHERE root AND NOT starts_with(path, 'tests/') UNION SELECT b FROM live JOIN links ON a = k)")
def r2_dead_code(spark, d):
    """R3, R5 and R6 too: decorated and exported roots, calls, overrides of live functions, a report pattern."""
    p = t(spark, d, "part")
    n = p.count()
    fns = p.selectExpr("p_partkey AS k", "concat('proj.', replace(p_brand, '#', ''), '.f', p_partkey) AS qualified_name", "concat(if(p_size > 45, 'tests/', 'src/'), replace(p_brand, '#', ''), '.py') AS path")
    nodes = fns.selectExpr("'Function' AS label", "qualified_name", "concat('f', k) AS name", "path", "if(k % 97 = 3, array('@app.route(\"/x\")'), array()) AS decorators", "k % 89 = 0 AS is_exported", "false AS overrides_external", "k * 10 AS start_line", "k * 10 + 5 AS end_line", "cast(array() as array<string>) AS rust_cfg_test_mods", "cast(array() as array<string>) AS rust_ungated_mods")
    pairs = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS a", f"(p_partkey * 3 + 1) % {n} AS b", "'CALLS' AS rel_type")
    pairs = pairs.union(p.where("p_partkey % 5 = 1").selectExpr("p_partkey", "p_partkey + 2", "'REFERENCES'")).union(p.where("p_partkey % 11 = 0").selectExpr("p_partkey", "p_partkey + 1", "'OVERRIDES'"))
    name = lambda x: fns.select(F.col("k").alias(x), F.col("qualified_name").alias(f"{x}_qn"))
    edges = pairs.join(name("a"), "a").join(name("b"), "b").select(F.lit("Function").alias("src_label"), F.col("a_qn").alias("src"), "rel_type", F.lit("Function").alias("dst_label"), F.col("b_qn").alias("dst"))
    return deadcode.dead_code(nodes, edges, "proj.", deadcode.Config(exclude_patterns=("*Brand2*",)))


# Flows


@query("SELECT s AS source, p_partkey AS sink, CASE WHEN length IS NULL THEN 'UNKNOWN' ELSE 'FOUND' END AS verdict, length::INTEGER AS length FROM part, range(1, 6) x(s) LEFT JOIN (SELECT s0, id, min(depth) AS length FROM r WHERE depth > 0 GROUP BY s0, id) ON s0 = s AND id = p_partkey", "RECURSIVE", TREE, "r AS (SELECT s AS s0, s AS id, 0 AS depth FROM range(1, 6) x(s) UNION SELECT s0, dst, depth + 1 FROM r JOIN tree ON src = id)")
def r7_flow_verdicts(spark, d):
    p = t(spark, d, "part")
    pairs = p.selectExpr("explode(sequence(1L, 5L)) AS source", "p_partkey AS sink")
    flows = p.where("p_partkey > 0").selectExpr("p_partkey div 2 AS source", "p_partkey AS target")
    return flow.verdicts(pairs, flows, t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("path")))


@query("SELECT 'f' || id AS qualified_name, round(sum(score), 3) AS score FROM (SELECT id, 0.4 / depth AS score FROM r WHERE depth > 0 UNION ALL SELECT unnest([2, 5, 3]), 0.3 UNION ALL SELECT p_partkey, 0.6 FROM part WHERE p_partkey % 40 = 9) GROUP BY id ORDER BY sum(score) DESC, qualified_name LIMIT 10", "RECURSIVE", TREE, "r AS (SELECT 47::BIGINT AS id, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN tree ON dst = id WHERE depth < 3)")
def r9_crash_causes(spark, d):
    """L5 too."""
    p = t(spark, d, "part")
    calls = p.where("p_partkey > 0").selectExpr("concat('f', p_partkey div 2) AS from_qn", "concat('f', p_partkey) AS to_qn")
    flows = p.where("p_partkey % 40 = 9").selectExpr("concat('f', p_partkey) AS source", "'f47' AS target")
    return crash.rank_causes(["f2", "f5", "f3", "f47"], calls, flows).select("qualified_name", "score")


@query("SELECT fn, kind, identity FROM o", "RECURSIVE", TREE, "o AS (SELECT p_partkey AS fn, 'ENV' AS kind, 'v' || (p_partkey % 3) AS identity FROM part WHERE p_partkey % 50 = 0 UNION SELECT src, kind, identity FROM o JOIN tree ON dst = fn)")
def r11_return_origins(spark, d):
    p = t(spark, d, "part")
    return flow.return_origins(p.where("p_partkey % 50 = 0").selectExpr("p_partkey AS fn", "'ENV' AS kind", "concat('v', p_partkey % 3) AS identity"), p.where("p_partkey > 0").selectExpr("p_partkey div 2 AS fn", "p_partkey AS callee"))


PASSES = "passes AS (SELECT 'f' || (p_partkey // 2) AS fn, 'a' AS param, 'f' || p_partkey AS callee, 'a' AS callee_param FROM part WHERE p_partkey > 0 UNION ALL SELECT 'f' || (p_partkey // 2), 'b', 'f' || p_partkey, 'a' FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0)"


def passes(spark, d):
    p = t(spark, d, "part").where("p_partkey > 0")
    row = lambda df, a: df.selectExpr("concat('f', p_partkey div 2) AS fn", f"'{a}' AS param", "concat('f', p_partkey) AS callee", "'a' AS callee_param")
    return row(p, "a").union(row(p.where("p_partkey % 3 = 0"), "b"))


@query("SELECT fn, param FROM o", "RECURSIVE", PASSES, "o AS (SELECT 'f' || p_partkey AS fn, 'a' AS param FROM part WHERE p_partkey % 60 = 7 UNION SELECT passes.fn, passes.param FROM o JOIN passes ON callee = o.fn AND callee_param = o.param)")
def r12_return_params(spark, d):
    return flow.return_params(t(spark, d, "part").where("p_partkey % 60 = 7").selectExpr("concat('f', p_partkey) AS fn", "'a' AS param"), passes(spark, d))


@query("SELECT fn, param, kind, identity FROM o", "RECURSIVE", PASSES, "o AS (SELECT 'f' || p_partkey AS fn, 'a' AS param, 'FILE' AS kind, 'x' || (p_partkey % 4) AS identity FROM part WHERE p_partkey % 40 = 0 UNION SELECT passes.fn, passes.param, kind, identity FROM o JOIN passes ON callee = o.fn AND callee_param = o.param)")
def r13_param_sinks(spark, d):
    sinks = t(spark, d, "part").where("p_partkey % 40 = 0").selectExpr("concat('f', p_partkey) AS fn", "'a' AS param", "'FILE' AS kind", "concat('x', p_partkey % 4) AS identity")
    return flow.param_sinks(sinks, passes(spark, d))


@query(
    """SELECT 'f' || p_partkey AS source, 'f' || (p_partkey // 2) AS target, NULL::VARCHAR AS via, 'return' AS kind FROM part WHERE p_partkey % 10 = 0
UNION SELECT 'ENV:v' || (p_partkey % 3), 'FILE:x' || (p_partkey % 4), NULL, 'resource' FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 4 < 3
UNION SELECT 'f' || (p_partkey // 2), 'f' || (p_partkey + 1), 'arg:0', 'arg' FROM part WHERE p_partkey % 10 = 0
UNION SELECT 'ENV:v' || (p_partkey % 3), 'NET:h' || ((p_partkey + 1) % 2), NULL, 'resource' FROM part WHERE p_partkey % 10 = 0 AND (p_partkey + 1) % 3 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)"""
)
def r14_deferred_flows(spark, d):
    p = t(spark, d, "part")
    returns = p.where("p_partkey % 10 = 0").selectExpr("concat('f', p_partkey) AS fn", "'ENV' AS kind", "concat('v', p_partkey % 3) AS identity")
    edges = p.selectExpr("concat('f', p_partkey) AS callee", "concat('f', p_partkey div 2) AS caller")
    deferred = p.where("p_partkey % 4 < 3").selectExpr("concat('f', p_partkey) AS callee", "'FILE' AS kind", "concat('x', p_partkey % 4) AS identity")
    arguments = p.selectExpr("concat('f', p_partkey div 2) AS caller", "concat('f', p_partkey) AS pending", "concat('f', p_partkey + 1) AS callee", "'a' AS param", "'arg:0' AS via")
    sinks = p.where("p_partkey % 3 = 0").selectExpr("concat('f', p_partkey) AS fn", "'a' AS param", "'NET' AS kind", "concat('h', p_partkey % 2) AS identity")
    return flow.drain(returns, edges, deferred, arguments, sinks)


@query("SELECT callee, param, count(*) AS n FROM (SELECT l_partkey % 20 AS callee, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_linenumber = 2 THEN 'y' END ELSE CASE WHEN l_partkey % 20 < 10 AND l_linenumber - 1 > 1 THEN 'rest' ELSE ['x', 'rest', 'y'][l_linenumber] END END AS param FROM lineitem) GROUP BY callee, param")
def r15_bind_arguments(spark, d):
    calls = t(spark, d, "lineitem").selectExpr("l_partkey % 20 AS callee", "if(l_linenumber % 2 = 0, if(l_linenumber = 2, 'kw:y', 'kw:none'), concat('arg:', l_linenumber - 1)) AS via")
    params = spark.range(20).selectExpr("id AS fn", "array('x', 'rest', 'y') AS names", "if(id < 10, 1, null) AS variadic_index")
    return flow.bind_argument(calls, params).groupBy("callee", "param").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS report, ['/r/a.py:' || o_custkey || ':top', '/r/b.py:' || (o_orderkey % 50) || ':<lambda>'] AS frames, 'pkg.Error' || (o_orderkey % 3) AS exception, CASE WHEN o_orderkey % 2 = 0 THEN 'bad: ' || o_orderstatus ELSE '' END AS message FROM orders".replace("['/r/a.py", "array_to_string(['/r/a.py").replace(":<lambda>']", ":<lambda>'], ' ')"))
def t15_parse_tracebacks(spark, d):
    """W4 too: the last section of a chained report."""
    head = "Traceback (most recent call last):"
    text = F.concat_ws("\n", F.lit(head), F.lit('  File "/r/old.py", line 1, in old'), F.lit("ValueError: first"), F.lit(""), F.lit("During handling of the above exception, another exception occurred:"), F.lit(""), F.lit(head), F.expr("concat('  File \"/r/a.py\", line ', o_custkey, ', in top')"), F.lit("    go()"), F.expr("concat('  File \"/r/b.py\", line ', o_orderkey % 50, ', in <lambda>')"), F.expr("concat('pkg.Error', o_orderkey % 3, if(o_orderkey % 2 = 0, concat(': bad: ', o_orderstatus), ''))"))
    got = crash.parse_tracebacks(t(spark, d, "orders").select(F.col("o_orderkey").alias("report"), text.alias("text")))
    return got.select("report", F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["path"], f["line"].cast("string"), f["name"])), " ").alias("frames"), "exception", "message")


# Links


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 0 THEN 'api.v1' ELSE 'app' END AS receiver, m AS method, '/x/' || p_partkey AS template FROM part, (VALUES (0, 'GET'), (1, 'GET'), (1, 'POST'), (2, 'GET'), (3, 'DELETE')) v(r, m) WHERE r = p_partkey % 4")
def e1_route_decorators(spark, d):
    p = t(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then concat('@api.v1.get(\"/x/', p_partkey, '\", name=\"n\")') when 1 then concat('@app.route(\\'/x/', p_partkey, '\\', methods=[\"get\", \\'POST\\'])') when 2 then concat('@app.route( \"/x/', p_partkey, '\")') else concat('@delete(\"/x/', p_partkey, '\")') end AS decorator")
    return links.parse_route_decorators(p.union(p.selectExpr("p_partkey", "'@app.cached(\"/y\")'"))).select("p_partkey", "receiver", "method", "template")


URLS = "u AS (SELECT page_id, [x for x in string_split(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '/') if x <> ''] AS s FROM pages WHERE contains(url, '://'))"


@query("SELECT page_id, template, '/' || s[1] AS lead FROM u, (VALUES ('/1'), ('/2'), ('/7')) v(template) WHERE len(s) = 2 AND '/' || s[2] = template", URLS)
def e3_suffix_match(spark, d):
    templates = spark.createDataFrame([("/1",), ("/2",), ("/7",)], "template string")
    return links.match_templates(t(spark, d, "pages").select("page_id", "url"), templates).where("how = 'suffix'").select("page_id", "template", "lead")


@query("SELECT page_id, template, lead FROM u, (VALUES ('/api/en/{id}', 'en', '/api'), ('/v1/x/de/{id}', 'de', '/v1/x')) v(template, lang, lead) WHERE len(s) = 2 AND s[1] = lang", URLS)
def e4_mount_match(spark, d):
    templates = spark.createDataFrame([("/api/en/{id}",), ("/v1/x/de/{id}",), ("/{a}/fr/{id}",), ("/q/{a}/{id}",)], "template string")
    return links.match_templates(t(spark, d, "pages").select("page_id", "url"), templates).where("how = 'mount'").select("page_id", "template", "lead")


@query("SELECT page_id AS network, endpoint FROM u, (VALUES ('get', 'en'), ('any', 'de')) v(endpoint, lang) WHERE len(s) = 2 AND s[1] = lang", URLS)
def e7_link_endpoints(spark, d):
    """E5 and E6 too: a write doesn't answer a read, an endpoint without a project is open to all."""
    networks = t(spark, d, "pages").selectExpr("page_id AS network", "url", "array('READS_FROM') AS directions", "cast(array() as array<string>) AS caller_projects")
    endpoints = spark.createDataFrame([("get", "GET /en/{id}", None), ("post", "POST /en/{id}", None), ("any", "ANY /de/{id}", None), ("other", "GET /nowhere/else", "p")], "endpoint string, identity string, project string")
    return links.link_endpoints(networks, endpoints).select("network", "endpoint")


@query("SELECT src, rel_type, dst FROM edges WHERE NOT (rel_type = 'REFERENCES' AND src LIKE '%3') UNION SELECT id, 'REFERENCES', 's1' FROM nodes WHERE label = 'Function' AND id LIKE '%3'", NODES, EDGES)
def e8_relink(spark, d):
    g = graph(spark, d)
    sources = g.labelled("Function").where(F.col("id").endswith("3")).select("id")
    return merge.relink(g.edges.select("src", "rel_type", "dst"), "REFERENCES", sources, sources.select(F.col("id").alias("src"), F.lit("REFERENCES").alias("rel_type"), F.lit("s1").alias("dst")), g.rows)


# Upkeep


@query("SELECT DISTINCT src, rel_type, dst, via, kind FROM (SELECT 'p' || l_partkey AS src, 'FLOWS_TO' AS rel_type, 's' || l_suppkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'arg:' || (l_linenumber % 3) END AS via, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS kind FROM lineitem)")
def m3_parallel_edges(spark, d):
    line = t(spark, d, "lineitem").selectExpr("concat('p', l_partkey) AS src", "'FLOWS_TO' AS rel_type", "concat('s', l_suppkey) AS dst", "if(l_linenumber % 2 = 0, concat('arg:', l_linenumber % 3), null) AS via", "if(l_returnflag <> 'N', l_returnflag, null) AS kind")
    return merge.merge_edges(line, graph(spark, d).nodes.select("id"), line.count())


@query("SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM edges WHERE rel_type = 'CONTAINS_MODULE' UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY src, dst", EDGES)
def m4_create_edges(spark, d):
    g = graph(spark, d)
    batch = t(spark, d, "customer").where("c_custkey % 4 = 0").selectExpr("concat('n', c_nationkey) AS src", "'CONTAINS_MODULE' AS rel_type", "concat('c', c_custkey) AS dst")
    lost = batch.selectExpr("'nowhere' AS src", "rel_type", "dst")
    made = merge.append_edges(g.typed("CONTAINS_MODULE").select("src", "rel_type", "dst"), batch.union(lost), g.nodes.select("id"))
    return made.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(key) AS written, count(*) - count(key) AS skipped FROM (SELECT label, CASE label WHEN 'Project' THEN name WHEN 'Module' THEN CASE WHEN flow_covered THEN qualified_name END ELSE path END AS key FROM nodes) GROUP BY label", NODES)
def m5_rows_without_key(spark, d):
    n = graph(spark, d).nodes.withColumn("covered_qn", F.when(F.col("flow_covered"), F.col("qualified_name")))
    return merge.with_and_without_key(n, {"Project": "name", "Module": "covered_qn", "Package": "path", "Class": "path", "Function": "path"})


@query(
    "SELECT 'r' || r_regionkey AS id FROM region UNION SELECT id FROM f WHERE id NOT IN (SELECT dst FROM own GROUP BY dst HAVING count(DISTINCT r) > 1) AND (ab IS NOT NULL)",
    "RECURSIVE",
    "e AS (SELECT DISTINCT 'r' || (p_partkey % 5) AS src, 'd' || (p_partkey % 30) AS dst FROM part UNION SELECT 'r' || ((p_partkey + 1) % 5), 'd' || (p_partkey % 30) FROM part WHERE p_partkey % 30 % 7 = 0 UNION SELECT 'd' || (p_partkey % 30), 'p' || p_partkey FROM part)",
    "f AS (SELECT DISTINCT 'd' || (p_partkey % 30) AS id, 'x' AS ab FROM part UNION SELECT 'p' || p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN 'x' END FROM part)",
    "own AS (SELECT src AS r, dst FROM e WHERE src LIKE 'r%' UNION SELECT r, e.dst FROM own JOIN e ON e.src = own.dst)",
)
def m10_purge_shared(spark, d):
    p = t(spark, d, "part")
    nodes = p.selectExpr("concat('d', p_partkey % 30) AS id", "'Folder' AS label", "'x' AS absolute_path").distinct().union(p.selectExpr("concat('p', p_partkey)", "'File'", "if(p_partkey % 13 <> 0, 'x', null)")).union(t(spark, d, "region").selectExpr("concat('r', r_regionkey)", "'Project'", "cast(null as string)"))
    edges = p.selectExpr("concat('r', p_partkey % 5) AS src", "'CONTAINS_FOLDER' AS rel_type", "concat('d', p_partkey % 30) AS dst").union(p.where("p_partkey % 30 % 7 = 0").selectExpr("concat('r', (p_partkey + 1) % 5)", "'CONTAINS_FOLDER'", "concat('d', p_partkey % 30)")).distinct()
    edges = edges.union(p.selectExpr("concat('d', p_partkey % 30)", "'CONTAINS_FILE'", "concat('p', p_partkey)"))
    return merge.purge_shared(Graph(nodes, edges)).nodes.select("id")


@query("SELECT id FROM nodes WHERE NOT (label = 'Package' AND name LIKE '%3') AND id NOT IN (SELECT dst FROM edges JOIN nodes n ON n.id = src WHERE rel_type IN ('CONTAINS_MODULE', 'DEFINES') AND n.label = 'Package' AND n.name LIKE '%3')", NODES, EDGES)
def m11_prune_vanished(spark, d):
    """M8 too: a folder goes with what it contains."""
    g = graph(spark, d)
    listing = g.nodes.where("not (label = 'Package' and name like '%3')").select("path").where("path is not null")
    return merge.prune_vanished(g, listing, ["CONTAINS_PACKAGE", "CONTAINS_MODULE", "DEFINES"], ("Package",)).nodes.select("id")


@query("SELECT rel_type, count(*) AS n FROM edges WHERE NOT (src LIKE 'c%' AND CAST(substr(src, 2) AS BIGINT) % 10 = 0) AND NOT (dst LIKE 'c%' AND CAST(substr(dst, 2) AS BIGINT) % 10 = 0 AND CAST(substr(dst, 2) AS BIGINT) % 20 <> 0) GROUP BY rel_type", EDGES)
def x5_reparse_files(spark, d):
    """M14 too: the edges into what was parsed anew come back, those into what is gone don't."""
    g = graph(spark, d)
    mine = g.labelled("Module").withColumn("k", F.expr("cast(substr(id, 2) as bigint)"))
    parsed = mine.where("k % 20 = 0").drop("k")
    after = merge.replace_files(g, mine.where("k % 10 = 0").select("path"), Graph(parsed, g.edges.limit(0)), ["DEFINES"])
    return after.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


# Vectors


@query("SELECT 'p' || vec_id AS id, qualified_name, name, label AS type, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 3) AS score FROM (SELECT * FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20) e JOIN (SELECT * EXCLUDE (label), label FROM nodes) n ON n.id = 'p' || vec_id".replace("label AS type", "n.label AS type"), NODES, QUERY_VECTOR)
def v5_semantic_search(spark, d):
    e = t(spark, d, "embeddings")
    hits = search.top_k(e.select("vec_id", "embedding"), e.where("vec_id = 7").first()["embedding"], 20)
    return search.semantic_hits(hits.select(F.concat(F.lit("p"), "vec_id").alias("id"), "score"), graph(spark, d).nodes)


@query("SELECT DISTINCT dst AS id, b.qualified_name, b.start_line, b.end_line, a.path FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE rel_type = 'CALLS'", NODES, EDGES)
def v6_embedding_candidates(spark, d):
    g = graph(spark, d)
    return search.embedding_candidates(g.nodes, g.typed("CALLS").select("src", "dst"), g.rows)


@query("SELECT id FROM nodes WHERE string_split(qualified_name, '.')[1] NOT IN ('ASIA', 'EUROPE')", NODES)
def v3_delete_by_project(spark, d):
    gone = spark.createDataFrame([("ASIA",), ("EUROPE",)], "project string")
    return search.without_projects(graph(spark, d).nodes.select("id", "qualified_name"), gone).select("id")


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'de') > 200 AS more FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 200")
def l6_structural_cap(spark, d):
    return search.structural_cap(t(spark, d, "documents").where("lang = 'de'").select("doc_id"), ["doc_id"])
