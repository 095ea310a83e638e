"""Data-flow verdicts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.fixpoint import shortest_paths
from lodegraph.storage import cut, side, together


def verdict(flows: DataFrame, gaps: DataFrame, source: str, sink: str) -> tuple[str, list[str], list[str]]:
    """(FOUND, path, []), (UNKNOWN, [], gaps) or (NO_FLOW, [], []). flows (source, target), gaps (path). A path has an edge at
    least, so a source that is its own sink is found only on a cycle."""
    spark = flows.sparkSession
    edges = flows.where("source is not null and target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    if source == sink:  # the sink becomes a node of its own, so the way back to it has an end
        edges = edges.union(edges.where(F.col("dst") == sink).select("src", F.lit("\0").alias("dst")))
    goal = "\0" if source == sink else sink
    found = shortest_paths(spark.createDataFrame([(source,)], "id string"), edges).where(F.col("id") == goal).select("path").head()
    if found:
        return "FOUND", [*found["path"][:-1], sink], []
    missing = sorted(r["path"] for r in gaps.where("path is not null").select("path").collect())  # what the caller is shown
    return ("UNKNOWN", [], missing) if missing else ("NO_FLOW", [], [])


def coverage_gaps(modules: DataFrame, project: str) -> DataFrame:
    """(path) of the project's modules that flow analysis doesn't cover, sorted."""
    qn = F.col("qualified_name")
    mine = (qn == project) | qn.startswith(f"{project}.")
    return modules.where(mine & ~F.coalesce("flow_covered", F.lit(False))).select("path").orderBy("path")


def spread(facts: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """Least fixpoint of facts (fn, <on>) that also hold for every caller: calls (caller, callee) carry them from callee to
    caller. Only what the last round added is joined again."""
    seen = cut(facts.select("fn", *on).distinct())
    front = seen
    while True:
        step = front.join(calls, front["fn"] == calls["callee"]).select(F.col("caller").alias("fn"), *on).distinct()
        front = cut(step.join(seen, ["fn", *on], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front))


def return_origins(origins: DataFrame, pending: DataFrame) -> DataFrame:
    """origins (fn, kind, identity), pending (fn, callee): what a function returns from its callees' returns."""
    return spread(origins, pending.select(F.col("fn").alias("caller"), "callee"), ["kind", "identity"])


def param_sinks(sinks: DataFrame, passes: DataFrame) -> DataFrame:
    """sinks (fn, param, kind, identity), passes (fn, param, callee, callee_param): the sinks that a parameter reaches through calls."""
    key = lambda f, p: F.concat_ws("\0", f, p)
    got = spread(sinks.select(key("fn", "param").alias("fn"), "kind", "identity"), passes.select(key("fn", "param").alias("caller"), key("callee", "callee_param").alias("callee")), ["kind", "identity"])
    return got.select(F.split("fn", "\0")[0].alias("fn"), F.split("fn", "\0")[1].alias("param"), "kind", "identity")


def bind_argument(calls: DataFrame, params: DataFrame) -> DataFrame:
    """calls (callee, via), params (fn, names, variadic_index) to (…, param): "arg:i" by place, clamped to a variadic one, "kw:name" by name."""
    at = F.regexp_extract("via", r"^arg:(\d+)$", 1).cast("int")
    place = F.when(F.col("variadic_index").isNotNull() & (at > F.col("variadic_index")), F.col("variadic_index")).otherwise(at)
    name = F.regexp_extract("via", "^kw:(.+)$", 1)
    met = calls.join(params.withColumnRenamed("fn", "callee"), "callee")
    return met.select(*calls.columns, F.when(F.col("via").startswith("kw:"), F.when(F.array_contains("names", name), name)).otherwise(F.get("names", place)).alias("param"))


def return_params(direct: DataFrame, passes: DataFrame) -> DataFrame:
    """direct (fn, param) that a function returns, passes (fn, param, callee, callee_param) whose result it returns, to all (fn, param) that reach the return."""
    key = lambda f, p: F.concat_ws("\0", f, p)
    got = spread(direct.select(key("fn", "param").alias("fn"), F.lit(True).alias("returned")), passes.select(key("fn", "param").alias("caller"), key("callee", "callee_param").alias("callee")), ["returned"])
    return got.select(F.split("fn", "\0")[0].alias("fn"), F.split("fn", "\0")[1].alias("param"))


def drain(returns: DataFrame, return_edges: DataFrame, deferred: DataFrame, arguments: DataFrame, sinks: DataFrame) -> DataFrame:
    """The FLOWS_TO edges (source, target, via, kind) of what was put off until all summaries are known.

    returns (fn, kind, identity): origins of every function's result; return_edges (callee, caller); deferred (callee, kind, identity): a callee's
    result that goes into a resource; arguments (caller, pending, callee, param, via): the result of pending as an argument; sinks (fn, param, kind, identity).
    """
    resource = lambda k, i: F.concat_ws(":", k, i)
    origin = returns.select(F.col("fn").alias("of"), resource("kind", "identity").alias("source")).distinct()
    tainted = origin.select("of").distinct()
    no = F.lit(None).cast("string")
    back = return_edges.join(tainted, return_edges["callee"] == tainted["of"]).select(F.col("callee").alias("source"), F.col("caller").alias("target"), no.alias("via"), F.lit("return").alias("kind"))
    into = deferred.join(origin, deferred["callee"] == origin["of"]).select("source", resource("kind", "identity").alias("target"), no, F.lit("resource"))
    passed = arguments.join(tainted, arguments["pending"] == tainted["of"]).select(F.col("caller"), F.col("callee"), "via", F.lit("arg"))
    reach = arguments.join(origin, arguments["pending"] == origin["of"]).select("source", F.col("callee").alias("fn"), "param").join(sinks, ["fn", "param"]).select("source", resource("kind", "identity"), no, F.lit("resource"))
    return back.union(into).union(passed).union(reach).distinct()


def verdicts(pairs: DataFrame, flows: DataFrame, gaps: DataFrame) -> DataFrame:
    """pairs (source, sink) to (source, sink, verdict, length): FOUND with the least number of edges, else UNKNOWN if the project has a
    gap in its coverage, else NO_FLOW. All pairs walk together, and a pair that has met its sink stops. Only what is counted and short is
    broadcast."""
    edges = cut(flows.where("source is not null and target is not null").select(F.col("source").alias("at"), F.col("target").alias("to")).distinct())
    left = cut(pairs.select("source", "sink").distinct())
    front, seen, met, length = cut(left.select("source").distinct().withColumn("at", F.col("source"))), [], [], 0
    rows, n_seen = front.count(), 0
    while rows:
        length += 1
        step = side(front, rows).join(edges, "at").select("source", F.col("to").alias("at")).distinct()
        front = cut(step.join(side(together(seen), n_seen), ["source", "at"], "left_anti") if seen else step)
        rows = front.count()
        seen, n_seen = [*seen, front], n_seen + rows
        if len(seen) > 8:
            seen = [cut(together(seen))]
        now = cut(left.join(side(front.withColumnRenamed("at", "sink"), rows), ["source", "sink"], "left_semi").withColumn("length", F.lit(length)))
        if n_met := now.count():
            met = [*met, now] if len(met) < 8 else [cut(together([*met, now]))]
            left = cut(left.join(side(now, n_met), ["source", "sink"], "left_anti"))
            walking = cut(left.select("source").distinct())
            front = cut(front.join(side(walking, walking.count()), "source", "left_semi"))
            rows = front.count()
    covered = gaps.where("path is not null").limit(1).isEmpty()
    none = left.select("source", "sink", F.lit("NO_FLOW" if covered else "UNKNOWN").alias("verdict"), F.lit(None).cast("int").alias("length"))
    return together([*[m.select("source", "sink", F.lit("FOUND").alias("verdict"), "length") for m in met], none])
