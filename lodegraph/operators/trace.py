"""Runtime traces: frames to nodes, and call records to weighted edges.

Nodes are callables (id, label, qualified_name, path, start_line, end_line) with modules among them; frames
are (path, qualname, line) columns of the records. A frame resolves by the file, then by the innermost span
among definitions of its name, else the smallest of these names, else the innermost span of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.resolve import first_definition

# Names of frames that stand for a module, for local scopes, and the begin of synthetic ones.
MODULE, LOCALS, SYNTHETIC = "<module>", "<locals>", "<"
MAX_WORKLOADS, MAX_RECEIVERS = 20, 10


def repo_relative(path: Column, root: str) -> Column:
    """The path below the repository root; null outside of it. A relative path is below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).when(~path.startswith("/"), path)


def resolve(frames: DataFrame, nodes: DataFrame, root: str, dotted: bool = True) -> DataFrame:
    """frames (frame_id, path, qualname, line) to (frame_id, label, qualified_name, reason).

    dotted: qualnames are scope chains (Python); else bare names (JavaScript, Go and others), where frames
    without a name resolve by their span alone.
    """
    f = frames.withColumn("rel", repo_relative(F.col("path"), root))
    names = F.filter(F.split("qualname", r"\."), lambda p: p != LOCALS)
    is_module = (F.array_join(names, ".") == MODULE) if dotted else (F.col("qualname") == MODULE)
    synthetic = F.exists(names, lambda p: p.startswith(SYNTHETIC)) & ~is_module
    f = f.withColumn("suffix", F.concat(F.lit("."), F.array_join(names, "."))).withColumn("module", is_module).withColumn("synthetic", synthetic)
    modules = nodes.where("label = 'Module'").groupBy(F.col("path").alias("rel")).agg(F.max(F.struct("qualified_name", "label")).alias("m"))
    code = nodes.where("label <> 'Module'").select(F.col("path").alias("rel"), F.col("label").alias("n_label"), F.col("qualified_name").alias("n_qn"), "start_line", "end_line")
    known = code.select("rel").distinct().withColumn("has_code", F.lit(True))
    f = f.join(modules, "rel", "left").join(known, "rel", "left")
    look = F.col("has_code") & ~F.col("module") & (F.lit(True) if not dotted else ~F.col("synthetic"))
    met = f.where(look).select("frame_id", "rel", "suffix", "synthetic", "line").join(code, "rel")
    natural = first_definition(F.col("n_qn"))
    named = natural.endswith(F.col("suffix")) if dotted else ((F.concat(F.lit("."), F.substring_index(natural, ".", -1)) == F.col("suffix")) & ~F.col("synthetic"))
    holds = F.coalesce((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")), F.lit(False))
    tier = F.when(named & holds, 1).when(named, 2).when(holds, 3)
    met = met.withColumn("tier", tier).where("tier is not null")
    order = Window.partitionBy("frame_id").orderBy("tier", F.when(F.col("tier") != 2, -F.col("start_line")), "n_qn")
    best = met.withColumn("k", F.row_number().over(order)).where("k = 1").select("frame_id", "n_label", "n_qn")
    out = f.join(best, "frame_id", "left")
    found = F.when(F.col("module"), F.col("m.qualified_name")).otherwise(F.col("n_qn"))
    reason = F.when(F.col("rel").isNull(), "outside_repo").when(F.col("module"), "unknown_path").when(F.lit(dotted) & F.col("synthetic"), "synthetic").when(F.col("has_code").isNull(), "unknown_path").otherwise("no_match")
    return out.select("frame_id", F.when(F.col("module"), F.col("m.label")).otherwise(F.col("n_label")).alias("label"), found.alias("qualified_name"), F.when(found.isNull(), reason).alias("reason"))


def edge_statistics(rows: DataFrame) -> DataFrame:
    """rows (caller, callee, count, workloads, receiver_types) to one row a pair: counts add up, sets unite, lists are sorted and cut after counting."""
    pair = ["caller", "callee"]

    def first(column: str, most: int, n: str, values: str) -> DataFrame:
        """Distinct values combine before they shuffle, and an edge with many keeps a rank's worth of them in one place."""
        each = rows.select(*pair, F.explode(column).alias("v")).distinct()
        rank = Window.partitionBy(*pair).orderBy("v")
        kept = each.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= most).groupBy(*pair).agg(F.sort_array(F.collect_list("v")).alias(values))
        return each.groupBy(*pair).agg(F.count(F.lit(1)).alias(n)).join(kept, pair)

    none = F.array().cast("array<string>")
    e = rows.groupBy(*pair).agg(F.sum("count").alias("dynamic_call_count")).join(first("workloads", MAX_WORKLOADS, "n_w", "w"), pair, "left").join(first("receiver_types", MAX_RECEIVERS, "n_r", "r"), pair, "left")
    return e.select(*pair, "dynamic_call_count", F.coalesce("n_w", F.lit(0).cast("long")).alias("dynamic_workload_count"), F.coalesce("w", none).alias("dynamic_workloads"), F.coalesce("r", none).alias("dynamic_receiver_types"))


def ingest(records: DataFrame, nodes: DataFrame, static_calls: DataFrame, root: str, sampled: bool = False, dotted: bool = True) -> tuple[DataFrame, DataFrame]:
    """records (caller, callee: structs of path, qualname, line; count, workloads, receiver_types) to (edges, unresolved by reason).

    A caller that doesn't resolve is counted and its callee isn't tried. static_calls (from_qn, to_qn) leaves
    out edges that a trace made. The result sets properties and adds nothing up, so a second run changes nothing.
    """
    r = records.withColumn("rid", F.monotonically_increasing_id())
    frames = r.select(F.explode(F.array("caller", "callee")).alias("f")).select("f.path", "f.qualname", "f.line").distinct()
    frames = frames.withColumn("frame_id", F.xxhash64("path", "qualname", "line"))
    found = resolve(frames, nodes, root, dotted)
    side = lambda x: found.select(F.col("frame_id").alias(f"{x}_id"), F.col("qualified_name").alias(f"{x}_qn"), F.col("label").alias(f"{x}_label"), F.col("reason").alias(f"{x}_reason"))
    fid = lambda x: F.xxhash64(f"{x}.path", f"{x}.qualname", f"{x}.line")
    both = r.withColumn("caller_id", fid("caller")).withColumn("callee_id", fid("callee")).join(side("caller"), "caller_id").join(side("callee"), "callee_id")
    failed = both.select(F.coalesce("caller_reason", "callee_reason").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = both.where("caller_qn is not null and callee_qn is not null")
    edges = edge_statistics(good.select(F.struct("caller_label", "caller_qn").alias("caller"), F.struct("callee_label", "callee_qn").alias("callee"), "count", "workloads", "receiver_types"))
    known = static_calls.select("from_qn", "to_qn").distinct().withColumn("known", F.lit(True))
    edges = edges.select(F.col("caller.caller_label").alias("src_label"), F.col("caller.caller_qn").alias("from_qn"), F.lit("CALLS").alias("rel_type"), F.col("callee.callee_label").alias("dst_label"), F.col("callee.callee_qn").alias("to_qn"), *[c for c in edges.columns if c.startswith("dynamic")])
    return edges.join(known, ["from_qn", "to_qn"], "left").withColumn("dynamic", F.lit(True)).withColumn("static_missed", F.col("known").isNull()).withColumn("dynamic_sampled", F.lit(sampled)).drop("known"), failed


def weighted_edges(samples: DataFrame) -> DataFrame:
    """samples (sample_id, depth, name, weight), root first and a null name for frames outside the project, to (caller, callee,
    count): each named frame is called by the nearest named one above; a weight that isn't positive counts as 1."""
    above = Window.partitionBy("sample_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1)
    rows = samples.withColumn("caller", F.last("name", ignorenulls=True).over(above)).where("name is not null and caller is not null")
    return rows.groupBy("caller", F.col("name").alias("callee")).agg(F.sum(w).alias("count"))
