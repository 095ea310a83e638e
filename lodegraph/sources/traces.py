"""Trace files: one header line, then call records, as JSON lines; and sampled profiles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "struct<path: string, qualname: string, line: string>"
LINE = f"kind string, version string, language string, repo_root string, tracer string, sampled string, caller {_POINT}, callee {_POINT}, count string, workloads array<string>, receiver_types array<string>"
_WHOLE = r"^\d+$"


def read_trace(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, records). A record with a missing name, or a line or count that isn't a whole number (a boolean isn't one), fails the read."""
    rows = spark.read.schema(LINE).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    head = rows.where("kind = 'header'").select("version", "language", "repo_root", "tracer", F.coalesce(F.col("sampled") == "true", F.lit(False)).alias("sampled")).head(2)
    if len(head) != 1 or head[0]["version"] != "1":
        raise ValueError("a trace has one header line, of version 1")
    point = lambda c: F.col(f"{c}.path").isNotNull() & F.col(f"{c}.qualname").isNotNull() & F.col(f"{c}.line").rlike(_WHOLE)
    good = F.coalesce(point("caller") & point("callee") & F.col("count").rlike(_WHOLE) & (F.col("count").cast("long") >= 1), F.lit(False))
    checked = rows.where("kind is distinct from 'header'").where(F.when(good, True).otherwise(F.raise_error(F.lit("a trace record is malformed")).cast("boolean")))
    typed = lambda c: F.struct(F.col(f"{c}.path").alias("path"), F.col(f"{c}.qualname").alias("qualname"), F.col(f"{c}.line").cast("long").alias("line")).alias(c)
    none = F.array().cast("array<string>")
    return head[0].asDict(), checked.select(typed("caller"), typed("callee"), F.col("count").cast("long").alias("count"), F.coalesce("workloads", none).alias("workloads"), F.coalesce("receiver_types", none).alias("receiver_types"))


def write_trace(records: DataFrame, path: str, language: str, repo_root: str, tracer: str, sampled: bool = False) -> None:
    header = json.dumps({"kind": "header", "version": 1, "language": language, "repo_root": repo_root, "tracer": tracer, "sampled": sampled})
    lines = records.select(F.to_json(F.struct(F.lit("call").alias("kind"), *records.columns)).alias("value"))
    records.sparkSession.createDataFrame([(header,)], "value string").union(lines).write.mode("overwrite").text(path)


SAMPLE = "profile string, sample_id long, depth int, name string, file string, line long, weight double"


def speedscope_samples(files: DataFrame) -> DataFrame:
    """files (path, text) of speedscope profiles to one row for each frame of each stack, root first: sampled profiles by
    their weights (one that isn't positive counts as 1), evented ones as the time between two events of the open stack."""

    def stacks(doc: dict) -> Iterator[tuple[list[int], float]]:
        for p in doc.get("profiles", []):
            if p.get("type") == "sampled":
                weights = p.get("weights") or [1] * len(p["samples"])
                for s, w in zip(p["samples"], weights, strict=False):
                    yield s, w if w > 0 else 1
            elif p.get("type") == "evented":
                open_, last = [], p.get("startValue", 0)
                for e in p["events"]:
                    if open_ and e["at"] > last:
                        yield list(open_), e["at"] - last
                    last = e["at"]
                    if e["type"] == "O":
                        open_.append(e["frame"])
                    elif e["frame"] in open_:
                        del open_[len(open_) - 1 - open_[::-1].index(e["frame"]) :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                doc = json.loads(text)
                frames = doc.get("shared", {}).get("frames", [])
                for i, (s, w) in enumerate(stacks(doc)):
                    rows += [(path, i, d, frames[f].get("name"), frames[f].get("file"), frames[f].get("line"), float(w)) for d, f in enumerate(s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLE.split(", ")]).astype({"line": "Int64"})

    return files.select("path", "text").mapInPandas(run, SAMPLE)


EDGE = "profile string, caller string, callee string, caller_file string, callee_file string, caller_line long, callee_line long, count long"


def cpuprofile_edges(files: DataFrame, project_root: str) -> DataFrame:
    """files (path, text) of V8 CPU profiles to weighted calls between frames of the project. A node weighs the samples of its
    whole subtree, one at least; its caller is the nearest node above it whose url is below the project's root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                doc = json.loads(text)
                nodes = {n["id"]: n for n in doc["nodes"]}
                parent: dict[int, int] = {}
                for n in doc["nodes"]:
                    for c in n.get("children", []):
                        if c in parent or c not in nodes:
                            raise ValueError("the nodes of a profile are no forest")
                        parent[c] = n["id"]
                weight = {i: n.get("hitCount", 0) for i, n in nodes.items()}
                order, todo = [], [i for i in nodes if i not in parent]
                while todo:
                    i = todo.pop()
                    order.append(i)
                    todo += nodes[i].get("children", [])
                if len(order) != len(nodes):
                    raise ValueError("the nodes of a profile are no forest")
                for i in reversed(order):
                    if i in parent:
                        weight[parent[i]] += weight[i]
                mine = {i: n["callFrame"]["url"].removeprefix("file://").startswith(project_root.rstrip("/") + "/") for i, n in nodes.items()}
                above: dict[int, int | None] = {}
                for i in order:
                    p = parent.get(i)
                    above[i] = None if p is None else p if mine[p] else above[p]
                for i in order:
                    if mine[i] and above[i] is not None:
                        a, c = nodes[above[i]]["callFrame"], nodes[i]["callFrame"]
                        rows.append((path, a["functionName"], c["functionName"], a["url"].removeprefix("file://"), c["url"].removeprefix("file://"), a["lineNumber"] + 1, c["lineNumber"] + 1, max(weight[i], 1)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGE.split(", ")])

    return files.select("path", "text").mapInPandas(run, EDGE).groupBy("profile", "caller", "callee", "caller_file", "callee_file", "caller_line", "callee_line").agg(F.sum("count").alias("count"))
