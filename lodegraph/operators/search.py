"""Vector and text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import dealt, side


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def top_k(rows: DataFrame, query: list[float], k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows with their score, of equal ones the smaller id. Filters go before the ranking, so it is exact."""
    q = F.array(*[F.lit(float(v)) for v in query])
    score = cosine(F.col(vector).cast("array<double>"), q)
    return rows.select(id_, score.alias("score")).orderBy(F.desc("score"), id_).limit(k)


def cached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (id, text) with the vectors of a cache (hash, embedding) by the hash of the content; null where there is none."""
    return texts.withColumn("hash", F.sha2("text", 256)).join(cache, "hash", "left")


def grep(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows with matches, and how many."""
    return rows.withColumn("n", F.regexp_count(text, F.lit(pattern)).cast("long")).where("n > 0").drop(text)


def findings(modules: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """modules (qualified_name, text), rules (rule, label, regex) to (key, label, rule, line, col, snippet): every match by
    line, with an identity of module, line, column and rule and at most 200 characters of the line."""
    lines = modules.select("qualified_name", F.posexplode(F.split("text", "\n")).alias("at", "line_text"))
    out = None
    for rule, label, regex in rules:
        hit = lines.where(F.col("line_text").rlike(regex)).select("qualified_name", F.lit(rule).alias("rule"), F.lit(label).alias("label"), (F.col("at") + 1).alias("line"), (F.length(F.split("line_text", regex, 2)[0]) + 1).alias("col"), F.substring("line_text", 1, 200).alias("snippet"))
        out = hit if out is None else out.union(hit)
    return out.select(F.concat_ws(".", "qualified_name", "line", "col", "rule").alias("key"), "label", "rule", "line", "col", "snippet")


def semantic_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits (id, score) with their nodes (id, qualified_name, name, label), in the hits' order; hits without a node are left out."""
    met = hits.join(nodes.select("id", "qualified_name", "name", "label"), "id")
    return met.select("id", "qualified_name", "name", F.coalesce("label", F.lit("Unknown")).alias("type"), F.round("score", 3).alias("score")).orderBy(F.desc(met["score"]), "id")


def scoped_hits(vectors: DataFrame, prefix: str, k: int) -> DataFrame:
    """vectors (id, qualified_name, score): the k best below a project's name, filtered before the ranking."""
    return vectors.where(F.col("qualified_name").startswith(prefix)).orderBy(F.desc("score"), "id").limit(k)


def without_projects(vectors: DataFrame, projects: DataFrame) -> DataFrame:
    """vectors (id, qualified_name, …) without those of the projects (project)."""
    gone = projects.select("project").distinct()
    return vectors.join(gone, F.split("qualified_name", r"\.")[0] == F.col("project"), "left_anti")


def embedding_candidates(nodes: DataFrame, defines: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, qualified_name, start_line, end_line, path) of the functions and methods that modules define (src, dst), with their spans.
    rows: of defines at most, where known."""
    modules = nodes.where("label = 'Module'").select(F.col("id").alias("src"), F.col("path").alias("module_path"))
    code = nodes.where(F.col("label").isin("Function", "Method")).select(F.col("id").alias("dst"), "qualified_name", "start_line", "end_line")
    met = dealt(dealt(defines, rows, "src").join(side(modules), "src"), rows, "dst").join(side(code), "dst")
    got = met.select(F.col("dst").alias("id"), "qualified_name", "start_line", "end_line", F.col("module_path").alias("path"))
    return dealt(got, rows, *got.columns).distinct()


def structural_cap(rows: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """The first matches of a structural search, and whether there are more."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(n)).withColumn("more", F.col("n") > most).drop("n")
