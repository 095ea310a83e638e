"""Precision, recall and location scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_sets(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Sets of (category, key) to tp, fp, fn, precision, recall, f1 by category; no row for an empty one, 0 where a denominator is 0."""
    both = found.distinct().withColumn("f", F.lit(1)).join(expected.distinct().withColumn("x", F.lit(1)), ["category", "key"], "full")
    n = both.groupBy("category").agg(F.count_if(F.col("f").isNotNull() & F.col("x").isNotNull()).alias("tp"), F.count_if(F.col("x").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def location_statistics(rows: DataFrame) -> DataFrame:
    """rows (found, expected) to counts of exact and near hits and the mean and greatest difference."""
    x = F.abs(F.col("found") - F.col("expected"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(x == 0).alias("exact"), F.count_if(x <= 1).alias("within_one"), F.round(F.avg(x), 6).alias("mean_delta"), F.max(x).alias("max_delta"))


def recall_at_k(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """ranked (query, item, score, position), expected (query, item): hits among the k best by score, ties in input order."""
    from pyspark.sql import Window

    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "position"))).where(F.col("_r") <= k)
    wanted = expected.select("query", "item").distinct()
    hits = wanted.join(best.select("query", "item").distinct(), ["query", "item"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return wanted.agg(F.count(F.lit(1)).alias("expected")).crossJoin(hits).select("hits", "expected", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).otherwise(0.0).alias("recall"))  # one row each
