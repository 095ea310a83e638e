"""Result limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, cost: str, budget: int, order: list[str], by: list[str]) -> DataFrame:
    """The first rows of each group whose costs fit the budget together: the first row always, then up to the first that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(*order)
    over = (F.sum(cost).over(w) > budget) & (F.row_number().over(w) > 1)
    return rows.withColumn("_over", over).withColumn("_stopped", F.max("_over").over(w)).where(~F.col("_stopped")).drop("_over", "_stopped")
