"""Differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, delta): added, removed and changed rows; delta maps a changed field to its old and new value as text. Nulls are equal to nulls."""
    fields = [c for c in old.columns if c not in keys]
    side = lambda df, s: df.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in fields], F.lit(1).alias("_")).alias(s))
    both = side(old, "old").join(side(new, "new"), keys, "full")
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.struct(F.col(f"old.{c}").alias("old"), F.col(f"new.{c}").alias("new")) for c in fields]))
    delta = F.map_filter(pairs, lambda k, v: ~v["old"].eqNullSafe(v["new"]))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size(delta) > 0, "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", delta).alias("delta")).where("change is not null")


def coverage_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Modules (key, flow_covered) that are in both and whose flag differs; an absent flag is false."""
    flag = lambda df, n: df.select("key", F.coalesce("flow_covered", F.lit(False)).alias(n))
    return flag(old, "old").join(flag(new, "new"), "key").where("old <> new")


def check_schema_hashes(old: dict, new: dict) -> None:
    """Two snapshots compare only if both manifests name the same schema."""
    if not old.get("schema_hash") or not new.get("schema_hash"):
        raise ValueError("a snapshot has no schema hash")
    if old["schema_hash"] != new["schema_hash"]:
        raise ValueError("the snapshots have different schemas")
