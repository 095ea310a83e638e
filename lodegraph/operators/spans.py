"""Points in spans: the range join of frames to definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a bucket in which spans and points meet; a span is in every bucket that it covers.
BUCKET = 64


def innermost(points: DataFrame, spans: DataFrame, tightest: bool = False, bucket: int | None = None) -> DataFrame:
    """points (file, at, …) with the span (file, span, s, e) that holds them: the one that starts last, or with
    tightest the shortest; on ties the greater, or smaller, span id. Points in no span are left out.

    The join is by file and bucket of the position, so a file with many spans is split over tasks. Without a
    bucket the width comes from the mean length of the spans, so that a span is in few buckets.
    """
    if bucket is None:
        mean = spans.agg(F.avg(F.col("e") - F.col("s"))).first()[0] or 0
        bucket = max(BUCKET, int(mean))
    inside = spans.select("file", "span", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))).alias("_b")).where("s <= e")
    keys = points.columns
    met = points.withColumn("_b", F.floor(F.col("at") / bucket)).join(inside, ["file", "_b"]).where("s <= at and at <= e")
    best = F.min_by("span", F.struct(F.col("e") - F.col("s"), "span")) if tightest else F.max_by("span", F.struct("s", "span"))
    return met.groupBy(*keys).agg(best.alias("span"))
