"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_tasks, side


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of longs, in any direction, to (id, root): one row for each id that isn't the smallest of its component.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most. A round
    reads edges only, in aggregates that combine before they shuffle; nothing reaches the driver but two
    numbers that tell whether the edges changed, and rounds of few edges. The result is a side() of joins.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    cur = scratch.write(few_tasks(edges.where("a <> b").select(big.alias("u"), small.alias("v")).distinct()), "edges")
    before = None
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            return side(cur.select(F.col("u").alias("id"), F.col("v").alias("root")), now[0])
        before = tuple(now)
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # used twice below, from one exchange
        large = both.where("v > u").join(side(least, now[0]), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(side(low, now[0]), "u")
        nxt = scratch.write(few_tasks(low.select("u", F.col("m").alias("v")).union(pairs.where("v <> m").select(F.col("v"), F.col("m"))).distinct()), "edges")
        scratch.drop(cur)
        cur = nxt
