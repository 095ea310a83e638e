"""Routers, where they are mounted, and the variables that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.links import UNKNOWN_LEAD
from lodegraph.storage import cut


def mount_prefixes(routers: DataFrame, mounts: DataFrame) -> DataFrame:
    """routers (key, kind: app, blueprint or router, prefix), mounts (child, parent, prefix, given) to (key, prefix), one row for each chain of
    mounts up to an app. A part that isn't known swallows what is above it and becomes a lead for any path; a chain that comes back
    to itself, or leaves the known routers, ends in one. A blueprint's prefix is replaced where it is mounted, a router's goes on."""
    r = routers.select(F.col("key").alias("at"), "kind", F.col("prefix").alias("own"), F.lit(True).alias("known"))
    m = mounts.select(F.col("child").alias("at"), "parent", F.col("prefix").alias("at_mount"), "given")
    front = cut(routers.select("key", F.col("key").alias("at"), F.lit("").alias("tail"), F.array("key").alias("way")))
    done = None

    def found(rows: DataFrame) -> None:
        nonlocal done
        done = cut(rows if done is None else done.union(rows).distinct())

    while not front.isEmpty():
        here = front.join(r, "at")
        ends = here.join(m.select("at").distinct(), "at", "left_anti").where("kind <> 'app'").union(here.where("kind = 'app'"))
        known = F.when(F.col("kind") == "app", F.col("tail")).otherwise(F.concat("own", "tail"))
        found(ends.select("key", F.coalesce(known, F.concat(F.lit(f"/{UNKNOWN_LEAD}"), "tail")).alias("prefix")))
        up = here.where("kind <> 'app'").join(m, "at")
        replaced = F.when(F.col("given"), F.col("at_mount")).otherwise(F.col("own"))
        joined = F.concat(F.when(F.col("given"), F.col("at_mount")).otherwise(F.lit("")), F.col("own"))
        segment = F.when(F.col("kind") == "blueprint", replaced).otherwise(joined)
        rest = F.when((F.col("kind") != "blueprint") & F.col("own").isNotNull(), F.col("own")).otherwise(F.lit(""))
        up = up.withColumn("segment", segment).withColumn("rest", rest).join(r.select(F.col("at").alias("parent"), F.col("known").alias("goes_on")), "parent", "left")
        stops = F.col("segment").isNull() | F.col("goes_on").isNull() | F.array_contains("way", F.col("parent"))
        up = cut(up.withColumn("stops", stops))
        found(up.where("stops").select("key", F.concat(F.lit(f"/{UNKNOWN_LEAD}"), F.coalesce("segment", "rest"), "tail")))
        front = cut(up.where("not stops").select("key", F.col("parent").alias("at"), F.concat("segment", "tail").alias("tail"), F.concat("way", F.array("parent")).alias("way")))
    return done if done is not None else routers.select("key", "prefix").limit(0)


def router_of(names: DataFrame, variables: DataFrame) -> DataFrame:
    """names (use, module, scope, name), variables (module, scope, name, key) to (use, key): the innermost enclosing scope that assigns the
    name, a.b in a and in the module; a scope that assigns it differing routers gives none."""
    parts = F.filter(F.split("scope", r"\."), lambda p: p != "")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), ".").alias("scope")))
    around = names.select("use", "module", "name", F.explode(chain).alias("c")).select("use", "module", "name", "c.depth", "c.scope")
    one = variables.groupBy("module", "scope", "name").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    met = around.join(one, ["module", "scope", "name"])
    best = met.groupBy("use").agg(F.max_by(F.struct("key", "last"), "depth").alias("b"))
    return best.where("b.key = b.last").select("use", F.col("b.key").alias("key"))
