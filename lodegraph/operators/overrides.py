"""Overrides, shadowed members and the targets of dynamic dispatch, on tables of classes and members.

parents: (child, parent, position, is_interface), the bases of a class in their order, interfaces after classes.
members: (class, leaf, member, is_method), leaf being the name with its parameter list where the language has one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.resolve import ancestors, inherited_member
from lodegraph.storage import cut, side

#: Stubs, and members, of a cell of protocol_targets; pairs of a task; tasks at most, beyond which they take more pairs each.
BLOCK, PAIRS, MOST_TASKS = 1024, 1 << 23, 10_000


def arity(leaf: Column) -> Column:
    """Parameters at the top level of a leaf's list; null without a list. Commas inside <>, () and [] don't count."""
    inner = F.regexp_extract(leaf, r"^[^(]*\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("deep"), F.lit(1).alias("n"))

    def step(s: Column, c: Column) -> Column:
        deep = s["deep"] + F.when(c.isin("<", "(", "["), 1).when(c.isin(">", ")", "]"), -1).otherwise(0)
        return F.struct(deep.alias("deep"), (s["n"] + F.when((c == ",") & (s["deep"] == 0), 1).otherwise(0)).alias("n"))

    counted = F.aggregate(F.split(inner, ""), start, step, lambda s: s["n"])
    return F.when(leaf.contains("("), F.when(F.trim(inner) == "", F.lit(0)).otherwise(counted))


def in_order(parents: DataFrame) -> DataFrame:
    """Every class's ancestors as resolve.ancestors gives them, all classes of a level before its interfaces of the same parent."""
    place = F.col("position") + F.when(F.col("is_interface"), 1 << 20).otherwise(0)
    return ancestors(parents.select("child", "parent", place.cast("int").alias("base_index")))


def overrides(methods: DataFrame, parents: DataFrame, members: DataFrame) -> DataFrame:
    """methods (class, leaf, member, needs_modifier) to (member, overridden): the first ancestor, breadth-first, that has a method of the
    same leaf, or, where it has no such member, just one of the same name and arity. needs_modifier: only interfaces count."""
    near = in_order(parents).select(F.col("id").alias("class"), F.col("ancestor").alias("of"), "depth", "order")
    interfaces = parents.where("is_interface").select(F.col("parent").alias("of")).distinct().withColumn("interface", F.lit(True))
    near = near.join(interfaces, "of", "left")
    asked = methods.select("class", "leaf", "member", "needs_modifier", F.substring_index("leaf", "(", 1).alias("name"), arity(F.col("leaf")).alias("n"))
    ways = asked.join(near, "class").where(F.col("interface") | ~F.coalesce("needs_modifier", F.lit(False)))
    theirs = members.select(F.col("class").alias("of"), "leaf", F.col("member").alias("exact"), "is_method")
    alone = members.where("is_method").select(F.col("class").alias("of"), F.substring_index("leaf", "(", 1).alias("name"), arity(F.col("leaf")).alias("n"), "member")
    alone = alone.where("n is not null").groupBy("of", "name", "n").agg(F.count(F.lit(1)).alias("k"), F.min("member").alias("similar")).where("k = 1").drop("k")
    met = ways.join(theirs, ["of", "leaf"], "left").join(alone, ["of", "name", "n"], "left")
    met = met.withColumn("overridden", F.when(F.col("exact").isNull(), F.col("similar")).when(F.col("is_method"), F.col("exact"))).where("overridden is not null")
    return met.groupBy("member").agg(F.min_by("overridden", F.struct("depth", "order")).alias("overridden"))


def linear_order(root: str, bases: dict[str, list[str]]) -> list[str]:
    """The class before its bases, and these before what several of them share (depth-first, finished last first)."""
    seen, done = {root}, []
    way = [(root, iter(bases.get(root, [])[::-1]))]
    while way:
        at, rest = way[-1]
        base = next((b for b in rest if b not in seen), None)
        if base is None:
            done.append(at)
            way.pop()
        else:
            seen.add(base)
            way.append((base, iter(bases.get(base, [])[::-1])))
    return done[::-1]


def linearized(parents: DataFrame) -> DataFrame:
    """(class, ancestor, place) for every class with bases, itself at place 0. A task holds the bases of one class's ancestors."""
    own = parents.where("not is_interface").select("child", "parent", "position")
    below = ancestors(own.select("child", "parent", F.col("position").cast("int").alias("base_index"))).select(F.col("id").alias("class"), F.col("ancestor").alias("child"))
    roots = own.select(F.col("child").alias("class")).distinct()
    rows = below.union(roots.select("class", F.col("class").alias("child"))).join(own, "child").select("class", "child", "parent", "position")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        bases: dict[str, list[str]] = {}
        for child, parent in group.sort_values(["child", "position", "parent"])[["child", "parent"]].itertuples(index=False):
            bases.setdefault(child, []).append(parent)
        root = group["class"].iloc[0]
        found = linear_order(root, bases)
        return pd.DataFrame({"class": root, "ancestor": found, "place": range(len(found))})

    kind = parents.schema["child"].dataType.simpleString()
    return rows.groupBy("class").applyInPandas(order, f"class {kind}, ancestor {kind}, place long")


def shadowed(parents: DataFrame, members: DataFrame) -> DataFrame:
    """(member, overridden): in a class's linear order the first provider of a leaf shadows the later ones that it doesn't inherit from."""
    lines = linearized(parents)
    have = lines.join(members.where("is_method").select(F.col("class").alias("ancestor"), "leaf", "member"), "ancestor")
    first = Window.partitionBy("class", "leaf").orderBy("place")
    pairs = have.select(F.first("ancestor").over(first).alias("by"), F.first("member").over(first).alias("by_member"), "ancestor", F.col("member").alias("overridden"), "place", F.first("place").over(first).alias("at")).where("place > at")
    branch = lines.where("place > 0").select(F.col("class").alias("by"), "ancestor")
    return pairs.join(branch, ["by", "ancestor"], "left_anti").select(F.col("by_member").alias("member"), "overridden").distinct()


def concrete_subclasses(parents: DataFrame, abstract: DataFrame) -> DataFrame:
    """(class, subclass) for every class and all that inherit from it and aren't abstract (class)."""
    pairs = ancestors(parents.select("child", "parent", F.col("position").cast("int").alias("base_index"))).select(F.col("ancestor").alias("class"), F.col("id").alias("subclass"))
    return pairs.join(abstract.select(F.col("class").alias("subclass")), "subclass", "left_anti").select("class", "subclass")


def self_targets(calls: DataFrame, parents: DataFrame, members: DataFrame, abstract_members: DataFrame) -> DataFrame:
    """calls (class, name) on self to (class, name, member): the own or inherited member and those of all subclasses, none of them abstract (member)."""
    simple = members.select("class", F.col("leaf").alias("name"), "member")
    inherits = parents.select("child", "parent", F.col("position").cast("int").alias("base_index"))
    own = inherited_member(calls.select("class", "name").distinct(), inherits, simple).select("class", "name", "member")
    under = concrete_subclasses(parents, members.select("class").limit(0))
    over = calls.select("class", "name").distinct().join(under, "class").join(simple.withColumnRenamed("class", "subclass"), ["subclass", "name"]).select("class", "name", "member")
    return own.union(over).distinct().join(abstract_members, "member", "left_anti").select("class", "name", "member")


def protocol_targets(calls: DataFrame, protocols: DataFrame, members: DataFrame) -> DataFrame:
    """calls (class, name) that resolved to a protocol's stub to (class, name, member) of every class that has such a member and is no protocol.

    All stubs of a name meet all members of it, so a name's two lists are dealt into cells of BLOCK by BLOCK at most on average, and
    cells, not names, to tasks of a bounded number of pairs.
    """
    stubs = calls.select("class", "name").distinct().join(side(protocols.select("class").distinct()), "class", "left_semi")
    real = members.join(side(protocols.select("class").distinct()), "class", "left_anti").select(F.col("leaf").alias("name"), "member")
    stubs, real = cut(stubs), cut(real)
    n = lambda df, x: df.groupBy("name").agg(F.count(F.lit(1)).alias(x))
    size = cut(n(stubs, "n_stubs").join(side(n(real, "n_real")), "name"))
    names, pairs = size.agg(F.count(F.lit(1)), F.sum(F.col("n_stubs").cast("double") * F.col("n_real"))).first()
    tasks = int(max(1, min((pairs or 0) // PAIRS + 1, MOST_TASKS)))
    blocks = size.select("name", *[F.ceil(F.col(x) / BLOCK).cast("int").alias(y) for x, y in (("n_stubs", "rows"), ("n_real", "cols"))])
    own = lambda df, x, of: df.join(side(blocks, names), "name").withColumn(x, F.pmod(F.xxhash64(of), F.col(f"{x}s")).cast("int"))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = own(stubs, "row", "class").withColumn("col", every("cols")).select("name", "row", "col", "class")
    right = own(real, "col", "member").withColumn("row", every("rows")).select("name", "row", "col", "member")
    cell = ["name", "row", "col"]
    return left.repartition(tasks, *cell).join(side(right.repartition(tasks, *cell)), cell).select("class", "name", "member")


def sole_targets(calls: DataFrame, parents: DataFrame, members: DataFrame) -> DataFrame:
    """calls (class, name) that resolved to an interface to (class, name, member) of its only implementer, own or inherited."""
    only = parents.where("is_interface").groupBy(F.col("parent").alias("class")).agg(F.min("child").alias("impl"), F.max("child").alias("last")).where("impl = last")
    asked = calls.select("class", "name").distinct().join(only, "class").select("class", F.col("impl"), "name")
    inherits = parents.where("not is_interface").select("child", "parent", F.col("position").cast("int").alias("base_index"))
    found = inherited_member(asked.select(F.col("impl").alias("class"), "name").distinct(), inherits, members.select("class", F.col("leaf").alias("name"), "member"))
    return asked.join(found.select(F.col("class").alias("impl"), "name", "member"), ["impl", "name"]).select("class", "name", "member")
