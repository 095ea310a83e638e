"""Name resolution: distances, ancestors, providers, and what a call resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.storage import cut


def import_distance(candidate: Column, caller_module: Column) -> Column:
    """Segments of the longer name beyond the common beginning, one less below the caller's parent."""
    a, b = F.split(candidate, r"\."), F.split(caller_module, r"\.")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    parent = F.concat(F.array_join(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), "."), F.lit("."))
    return F.greatest(F.size(a), F.size(b)) - common - F.when(candidate.startswith(parent), 1).otherwise(0)


def cross_package(pairs: DataFrame) -> DataFrame:
    """Pairs (from_qn, to_qn) of names of three segments at least whose second segments differ."""
    a, b = F.split("from_qn", r"\."), F.split("to_qn", r"\.")
    return pairs.where((F.size(a) >= 3) & (F.size(b) >= 3) & (a[1] != b[1]))


def ancestors(inherits: DataFrame) -> DataFrame:
    """inherits (child, parent, base_index) to (id, ancestor, depth, order): breadth-first, bases in their order; order sorts by the way there. Cycles end at a class met before."""
    step = inherits.select(F.col("child").alias("at"), F.col("parent").alias("ancestor"), F.coalesce("base_index", F.lit(0)).alias("i"))
    front = cut(step.select(F.col("at").alias("id"), "ancestor", F.lit(1).alias("depth"), F.array("i").alias("order")).where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth"), F.min("order").alias("order")))
    seen, depth = front, 1
    while not front.isEmpty():
        depth += 1
        grown = front.select("id", F.col("ancestor").alias("at"), "order").join(step, "at").where("id <> ancestor").select("id", "ancestor", F.lit(depth).alias("depth"), F.concat("order", F.array("i")).alias("order"))
        fresh = grown.join(seen.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        front = cut(fresh.groupBy("id", "ancestor").agg(F.min("depth").alias("depth"), F.min("order").alias("order")))
        seen = cut(seen.union(front))
    return seen


def inherited_member(wanted: DataFrame, inherits: DataFrame, members: DataFrame) -> DataFrame:
    """wanted (class, name) to (class, name, provider, member): the class's own member, else that of the first ancestor breadth-first that has one."""
    near = ancestors(inherits).select(F.col("id").alias("class"), F.col("ancestor").alias("provider"), "depth", "order")
    own = wanted.select("class").distinct().select("class", F.col("class").alias("provider"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("order"))
    found = wanted.join(own.union(near.join(wanted.select("class").distinct(), "class", "left_semi")), "class").join(members.select(F.col("class").alias("provider"), "name", "member"), ["provider", "name"])
    first = Window.partitionBy("class", "name").orderBy("depth", "order", "provider", "member")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("class", "name", "provider", "member")


def providers(class_: DataFrame, inherits: DataFrame, members: DataFrame) -> DataFrame:
    """class_ (class, name) to every member of that name over the class and its ancestors."""
    near = ancestors(inherits).select(F.col("id").alias("class"), F.col("ancestor").alias("provider"))
    all_ = class_.select("class", F.col("class").alias("provider")).distinct().union(near)
    return class_.join(all_, "class").join(members.select(F.col("class").alias("provider"), "name", "member"), ["provider", "name"]).select("class", "name", "member").distinct()


def first_definition(qn: Column) -> Column:
    """The name that the first definition of several has: later ones carry @line or @line_column at the end."""
    return F.regexp_replace(qn, "(?<=.)(@[0-9_]+)+$", "")


def without_parameters(qn: Column) -> Column:
    """Without the parameter list at the end."""
    return F.when(qn.endswith(")") & qn.contains("("), F.regexp_replace(qn, "[(][^(]*$", "")).otherwise(qn)


def cascade(decisions: DataFrame) -> DataFrame:
    """decisions (call, rule, distance, target) to (call, rule, target): the lowest rule that says anything decides, by its nearest target and then
    the least name. A rule that decides against any target says so with a null one, and outdoes its own targets."""
    order = F.struct(F.col("rule"), F.col("target").isNotNull(), F.coalesce("distance", F.lit(0)), F.coalesce("target", F.lit("")))
    return decisions.groupBy("call").agg(F.min_by(F.struct("rule", "target"), order).alias("b")).select("call", "b.rule", "b.target")


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame, builtins: DataFrame) -> DataFrame:
    """calls (call, module, name) to (call, rule, target) against definitions (qualified_name, module, name), imports (module, name, target; a null
    target is external, the name * stands for all of the target module) and builtins (name).

    1 an import of that name, external ones decide against; 2 a definition of the module; 3 one of a module imported as a whole;
    4 a built-in, which decides against; 5 any definition of the name, the nearest by import distance.
    """
    d = definitions.select("qualified_name", F.col("module").alias("d_module"), "name")
    zero, none = F.lit(0).alias("distance"), F.lit(None).cast("string").alias("target")
    named = imports.where("name <> '*'").select("module", "name", F.col("target").alias("to"))
    by_name = calls.join(named, ["module", "name"]).join(d.select(F.col("qualified_name").alias("to"), F.lit(True).alias("known")), "to", "left")
    one = by_name.where("known or to is null").select("call", F.lit(1).alias("rule"), zero, F.col("to").alias("target"))
    two = calls.join(d, "name").where("module = d_module").select("call", F.lit(2), zero, F.col("qualified_name"))
    whole = imports.where("name = '*'").select("module", F.col("target").alias("d_module")).distinct()
    three = calls.join(whole, "module").join(d, ["d_module", "name"]).select("call", F.lit(3), zero, F.col("qualified_name"))
    four = calls.join(builtins.select("name").distinct(), "name", "left_semi").select("call", F.lit(4), zero, none)
    # what is decided is not looked for everywhere, and one search serves all calls of a module
    early = cut(one.union(two).union(three).union(four))
    open_ = calls.join(early.select("call").distinct(), "call", "left_anti")
    asked = open_.select("module", "name").distinct().join(d, "name").select("module", "name", import_distance(F.col("qualified_name"), F.col("module")).alias("distance"), "qualified_name")
    nearest = asked.groupBy("module", "name").agg(F.min_by(F.struct("distance", "qualified_name"), F.struct("distance", "qualified_name")).alias("b"))
    five = open_.join(nearest, ["module", "name"]).select("call", F.lit(5), F.col("b.distance"), F.col("b.qualified_name"))
    return cascade(early.union(five))
