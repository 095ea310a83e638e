"""Functions as values: through parameters, and in fields of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.flow import spread
from lodegraph.operators.resolve import ancestors

_SEP = "\0"


def _slot(fn: str, param: str) -> F.Column:
    return F.concat_ws(_SEP, fn, param)


def parameter_targets(arguments: DataFrame, params: DataFrame, invoked: DataFrame) -> DataFrame:
    """Who calls what through a parameter: arguments (callee, position, keyword, concrete, from_fn, from_param), params (fn, names),
    invoked (fn, param) to (fn, target). An argument is a function (concrete) or a parameter of the caller that is passed on."""
    a = arguments.join(params.withColumnRenamed("fn", "callee"), "callee", "left")
    a = a.withColumn("param", F.coalesce("keyword", F.get("names", F.when(F.col("position") >= 0, F.col("position"))))).where("param is not null")
    seeds = a.where("concrete is not null").select(_slot("callee", "param").alias("fn"), F.col("concrete").alias("target"))
    passed = a.where("concrete is null and from_fn is not null").select(_slot("callee", "param").alias("caller"), _slot("from_fn", "from_param").alias("callee"))
    bound = spread(seeds, passed, ["target"])
    return invoked.select(_slot("fn", "param").alias("slot"), F.col("fn").alias("by")).join(bound.withColumnRenamed("fn", "slot"), "slot").select(F.col("by").alias("fn"), "target").distinct()


def field_bindings(given: DataFrame, constructors: DataFrame, attributes: DataFrame, inherits: DataFrame) -> DataFrame:
    """given (class, position, keyword, target) at constructions to (class, field, target): the class is the nearest of itself and its
    ancestors, breadth-first, whose constructor (class, names) has the parameter; attributes (class, param, field) name the field, else the parameter does."""
    near = ancestors(inherits).select(F.col("id").alias("class"), F.col("ancestor").alias("owner"), "depth", "order")
    own = given.select("class").distinct().select("class", F.col("class").alias("owner"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("order"))
    made = constructors.where(F.size("names") > 0).select(F.col("class").alias("owner"), "names")
    g = given.withColumn("gid", F.xxhash64("class", "position", "keyword", "target"))
    met = g.join(own.union(near), "class").join(made, "owner").where(F.col("keyword").isNull() | F.array_contains("names", F.col("keyword")))
    best = met.groupBy("gid").agg(F.min_by(F.struct("owner", "names", "position", "keyword", "target"), F.struct("depth", "order")).alias("b")).select("gid", "b.*")
    missing = g.join(best.select("gid"), "gid", "left_anti").where("keyword is not null").select(F.col("class").alias("owner"), F.col("keyword").alias("param"), "target")
    found = best.withColumn("param", F.coalesce("keyword", F.get("names", F.col("position")))).where("param is not null").select("owner", "param", "target")
    named = found.union(missing).join(attributes.select(F.col("class").alias("owner"), "param", "field"), ["owner", "param"], "left")
    return named.select(F.col("owner").alias("class"), F.coalesce("field", "param").alias("field"), "target").distinct()


def field_targets(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """calls (call, receiver, field) to (call, target): of the receiver's class, by its name or its last segment if just one class of that
    name has the field; else if only one class has it at all."""
    owners = bindings.select("class", "field").distinct().withColumn("leaf", F.substring_index("class", ".", -1))
    by_leaf = owners.groupBy("field", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class")).where("n = 1").select("field", "leaf", F.col("class").alias("typed"))
    alone = owners.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class")).where("n = 1").select("field", F.col("class").alias("only"))
    c = calls.withColumn("leaf", F.substring_index("receiver", ".", -1)).join(by_leaf, ["field", "leaf"], "left").join(alone, "field", "left")
    return c.select("call", "field", F.coalesce("typed", "only").alias("class")).join(bindings, ["class", "field"]).select("call", "target").distinct()
