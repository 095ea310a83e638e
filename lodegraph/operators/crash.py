"""Crash reports: frames of a traceback, their surroundings, and ranked causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.fixpoint import reverse, shortest_paths

ON_STACK, CALLER, FLOW = 0.3, 0.4, 0.6
MAX_DEPTH, LIMIT = 3, 10


def _after(value: Column, mark: str) -> Column:
    """What stands after the first mark."""
    return F.substring(value, F.instr(value, mark) + len(mark), F.length(value))


def _plain_lines(text: Column) -> Column:
    """Lines without the bars that frame the members of a group, blank ones left out."""
    framed = lambda x: F.ltrim(x).startswith("| ") | F.ltrim(x).startswith("+ ")
    line = lambda x: F.when(framed(x), F.substring(F.ltrim(x), 3, 1 << 20)).when(F.ltrim(x).startswith("+-") | (F.trim(x) == "|"), "").otherwise(x)
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line), lambda x: F.trim(x) != "")


def parse_tracebacks(reports: DataFrame) -> DataFrame:
    """reports (…, text) with frames (array of path, line, name, the outermost first), exception and message.

    A chained report has several sections, each under a line that ends in "Traceback (most recent call last):"; the last one went
    through. Its frames are the lines File "path", line n, in name; the first line after them that isn't indented tells the
    exception, and after a colon the message. A text without a section is searched from its beginning.
    """
    rows = reports.withColumn("_lines", _plain_lines(F.coalesce("text", F.lit(""))))
    heads = F.transform("_lines", lambda x, i: F.when(F.rtrim(x).endswith("Traceback (most recent call last):"), i + 1).otherwise(0))
    rows = rows.withColumn("_begin", F.coalesce(F.array_max(heads), F.lit(0)))
    rows = rows.withColumn("_part", F.slice("_lines", F.col("_begin") + 1, F.greatest(F.size("_lines"), F.lit(1))))
    ends = F.filter(F.transform("_part", lambda x, i: F.when(x.rlike("^[^ \\t:]*[^ \\t:.](:|$)") & x.rlike("^[_\\p{L}]"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_end", F.get(ends, F.lit(0)))
    above = F.slice("_part", 1, F.coalesce(F.col("_end"), F.size("_part")))
    is_frame = lambda x: F.ltrim(x).startswith('File "') & x.contains('", line ') & x.contains(", in ")

    def frame(x: Column) -> Column:
        rest = _after(x, '", line ')
        path = F.substring_index(_after(x, 'File "'), '", line ', 1)
        return F.struct(path.alias("path"), F.substring_index(rest, ",", 1).cast("int").alias("line"), F.trim(_after(rest, ", in ")).alias("name"))

    last = F.coalesce(F.get("_part", F.col("_end")), F.lit(""))
    message = F.when(last.contains(":"), F.regexp_replace(_after(last, ":"), "^ ", "")).otherwise("")
    return rows.select(*reports.columns, F.transform(F.filter(above, is_frame), frame).alias("frames"), F.substring_index(last, ":", 1).alias("exception"), message.alias("message"))


def surroundings(names: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """names (qualified_name) with sorted lists of callers, callees and flow sources; pairs that repeat stay."""
    gather = lambda df, key, value, name: df.groupBy(F.col(key).alias("qualified_name")).agg(F.sort_array(F.collect_list(value)).alias(name))
    out = names.join(gather(calls, "to_qn", "from_qn", "callers"), "qualified_name", "left").join(gather(calls, "from_qn", "to_qn", "callees"), "qualified_name", "left").join(gather(flows, "target", "source", "flow_sources"), "qualified_name", "left")
    none = F.array().cast("array<string>")
    return out.select(*names.columns, *[F.coalesce(c, none).alias(c) for c in ("callers", "callees", "flow_sources")])


def rank_causes(stack: list[str], calls: DataFrame, flows: DataFrame) -> DataFrame:
    """stack: resolved names, outermost first. (qualified_name, score, call_path) of the best candidates: callers up to three
    steps away by 0.4 / depth, 0.3 for each place on the stack, 0.6 for a flow source. Sorted by the exact score, rounded after."""
    spark = calls.sparkSession
    empty = spark.createDataFrame([], "qualified_name string, score double, call_path array<string>")
    if not stack:
        return empty
    failing = stack[-1]
    edges = reverse(calls.select(F.col("from_qn").alias("src"), F.col("to_qn").alias("dst")))
    near = shortest_paths(spark.createDataFrame([(failing,)], "id string"), edges, MAX_DEPTH)
    evidence = near.select(F.col("id").alias("qualified_name"), (CALLER / F.col("depth")).alias("score"), F.reverse("path").alias("call_path"))
    no_path = F.lit(None).cast("array<string>").alias("call_path")
    if stack[:-1]:
        evidence = evidence.union(spark.createDataFrame([(q,) for q in stack[:-1]], "qualified_name string").select("qualified_name", F.lit(ON_STACK), no_path))
    sources = flows.where(F.col("target") == failing).select(F.col("source").alias("qualified_name")).distinct()
    evidence = evidence.union(sources.select("qualified_name", F.lit(FLOW), no_path))
    total = evidence.groupBy("qualified_name").agg(F.sum("score").alias("score"), F.max("call_path").alias("call_path"))
    return total.orderBy(F.desc("score"), "qualified_name").limit(LIMIT).select("qualified_name", F.round("score", 3).alias("score"), F.coalesce("call_path", F.array().cast("array<string>")).alias("call_path"))
