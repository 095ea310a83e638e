"""Request URLs to route templates, and resources to the endpoints that serve them.

Segments are compared position by position without a Python function: a parameter of the template ({x}, <t:x>,
:x) takes one segment. Matching joins on the number of segments and the template's lead, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_LEAD = "**"
MAX_LEAD = 2
WRITES = ("POST", "PUT", "PATCH", "DELETE")
# Decorator names that are HTTP methods.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")


def is_parameter(segment: Column) -> Column:
    """{x}, <x>, <type:x> and :x, with something between the brackets or after the colon."""
    inside = F.length(segment) > 2
    return (segment.startswith("{") & segment.endswith("}") & inside) | (segment.startswith("<") & segment.endswith(">") & inside) | (segment.startswith(":") & (F.length(segment) > 1))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host or null, path, is linkable): absolute urls with a host and rooted paths are; //host and fragments aren't."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*|^[A-Za-z][A-Za-z0-9+.-]*:(?!//)", ""), r"^[^?#;]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    linkable = ((scheme != "") & (authority != "")) | (url.startswith("/") & ~url.startswith("//"))
    return F.when(host != "", host), path, linkable


def parse_route_decorators(decorators: DataFrame) -> DataFrame:
    """decorators (…, decorator) to (…, receiver, method, template): one row for each method of a route decorator with a literal path."""
    d = F.trim("decorator")
    called = F.substring_index(F.substring(d, 2, 1 << 20), "(", 1)  # what is called, without the @
    name = F.lower(F.substring_index(called, ".", -1))
    receiver = F.when(called.contains("."), F.substring(called, F.lit(1), F.length(called) - F.length(F.substring_index(called, ".", -1)) - 1))
    inside = F.ltrim(F.substring(d, F.instr(d, "(") + 1, F.length(d)))
    quote = F.substring(inside, 1, 1)
    path = F.when(quote.isin("'", '"'), F.split_part(F.substring(inside, 2, 1 << 20), quote, F.lit(1)))
    # the list that the methods keyword has: from the bracket after it to the next closing one
    given = F.regexp_extract(F.regexp_replace(inside, "\\s", ""), "[,(]?methods=[^A-Za-z0-9_]([^])}]*)[])}]", 1)
    has_list = F.regexp_replace(inside, "\\s", "").rlike("methods=[\\[({]")
    listed = F.filter(F.transform(F.split(given, ","), lambda m: F.upper(F.regexp_replace(m, "[^A-Za-z0-9_]", ""))), lambda m: m != "")
    methods = F.when(name.isin(*METHODS), F.array(F.upper(name))).when((name == "route") & ~has_list, F.array(F.lit("GET"))).when(name == "route", listed)
    known = d.startswith("@") & d.contains("(") & path.startswith("/") & called.rlike("^[A-Za-z0-9_.]+$")
    return decorators.select("*", receiver.alias("receiver"), F.explode(F.when(known, methods)).alias("method"), path.alias("template"))


def _same(template: Column, url: Column) -> Column:
    return F.forall(F.zip_with(template, url, lambda t, u: is_parameter(t) | (t == u)), lambda ok: ok)


def match_templates(urls: DataFrame, templates: DataFrame) -> DataFrame:
    """All pairs of urls (…, url) and templates (…, template) that match, with `how` (exact, suffix, mount) and the lead that was stripped.

    suffix: one or two leading segments of the url are left out; mount: of the template, all of them literal, with a
    literal left in the tail. A template of parameters alone never matches, nor one without segments.
    """
    _, path, linkable = url_parts(F.col("url"))
    u = urls.where(linkable).withColumn("_u", segments(path))
    t = templates.withColumn("_all", segments(F.col("template")))
    t = t.withColumn("_open", F.coalesce(F.get("_all", F.lit(0)) == UNKNOWN_LEAD, F.lit(False))).withColumn("_t", F.when(F.col("_open"), F.slice("_all", 2, F.size("_all"))).otherwise(F.col("_all")))
    t = t.where(F.exists("_all", lambda s: ~is_parameter(s) & (s != UNKNOWN_LEAD)))
    # the number of segments that both have after a lead of `lead` (of the url: > 0, of the template: < 0)
    t = t.withColumn("_lead", F.explode(F.when(F.col("_open"), F.sequence(F.lit(0), F.lit(64))).otherwise(F.sequence(F.lit(-MAX_LEAD), F.lit(MAX_LEAD)))))
    t = t.withColumn("_n", F.size("_t") + F.col("_lead")).where("_n >= 0")
    met = u.withColumn("_n", F.size("_u")).join(t, "_n")
    lead = F.greatest("_lead", F.lit(0))
    drop = F.greatest(-F.col("_lead"), F.lit(0))
    u_tail, t_tail = F.slice("_u", lead + 1, F.greatest(F.size("_u"), F.lit(1))), F.slice("_t", drop + 1, F.greatest(F.size("_t"), F.lit(1)))
    mount = F.slice("_t", 1, F.greatest(drop, F.lit(0)))
    how = F.when(F.col("_open") | (F.col("_lead") == 0), "exact").when(F.col("_lead") > 0, "suffix").otherwise("mount")
    ok = _same(t_tail, u_tail) & F.when(how == "mount", ~F.exists(mount, lambda s: is_parameter(s)) & F.exists(t_tail, lambda s: ~is_parameter(s)) & (F.size("_u") > 0)).when(how == "suffix", F.size("_t") > 0).otherwise(True)
    stripped = F.when(how == "suffix", F.concat(F.lit("/"), F.array_join(F.slice("_u", 1, F.greatest(lead, F.lit(0))), "/"))).when(how == "mount", F.concat(F.lit("/"), F.array_join(mount, "/")))
    return met.where(ok).select(*urls.columns, *[c for c in templates.columns if c not in urls.columns], how.alias("how"), stripped.alias("lead"))


def stem(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def project_stem(project: Column) -> Column:
    """Without the part after the last double underscore."""
    return stem(F.regexp_replace(project, "__(?:(?!__).)*$", ""))


def link_endpoints(networks: DataFrame, endpoints: DataFrame) -> DataFrame:
    """networks (network, url, directions, caller_projects), endpoints (endpoint, identity "METHOD /template", project) to
    (network, endpoint, lead_prefix, mount_prefix).

    A url's candidates are its host's project's endpoints, or its callers' for a rooted url, with those of no project;
    an absolute url whose host names no project may reach all. Exact matches beat stripped urls, these beat stripped
    templates; of several inferred ones a tie is dropped unless it is one path of one project, or the stripped lead
    names the project of just one.
    """
    e = endpoints.select("endpoint", "project", F.substring_index("identity", " ", 1).alias("method"), F.expr("substring(identity, instr(identity, ' ') + 1)").alias("template")).where("instr(identity, ' ') > 0") if "identity" in endpoints.columns else endpoints
    host, _, _ = url_parts(F.col("url"))
    n = networks.withColumn("host", stem(host)).withColumn("rooted", F.col("url").startswith("/") & ~F.col("url").startswith("//"))
    stems = e.where("project is not null").select(project_stem(F.col("project")).alias("host")).distinct().withColumn("named", F.lit(True))
    n = n.join(stems, "host", "left")
    met = match_templates(n, e)
    need = F.when(F.col("method").isin(*WRITES), "WRITES_TO").otherwise("READS_FROM")
    free = F.col("directions").isNull() | (F.size("directions") == 0) | (F.col("method") == "ANY")
    met = met.where(free | F.array_contains("directions", need))
    own = F.when(F.col("rooted"), F.coalesce(F.array_contains("caller_projects", F.col("project")), F.lit(False))).otherwise(project_stem(F.col("project")) == F.col("host"))
    scoped = F.col("project").isNull() | F.coalesce(own, F.lit(False)) | (~F.col("rooted") & F.col("named").isNull())
    met = met.withColumn("scoped", scoped)
    w = Window.partitionBy("network")
    has = lambda c: F.coalesce(F.max(c.cast("int")).over(w), F.lit(0)) > 0
    met = met.withColumn("any_exact", has((F.col("how") == "exact") & F.col("scoped"))).withColumn("any_near", has((F.col("how") != "exact") & F.col("scoped")))
    exact = met.where("how = 'exact' and scoped").select("network", "endpoint", F.lit(None).cast("string").alias("lead_prefix"), F.lit(None).cast("string").alias("mount_prefix"))
    near = met.where("not any_exact and how <> 'exact' and (scoped or (rooted and not any_near))")
    g = Window.partitionBy("network", "how")
    one = (F.min("template").over(g) == F.max("template").over(g)) & (F.size(F.collect_set(F.coalesce("project", F.lit(""))).over(g)) == 1)
    named = F.col("project").isNotNull() & F.array_contains(F.transform(segments(F.col("lead")), stem), project_stem(F.col("project")))
    near = near.withColumn("one", one).withColumn("named_lead", (F.col("how") == "suffix") & F.coalesce(named, F.lit(False)))
    near = near.withColumn("n_named", F.sum(F.col("named_lead").cast("int")).over(g))
    near = near.where("one or (named_lead and n_named = 1)").withColumn("best", F.min(F.when(F.col("how") == "suffix", 1).otherwise(2)).over(w)).where(F.when(F.col("how") == "suffix", 1).otherwise(2) == F.col("best"))
    lead = lambda how: F.when(F.col("how") == how, F.col("lead"))
    return exact.union(near.select("network", "endpoint", lead("suffix").alias("lead_prefix"), lead("mount").alias("mount_prefix")))


def link_dispatch_keys(sent: DataFrame, registered: DataFrame) -> DataFrame:
    """sent (key), registered (key) to (key, target): the key itself if it is registered, else what stands before its last slash."""
    r = registered.select("key").distinct()
    exact = sent.join(r, "key", "left_semi").select("key", F.col("key").alias("target"))
    base = sent.join(r, "key", "left_anti").withColumn("target", F.regexp_replace("key", "/[^/]*$", "")).where("target <> key")
    return exact.union(base.join(r.withColumnRenamed("key", "target"), "target", "left_semi").select("key", "target"))
