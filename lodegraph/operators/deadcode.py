"""Unreachable code: roots by rule, closure over calls, then what live code brings in.

nodes: label, qualified_name, name, path, decorators, is_exported, overrides_external, start_line, end_line, and
for Rust modules rust_cfg_test_mods and rust_ungated_mods; edges: src_label, src, rel_type, dst_label, dst, the
ends by qualified name. Every rule is a boolean column of the candidates, so all rules are one pass; closures
are frontier loops.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.fixpoint import closure
from lodegraph.storage import cut

# Names that runtimes and frameworks call, by language.
ROOT_DECORATORS = (
    "route get post callback put delete patch websocket task flow fixture command cli app on_event listener validator field_validator model_validator root_validator field_serializer "
    "model_serializer computed_field abstractmethod property cached_property classproperty hybrid_property setter deleter"
).split()
TEST_PATTERNS = ["test_", "_test", "conftest", "/tests/", "/test/", ".test.", ".spec.", "__tests__"]
PROTOCOLS = ["typing.Protocol", "typing_extensions.Protocol"]
ENUM_HOOKS = ["_generate_next_value_", "_missing_"]
GO_ROOTS = ["init", "main"]
RUST_TRAIT_METHODS = (
    "fmt eq ne cmp partial_cmp hash next next_back into_iter size_hint drop clone clone_from default from from_str try_from into try_into deref deref_mut as_ref as_mut borrow borrow_mut "
    "poll serialize deserialize source add add_assign sub sub_assign mul mul_assign div div_assign rem rem_assign neg not bitand bitand_assign bitor bitor_assign bitxor bitxor_assign "
    "shl shl_assign shr shr_assign index index_mut"
).split()
RUST_TEST_ATTRIBUTES, RUST_TEST_MODULES = ["test", "bench"], ["tests", "test"]
C_ENTRIES = ["main", "wmain", "WinMain", "wWinMain", "DllMain"]
JAVA_HOOKS = ["readObject", "writeObject", "readObjectNoData", "readResolve", "writeReplace"]
CSHARP_ATTRIBUTES = (
    "fact theory test testmethod testcase setup teardown onetimesetup onetimeteardown globalsetup apicontroller route httpget httppost httpput httpdelete httppatch httphead httpoptions "
    "ondeserialized ondeserializing onserialized onserializing"
).split()
CSHARP_DISPOSE = ["Dispose", "DisposeAsync"]
JS_SYMBOLS = "asyncIterator hasInstance isConcatSpreadable iterator match matchAll replace search species split toPrimitive toStringTag unscopables dispose asyncDispose".split()
JS_REGISTRY = ["nodejs.util.inspect.custom", "nodejs.rejection"]
NEST_DECORATORS = ["injectable", "controller", "module", "catch", "resolver", "websocketgateway"]
NEST_METHODS = "onModuleInit onModuleDestroy onApplicationBootstrap onApplicationShutdown beforeApplicationShutdown configure use intercept canActivate catch transform".split()
REACT_BASES = ["Component", "PureComponent"]
REACT_METHODS = (
    "render constructor componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate componentDidCatch getDerivedStateFromProps "
    "getDerivedStateFromError componentWillMount componentWillReceiveProps componentWillUpdate UNSAFE_componentWillMount UNSAFE_componentWillReceiveProps UNSAFE_componentWillUpdate"
).split()
# File endings.
JS_TS, CPP, C_SOURCES = [".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"], [".cpp", ".h", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".ixx", ".cppm", ".ccm"], [".c", ".cpp", ".cc", ".cxx"]


@dataclass(frozen=True)
class Config:
    include_tests: bool = False
    include_classes: bool = False
    root_decorators: tuple[str, ...] = tuple(ROOT_DECORATORS)
    entry_points: tuple[str, ...] = ()
    test_patterns: tuple[str, ...] = field(default=tuple(TEST_PATTERNS))
    exclude_patterns: tuple[str, ...] = ()


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return F.coalesce(out, F.lit(False))


def ends(path: Column, endings: list[str]) -> Column:
    return _any([path.endswith(e) for e in endings])


def is_test_path(path: Column, patterns: tuple[str, ...] | list[str] = TEST_PATTERNS) -> Column:
    slashed = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return _any([slashed.contains(p) for p in patterns])


def normal_decorator(d: Column) -> Column:
    """@app.route(...) and [Route("x")] are both route."""
    head = F.split(F.regexp_replace(F.replace(d, F.lit("@"), F.lit("")), r"^[\[\] ]+|[\[\] ]+$", ""), r"\(", 2)[0]
    return F.lower(F.regexp_replace(F.substring_index(head, ".", -1), r"^[\[\]]+|[\[\]]+$", ""))


def _decorated(names: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(F.exists("decorators", lambda d: normal_decorator(d).isin(*names)), F.lit(False)) if names else F.lit(False)


def _glob(pattern: str) -> str:
    """fnmatch's wildcards as a regex: * goes over slashes as well."""
    import fnmatch

    return fnmatch.translate(pattern).replace("(?s:", "(?s:^").replace(r"\Z", "$").replace(r"\z", "$")


def _rust_attribute(d: Column) -> Column:
    name = F.regexp_replace(F.split(F.regexp_replace(d, r"^[#\[\] ]+|[#\[\] ]+$", ""), r"\(", 2)[0], r"\s", "")
    return name.isin(*RUST_TEST_ATTRIBUTES) | name.endswith("::test")


def _has_rust_test() -> Column:
    return F.coalesce(F.col("path").endswith(".rs") & F.exists("decorators", _rust_attribute), F.lit(False))


def rust_test_modules(nodes: DataFrame) -> DataFrame:
    """(module): by name, by their own cfg(test), or by the gate of their declaration unless another declares them without."""
    modules = nodes.where("label = 'Module'")
    own = modules.where(F.col("path").endswith(".rs") | F.col("path").startswith("inline_module_"))
    gate = F.coalesce(F.exists("decorators", lambda d: F.regexp_replace(d, r"\s", "") == "#[cfg(test)]"), F.lit(False))
    named = own.where(F.substring_index("qualified_name", ".", -1).isin(*RUST_TEST_MODULES) | gate).select(F.col("qualified_name").alias("module"))
    declared = modules.select(F.explode("rust_cfg_test_mods").alias("module")).join(modules.select(F.explode("rust_ungated_mods").alias("module")), "module", "left_anti")
    return named.union(declared.join(own.select(F.col("qualified_name").alias("module")), "module", "left_semi")).distinct()


def mark_tests(code: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """Adds is_test: by path, or for Rust by attribute, module, or the span of a test function around it."""
    qn = F.split("qualified_name", r"\.")
    rust = code.where(F.col("path").endswith(".rs") & (F.size(qn) > 1))
    prefixes = rust.select("qualified_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(qn) - 1), lambda n: F.array_join(F.slice(qn, 1, n), "."))).alias("module"))
    inside = prefixes.join(rust_test_modules(nodes), "module", "left_semi").select("qualified_name").distinct()
    spans = nodes.where(F.col("label").isin("Function", "Method") & _has_rust_test() & (F.col("start_line") > 0) & F.col("end_line").isNotNull()).select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    held = code.where("start_line > 0 and end_line is not null").join(spans, "path").where("s < start_line and end_line < e").select("qualified_name").distinct()
    marked = inside.union(held).distinct().withColumn("_rust", F.lit(True))
    return code.join(marked, "qualified_name", "left").withColumn("is_test", is_test_path(F.col("path"), config.test_patterns) | _has_rust_test() | F.col("_rust").isNotNull()).drop("_rust")


def root_rules(config: Config, prefix: str) -> Column:
    """The rules that look at one candidate and its class. Columns besides the node's: is_method, class_decorators,
    nest_factory, react, protocol, is_test."""
    path, qn, name = F.col("path"), F.col("qualified_name"), F.coalesce("name", F.lit(""))
    leaf = F.split(F.substring_index(qn, ".", -1), "@", 2)[0]
    member = F.split(leaf, r"\(", 2)[0]
    method = F.col("is_method")
    module = F.replace(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit("/"), F.lit("."))
    symbol = F.regexp_replace(name, r"\s", "")
    quoted = r"(?:'([^']*)'|\"([^\"]*)\")"
    inner = F.when(symbol.rlike(r"\[Symbol\..*\]$") & symbol.startswith("[Symbol."), F.expr(r"regexp_extract(regexp_replace(coalesce(name, ''), '\\s', ''), '^\\[Symbol\\.(.*)\\]$', 1)")).when(symbol.startswith("[Symbol["), F.concat(F.regexp_extract(symbol, rf"^\[Symbol\[{quoted}\]\]$", 1), F.regexp_extract(symbol, rf"^\[Symbol\[{quoted}\]\]$", 2)))
    registry = F.concat(F.regexp_extract(inner, rf"^for\({quoted}\)$", 1), F.regexp_extract(inner, rf"^for\({quoted}\)$", 2))
    nest_class = F.col("nest_factory") | F.coalesce(F.arrays_overlap("class_decorators", F.array(*map(F.lit, NEST_DECORATORS))), F.lit(False))
    own_nest = F.col("own_nest_factory") | _decorated(NEST_DECORATORS)
    return _any(
        [
            _decorated(config.root_decorators),
            F.col("is_exported"),
            F.col("overrides_external"),
            F.col("protocol"),
            method & leaf.rlike("^__.+__$") & (F.length(leaf) > 4) & path.endswith(".py"),
            method & leaf.isin(*ENUM_HOOKS) & path.endswith(".py"),
            ~method & leaf.isin(*GO_ROOTS) & path.endswith(".go"),
            path.endswith(".rs") & F.when(leaf == "main", ~method).otherwise(method & leaf.isin(*RUST_TRAIT_METHODS)),
            method & ends(path, JS_TS) & (inner.isin(*JS_SYMBOLS) | registry.isin(*JS_REGISTRY)),
            leaf.startswith("operator") & ends(path, CPP),
            ~method & leaf.isin(*C_ENTRIES) & ends(path, C_SOURCES) & (qn == F.concat(F.lit(prefix), module, F.lit("."), leaf)),
            method & path.endswith(".java") & member.isin(*JAVA_HOOKS),
            path.endswith(".cs") & _decorated(CSHARP_ATTRIBUTES),
            method & path.endswith(".cs") & member.isin(*CSHARP_DISPOSE),
            path.endswith(".cs") & (leaf.startswith("operator_") | leaf.startswith("~")),
            ends(path, JS_TS) & F.when(~method, own_nest).otherwise(F.col("nest_factory") | (nest_class & member.isin("constructor", *NEST_METHODS))),
            method & ends(path, JS_TS) & member.isin(*REACT_METHODS) & F.col("react"),
            ends(path, JS_TS) & _any([qn.endswith(f"[Symbol.{s}]") for s in JS_SYMBOLS]),
            *[qn.endswith(e) for e in config.entry_points],
            F.lit(config.include_tests) & F.col("is_test"),
        ]
    )


def dead_code(nodes: DataFrame, edges: DataFrame, prefix: str, config: Config = Config()) -> DataFrame:
    """(qualified_name, label, path) of the candidates that nothing reaches."""
    labels = ["Function", "Method"] + ["Class"] * config.include_classes
    walked = ["CALLS", "REFERENCES"] + ["INSTANTIATES", "INHERITS"] * config.include_classes
    from_module = ["CALLS", "REFERENCES"] + ["INSTANTIATES"] * config.include_classes
    code = mark_tests(nodes.where(F.col("label").isin(labels) & F.col("qualified_name").startswith(prefix)), nodes, config)
    code = cut(code if config.include_tests else code.where("not is_test"))

    of = lambda rel: edges.where(F.col("rel_type") == rel)
    inherits, has_method = of("INHERITS"), of("DEFINES_METHOD").select(F.col("src").alias("class"), F.col("dst").alias("member")).distinct()
    protocols = inherits.where(F.col("dst").isin(*PROTOCOLS)).select(F.col("src").alias("class"))
    leaf_of = lambda c: F.substring_index(c, ".", -1)
    react_base = F.col("dst").contains(".") & leaf_of("dst").isin(*REACT_BASES) & (F.lower(F.regexp_replace("dst", r"\.[^.]*$", "")) == "react")
    react = closure(inherits.where(react_base).select(F.col("src").alias("id")), inherits.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("id").alias("class"))
    nest = of("IMPLEMENTS").where(~F.col("dst").startswith(prefix) & leaf_of("dst").endswith("OptionsFactory")).select(F.col("src").alias("class"))
    decorators = nodes.where("label = 'Class'").select(F.col("qualified_name").alias("class"), F.transform("decorators", normal_decorator).alias("class_decorators"))
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    classes = has_method.join(decorators, "class", "left").join(flag(protocols, "protocol"), "class", "left").join(flag(react, "react"), "class", "left").join(flag(nest, "nest_factory"), "class", "left")
    about = classes.groupBy(F.col("member").alias("qualified_name")).agg(F.flatten(F.collect_list("class_decorators")).alias("class_decorators"), *[F.max(c).alias(c) for c in ("protocol", "react", "nest_factory")])
    rows = code.join(about, "qualified_name", "left").join(flag(nest, "own_nest_factory").withColumnRenamed("class", "qualified_name"), "qualified_name", "left")
    rows = rows.withColumn("is_method", F.col("label") == "Method").fillna(False, ["protocol", "react", "nest_factory", "own_nest_factory"])
    by_rule = rows.where(root_rules(config, prefix)).select(F.col("qualified_name").alias("id"))

    path_of = nodes.where("label = 'Module'").select(F.col("qualified_name").alias("src"), F.coalesce("path", F.lit("")).alias("module_path"))
    loads = edges.where(F.col("src_label").eqNullSafe("Module") & F.col("rel_type").isin(from_module)).join(path_of, "src", "left")
    loads = loads if config.include_tests else loads.where(~is_test_path(F.coalesce("module_path", F.lit("")), config.test_patterns))
    roots = by_rule.union(loads.select(F.col("dst").alias("id")).join(code.select(F.col("qualified_name").alias("id")), "id", "left_semi")).distinct()

    links = cut(edges.where(F.col("rel_type").isin(walked)).select("src", "dst").distinct())
    live = closure(roots, links).select("id")
    # once: a decorated function that live code defines is registered when that code runs
    owners = edges.where(F.col("src_label").isin("Function", "Method") & (F.col("rel_type") == "DEFINES"))
    registered = owners.join(live.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).join(code.where(F.size("decorators") > 0).select(F.col("qualified_name").alias("id")), "id", "left_semi").join(live, "id", "left_anti").distinct()
    live = cut(live.union(closure(registered, links).select("id")).distinct())
    # to a fixpoint: classes made in live functions bring their methods, live methods the ones that override them
    nested = owners.where("dst_label = 'Class'").select("src", F.col("dst").alias("class")).distinct()
    overrides = cut(of("OVERRIDES").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    front = live
    while True:
        made = nested.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select("class").distinct()
        methods = made.join(has_method, "class").select(F.col("member").alias("id"))
        over = overrides.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        start = cut(methods.union(over).distinct().join(live, "id", "left_anti"))
        added = cut(made.withColumnRenamed("class", "id").union(closure(start, links).select("id")).distinct().join(live, "id", "left_anti"))
        if added.isEmpty():
            break
        live, front = cut(live.union(added)), added
    dead = code.join(live.withColumnRenamed("id", "qualified_name"), "qualified_name", "left_anti")
    for pattern in config.exclude_patterns:
        dead = dead.where(~F.coalesce("path", F.lit("")).rlike(_glob(pattern)))
    return dead.select("qualified_name", "label", "path")
