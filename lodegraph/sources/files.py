"""Source trees: eligible files, packages and folders, dependency manifests, and Python definitions and calls."""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED = (".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", ".mypy_cache", ".pytest_cache", ".tox", "target")


def _matches(pattern: str) -> Callable[[Column], Column]:
    regex = "^" + fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")
    return lambda name: name.rlike(regex)


def eligible(files: DataFrame, ignore: tuple[str, ...] = IGNORED, unignore: tuple[str, ...] = ()) -> DataFrame:
    """files (path, …) none of whose folders or names match an ignore pattern; a path below an unignored one stays."""
    parts = F.split("path", "/")
    bad = F.lit(False)
    for p in ignore:
        bad = bad | F.exists(parts, _matches(p.rstrip("/")))
    keep = F.lit(False)
    for p in unignore:
        keep = keep | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
    return files.where(~bad | keep)


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path below the root, text, hash) of every file whose name fits. Spark's own file sources skip names that begin with an
    underscore, which source trees have, so the driver lists the names and tasks read the contents."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    listed, found = fs.listFiles(top, True), []
    while listed.hasNext():
        uri = listed.next().getPath().toString()
        if fnmatch.fnmatchcase(uri.rsplit("/", 1)[-1], glob):
            found.append((uri, uri.removeprefix(base)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for b in batches:
            rows = []
            for uri, path in zip(b["uri"], b["path"], strict=True):
                store, at = FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
                with store.open_input_stream(at) as f:
                    content = f.read()
                rows.append((path, content.decode("utf-8", "replace"), hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "text", "hash"])

    names = spark.createDataFrame(found, "uri string, path string")
    return names.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "path string, text string, hash string")


def structure(files: DataFrame, project: str, indicators: tuple[str, ...] = ("__init__.py",)) -> tuple[DataFrame, DataFrame]:
    """(folders, containment) from files (path): every folder above a file, a package if it holds an indicator file, and which
    folder holds which folder or file. The top is the project."""
    names = F.split("path", "/")
    ups = files.select(F.explode(F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/")))).alias("path")).distinct()
    marked = files.where(F.element_at(names, -1).isin(*indicators) & (F.size(names) > 1)).select(F.array_join(F.slice(names, 1, F.size(names) - 1), "/").alias("path")).distinct().withColumn("_p", F.lit(True))
    label = F.when(F.col("_p"), "Package").otherwise("Folder")
    folders = ups.join(marked, "path", "left").select("path", label.alias("label"), F.substring_index("path", "/", -1).alias("name"), F.concat_ws(".", F.lit(project), F.replace("path", F.lit("/"), F.lit("."))).alias("qualified_name"))
    holder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    inside = folders.select(holder.alias("holder"), "path", F.when(F.col("label") == "Package", "CONTAINS_PACKAGE").otherwise("CONTAINS_FOLDER").alias("rel_type")).union(files.select(holder, "path", F.lit("CONTAINS_FILE")))
    return folders, inside


DEPENDENCY = "path string, name string, version string"
_REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$")


def _requirement(line: str) -> tuple[str, str] | None:
    line = line.split("#")[0].split(";")[0].strip()
    m = None if not line or line.startswith("-") else _REQUIREMENT.match(line)
    return (m[1], m[2].strip()) if m else None


def parse_manifest(path: str, text: str) -> list[tuple[str, str]]:
    """(name, version) of a manifest's dependencies, in its order; nothing for other files or broken ones."""
    name = path.rsplit("/", 1)[-1]
    as_text = lambda v: v if isinstance(v, str) else v.get("version", "") if isinstance(v, dict) else ""
    try:
        if name == "pyproject.toml":
            doc = tomllib.loads(text)
            lines = [*doc.get("project", {}).get("dependencies", []), *(x for v in doc.get("project", {}).get("optional-dependencies", {}).values() for x in v)]
            poetry = {k: v for k, v in doc.get("tool", {}).get("poetry", {}).get("dependencies", {}).items() if k.lower() != "python"}
            return [*filter(None, map(_requirement, lines)), *((k, as_text(v)) for k, v in poetry.items())]
        if re.fullmatch(r"requirements.*\.txt", name):
            return [*filter(None, map(_requirement, text.splitlines()))]
        if name in ("package.json", "composer.json"):
            doc = json.loads(text)
            return [(k, as_text(v)) for part in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev") for k, v in doc.get(part, {}).items() if k != "php"]
        if name == "Cargo.toml":
            doc = tomllib.loads(text)
            return [(k, as_text(v)) for part in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in doc.get(part, {}).items()]
        if name == "go.mod":
            return re.findall(r"^(?:require\s+|\t)\s*([\w./~-]+\.[\w./~-]+)\s+(v[\w.+-]+)", text, re.M)
        if name == "Gemfile":
            lines = [x.split("#")[0].split() for x in text.replace(",", " , ").splitlines()]
            given = [[p.strip("'\"") for p in " ".join(x[1:]).split(" , ")] for x in lines if x[:1] == ["gem"] and len(x) > 1]
            return [(p[0], p[1] if len(p) > 1 and ":" not in p[1] else "") for p in given]
        if name == "pubspec.yaml":
            part = re.findall(r"^(?:dev_)?dependencies:\n((?:[ \t]+.*\n?|\n)*)", text, re.M)
            return [(a, b.strip()) for p in part for a, b in re.findall(r"^  ([A-Za-z_]\w*):[ \t]*(.*)$", p, re.M)]
        if name.endswith(".csproj"):
            return [(e.get("Include"), e.get("Version") or "") for e in ElementTree.fromstring(text).iter() if e.tag.rsplit("}", 1)[-1] == "PackageReference" and e.get("Include")]
    except (ValueError, ElementTree.ParseError, AttributeError):
        return []
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """files (path, text) to (path, name, version)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, n, v) for p, t in zip(b["path"], b["text"], strict=True) for n, v in parse_manifest(p, t or "")], columns=["path", "name", "version"])

    return files.select("path", "text").mapInPandas(run, DEPENDENCY)


FACT = "fact string, path string, owner string, label string, name string, target string, start_line long, end_line long, decorators array<string>"


def python_facts(files: DataFrame, project: str) -> DataFrame:
    """Python files (path, text) to facts: definitions (owner defines name), bases, imports and calls as written, each with the
    qualified name of the scope around it. A file that doesn't parse gives its module alone."""

    def module_name(path: str) -> str:
        parts = path.removesuffix(".py").split("/")
        return ".".join([project, *(parts[:-1] if parts[-1] == "__init__" else parts)])

    def walk(path: str, text: str) -> Iterator[tuple]:
        module = module_name(path)
        yield ("definition", path, None, "Module", module, None, 1, text.count("\n") + 1, [])
        try:
            top = ast.parse(text)
        except (SyntaxError, ValueError):
            return
        todo = [(top, module, "Module")]
        while todo:
            node, owner, kind = todo.pop()
            for child in ast.iter_child_nodes(node):
                here, label = owner, kind
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    is_class = isinstance(child, ast.ClassDef)
                    label = "Class" if is_class else "Method" if kind == "Class" else "Function"
                    here = f"{owner}.{child.name}"
                    yield ("definition", path, owner, label, here, None, child.lineno, child.end_lineno, ["@" + ast.unparse(d) for d in child.decorator_list])
                    for base in child.bases if is_class else ():
                        yield ("base", path, here, label, here, ast.unparse(base), child.lineno, child.end_lineno, [])
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield ("import", path, module, "Module", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], child.lineno, child.end_lineno, [])
                elif isinstance(child, ast.ImportFrom):
                    up = module.split(".")[: -child.level] if child.level else []
                    base = ".".join([*up, *([child.module] if child.module else [])])
                    for a in child.names:
                        yield ("import", path, module, "Module", a.asname or a.name, f"{base}.{a.name}", child.lineno, child.end_lineno, [])
                elif isinstance(child, ast.Call):
                    yield ("call", path, owner, kind, ast.unparse(child.func).rsplit(".", 1)[-1], ast.unparse(child.func), child.lineno, child.end_lineno, [])
                todo.append((child, here, label))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"], strict=True) for r in walk(p, t or "")], columns=[c.split()[0] for c in FACT.split(", ")])

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, FACT)


def python_graph(facts: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from python_facts: definitions, and calls and bases that resolve by the scope's own names or its imports."""
    nodes = facts.where("fact = 'definition'").groupBy(F.col("name").alias("qualified_name")).agg(F.min_by(F.struct("label", "path", "start_line", "end_line", "decorators", "owner"), "start_line").alias("n")).select("qualified_name", "n.*")
    defines = nodes.where("owner is not null").select(F.col("owner").alias("src"), F.when(F.col("label") == "Method", "DEFINES_METHOD").otherwise("DEFINES").alias("rel_type"), F.col("qualified_name").alias("dst"))
    modules = nodes.where("label = 'Module'").select("path", F.col("qualified_name").alias("module"))
    used = facts.where("fact in ('call', 'base')").join(modules, "path")
    head, rest = F.substring_index("target", ".", 1), F.when(F.instr("target", ".") > 0, F.expr("substring(target, instr(target, '.'))")).otherwise("")
    imports = facts.where("fact = 'import'").select("path", F.col("name").alias("alias"), F.col("target").alias("imported"))
    bound = used.withColumn("alias", head).join(imports, ["path", "alias"], "left")
    self_ = F.when(head.isin("self", "cls"), F.concat(F.regexp_replace("owner", r"\.[^.]*$", ""), rest))
    options = F.array_compact(F.array(self_, F.concat("imported", rest), F.concat_ws(".", "owner", "target"), F.concat_ws(".", "module", "target"), F.concat_ws(".", F.lit(project), F.concat("imported", rest))))
    tried = bound.select("fact", "owner", F.col("start_line").alias("line"), "target", F.posexplode(options).alias("rank", "qualified_name"))
    met = tried.join(nodes.select("qualified_name", "label"), "qualified_name").groupBy("fact", "owner", "line", "target").agg(F.min_by(F.struct("qualified_name", "label"), "rank").alias("b"))
    rel = F.when(F.col("fact") == "base", "INHERITS").when(F.col("b.label") == "Class", "INSTANTIATES").otherwise("CALLS")
    return nodes, defines.union(met.select(F.col("owner").alias("src"), rel.alias("rel_type"), F.col("b.qualified_name").alias("dst"))).distinct()
