"""Labels, keys, properties and allowed relationships of the code graph: the one source for table schemas and audits."""

from __future__ import annotations

from pyspark.sql import types as T

# Node labels, and the property that identifies a node of each.
KEYS = {
    "Project": "name", "Package": "qualified_name", "Folder": "absolute_path", "File": "absolute_path", "Module": "qualified_name",
    "Class": "qualified_name", "Function": "qualified_name", "Method": "qualified_name", "Interface": "qualified_name", "Enum": "qualified_name",
    "Type": "qualified_name", "Union": "qualified_name", "ModuleInterface": "qualified_name", "ModuleImplementation": "qualified_name",
    "ExternalPackage": "name", "ExternalModule": "qualified_name", "Resource": "qualified_name", "Pattern": "qualified_name", "CodeSmell": "qualified_name", "SecurityIssue": "qualified_name",
}
LABELS = tuple(KEYS)

# Relationship types with the labels they may lead from and to.
_HOLDERS = "Project Package Folder"
_CODE = "Module Function Method"
RELATIONSHIPS = [
    ("CONTAINS_PACKAGE", _HOLDERS, "Package"), ("CONTAINS_FOLDER", _HOLDERS, "Folder"), ("CONTAINS_FILE", _HOLDERS, "File"), ("CONTAINS_MODULE", _HOLDERS, "Module"),
    ("DEFINES", "Module Function Method Class", "Class Function Method Enum Interface Type Union Module"), ("DEFINES_METHOD", "Class Interface Enum Type Union", "Method"),
    ("IMPORTS", "Module", "Module ExternalModule"), ("EXPORTS", "Module", "Class Function"), ("EXPORTS_MODULE", "Module", "ModuleInterface"), ("IMPLEMENTS_MODULE", "Module", "ModuleImplementation"),
    ("INHERITS", "Class Interface Function", "Class Interface Function ExternalModule"), ("IMPLEMENTS", "Class Enum", "Interface Class Enum ExternalModule"), ("OVERRIDES", "Method Function", "Method"),
    ("IMPLEMENTS", "ModuleImplementation", "ModuleInterface"), ("DEPENDS_ON_EXTERNAL", "Project", "ExternalPackage"), ("CALLS", _CODE, "Function Method Enum Type"), ("REFERENCES", _CODE, "Function Method Class"),
    ("INSTANTIATES", _CODE, "Class"), ("READS_FROM", _CODE, "Resource"), ("WRITES_TO", _CODE, "Resource"), ("FLOWS_TO", f"{_CODE} Resource", f"{_CODE} Resource"), ("EXPOSES", "Function Method File", "Resource"),
    ("RESOLVES_TO", "Resource", "Resource"), ("IMPLEMENTS_PATTERN", "Module", "Pattern"), ("HAS_SMELL", "Module", "CodeSmell"), ("HAS_VULNERABILITY", "Module", "SecurityIssue"),
]
TRIPLES = {(a, rel, b) for rel, of, to in RELATIONSHIPS for a in of.split() for b in to.split()}

# Properties of each label, ? for optional ones.
_NAMED = "qualified_name name path absolute_path"
_OPEN = f"{_NAMED} modifiers? decorators? start_col? start_line? end_line? docstring? is_exported?"
_PROPERTIES = {
    "Project": "name root_path?", "Package": _NAMED, "Folder": "path name absolute_path", "File": "path name extension? absolute_path",
    "Module": f"{_NAMED} flow_covered? generated? generator? start_line? end_line? decorators? rust_cfg_test_mods? rust_ungated_mods?",
    "Class": f"{_NAMED} modifiers decorators start_col? start_line? end_line? docstring? is_exported?",
    "Function": f"{_NAMED} modifiers decorators start_col? name_start_line? name_start_col? start_line? end_line? docstring? is_exported? is_macro?",
    "Method": f"{_NAMED} modifiers decorators start_col? name_start_line? name_start_col? start_line? end_line? docstring? is_exported? is_property? overrides_external?",
    "Interface": _OPEN, "Enum": _OPEN, "Type": _OPEN.replace("path absolute_path", "path? absolute_path?"), "Union": _OPEN.replace("path absolute_path", "path? absolute_path?"),
    "ModuleInterface": f"{_NAMED} module_type", "ModuleImplementation": f"{_NAMED} implements_module module_type", "ExternalPackage": "name", "ExternalModule": "qualified_name name path", "Resource": "qualified_name name kind",
}
PROPERTIES = {label: {p.rstrip("?"): not p.endswith("?") for p in spec.split()} for label, spec in _PROPERTIES.items()}

_LISTS = "modifiers decorators rust_cfg_test_mods rust_ungated_mods".split()
_NUMBERS = "start_col start_line end_line name_start_line name_start_col".split()
_FLAGS = "flow_covered generated is_exported is_macro is_property overrides_external".split()


def _type(p: str) -> T.DataType:
    return T.ArrayType(T.StringType()) if p in _LISTS else T.LongType() if p in _NUMBERS else T.BooleanType() if p in _FLAGS else T.StringType()


def nodes_schema() -> T.StructType:
    """One wide table: label, key, then every property that some label has."""
    names = dict.fromkeys(p for spec in PROPERTIES.values() for p in spec)
    return T.StructType([T.StructField("label", T.StringType()), T.StructField("key", T.StringType()), *(T.StructField(p, _type(p)) for p in names)])


def edges_schema() -> T.StructType:
    return T.StructType.fromDDL("src_label string, src string, rel_type string, dst_label string, dst string, via string, kind string, base_index int, props map<string,string>")
