"""What may be asked: read-only statements, bounded paths, known procedures."""

from __future__ import annotations

import re

# Keywords that change a graph, and the algorithms that can be called.
WRITES = ("DELETE", "DETACH", "SET", "REMOVE", "CREATE", "MERGE", "DROP", "LOAD", "FOREACH", "ALTER")
PROCEDURES = ("degree", "components", "strongly_connected", "pagerank", "shortest_paths", "closure", "topological_levels", "similarity")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|//[^\n]*|/\*.*?\*/", re.S)


def check(statement: str, procedures: tuple[str, ...] = PROCEDURES) -> None:
    """Raises for writes, for paths without an upper bound, and for procedures off the list. Quoted text and comments don't count."""
    bare = _QUOTED.sub(" ", statement)
    for word in WRITES:
        if re.search(rf"\b{word}\b", bare, re.I):
            raise ValueError(f"{word} is not allowed in a read-only query")
    for m in re.finditer(r"\[[^\]]*?\*\s*(\d*)\s*(\.\.)?\s*(\d*)[^\]]*\]", bare):
        if not m[3] and (m[2] or not m[1]):
            raise ValueError("a path needs an upper bound")
    for name in re.findall(r"\bCALL\s+([\w.]+)", bare, re.I):
        if name.rsplit(".", 1)[-1].lower() not in procedures and name.split(".")[0].lower() not in procedures:
            raise ValueError(f"{name} is not a known procedure")
