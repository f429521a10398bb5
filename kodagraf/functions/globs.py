"""Glob patterns as regular expressions, and the ignore rules built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and globs that a scan leaves out unless told otherwise.
DEFAULT_IGNORES = """
.git .gitignore .hg .svn
node_modules dist build vendor target
.cache __pycache__ .venv venv .env *.pyc *.pyo *.so *.dylib *.dll
*.o *.a *.lib *.exe
.DS_Store Thumbs.db .idea .vscode *.swp *.swo *~
coverage .pytest_cache .mypy_cache .tox htmlcov
_build site .docusaurus
""".split()


def glob_regex(pattern: str) -> str:
    """Shell glob to an unanchored-by-``/`` Java regex: ``*`` also crosses ``/``."""
    parts = re.split(r"(\*+|\?|\[!?\]?[^\]]*\])", pattern)
    out = []
    for part in parts:
        if part.startswith("*"):
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif len(part) > 2 and part[0] == "[" and part[-1] == "]":
            inner = part[1:-1].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
        else:
            out.append(re.sub(r"([\\.^$|(){}+\[\]])", r"\\\1", part))
    return "".join(out)


def any_glob(patterns: list[str]) -> str:
    """One anchored regex for "matches one of these globs"."""
    return r"(?s)\A(?:" + "|".join(glob_regex(p) for p in patterns) + r")\z" if patterns else r"(?!)"


def glob_regex_col(pattern: Column) -> Column:
    """:func:`glob_regex` for patterns that are data (lines of ignore files)."""
    escaped = F.regexp_replace(pattern, r"([\\.^$|(){}+])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(escaped, r"\*+", ".*"), r"\?", ".")
    return F.regexp_replace(starred, r"\[!", "[^")


def prefixes(path: Column) -> Column:
    """All leading directory paths of a path, shortest first, without the path itself."""
    pieces = F.split(path, "/")
    ends = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda n: F.array_join(F.slice(pieces, 1, n), "/"))


def dir_ignored(rel_dir: Column, patterns: list[str]) -> Column:
    """A directory is left out when its relative path or its name matches."""
    rx = any_glob(patterns)
    return rel_dir.rlike(rx) | F.substring_index(rel_dir, "/", -1).rlike(rx)


def path_ignored(rel_path: Column, patterns: list[str]) -> Column:
    """A file is left out by its path, its name, or any directory above it."""
    rx = any_glob(patterns)
    components = F.split(rel_path, "/")
    return (
        rel_path.rlike(rx)
        | F.exists(components, lambda c: c.rlike(rx))
        | F.exists(prefixes(rel_path), lambda p: p.rlike(rx))
    )


def config_ignored(rel_path: Column, patterns: list[str]) -> Column:
    """Configuration rule: any component, the whole path, or everything below ``dir/*``, ``dir/**``."""
    below = [re.sub(r"/\*{1,2}$", "", p) for p in patterns if re.search(r"/\*{1,2}$", p)]
    rx, rx_dir = any_glob(patterns), any_glob(below)
    return (
        rel_path.rlike(rx)
        | F.exists(F.split(rel_path, "/"), lambda c: c.rlike(rx))
        | F.exists(prefixes(rel_path), lambda p: p.rlike(rx_dir))
    )


def event_ignored(path: Column, patterns: list[str]) -> Column:
    """Watch rule: the whole path or any component."""
    rx = any_glob(patterns)
    return path.rlike(rx) | F.exists(F.split(path, "/"), lambda c: c.rlike(rx))
