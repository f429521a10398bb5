"""Source text reduced to its declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HOLE = "    ..."

# Lines copied as they are, blocks copied whole, and lines whose block is left out.
_RULES = {
    "typescript": (
        re.compile(r"(import|from)\s|@"),
        re.compile(r"(export\s+)?(default\s+)?(interface|type|enum|declare)\s"),
        re.compile(
            r"(export\s+)?(default\s+)?(async\s+)?((private|public|protected|static)\s+)?(function\b\s*\*?\s*)?"
            r"[\w$]*\s*\([^)]*\)\s*(:\s*\w+)?\s*"
        ),
    ),
    "go": (
        re.compile(r"(package|import)\s"),
        re.compile(r"type\s+\w+\s+(struct|interface)"),
        re.compile(r"func\s+(\([^)]+\)\s+)?\w+\s*\("),
    ),
    "generic": (re.compile(r"(?!)"), re.compile(r"(?!)"), re.compile(r".*\{")),
}
_KEEPS_CLOSING = {"typescript": False, "go": True, "generic": True}


def _net(line: str) -> int:
    return line.count("{") - line.count("}")


def braces_skeleton(source: str, family: str, docs: bool = True) -> str:
    """Languages with braces: bodies of functions become one ``...`` line."""
    single, whole, head = _RULES[family]
    out: list[str] = []
    lines = iter(source.split("\n"))
    for line in lines:
        text = line.lstrip()
        out.append(line)
        if not text or single.match(text):
            continue
        if whole.match(text):
            depth = _net(text)
            while depth > 0 and (line := next(lines, None)) is not None:
                out.append(line)
                depth += _net(line)
        elif head.match(text):
            _skip_body(lines, out, text, _KEEPS_CLOSING[family], docs)
    return "\n".join(out)


def _skip_body(lines: Iterator[str], out: list[str], opening: str, keep_closing: bool, docs: bool) -> None:
    depth = _net(opening)
    if "{" not in opening:
        line = next(lines, None)
        if line is None:
            return
        out.append(line)
        depth = _net(line)
    if depth <= 0:
        return
    in_doc = docs
    hole = False
    for line in lines:
        text = line.strip()
        if in_doc and not hole and text.startswith(("/*", "*")):
            out.append(line)
            in_doc = "*/" not in text
            continue
        if not hole:
            out.append(HOLE)
            hole = True
        depth += _net(line)
        if depth <= 0:
            if keep_closing:
                out.append(line)
            return


def python_skeleton(source: str, docs: bool = True) -> str:
    """Python: imports, decorators, ``def``/``class`` lines, docstrings and top-level code."""
    out: list[str] = []
    inside: int | None = None  # indent of the header whose body is being left out
    lines = source.split("\n")
    pos = 0
    while pos < len(lines):
        line = lines[pos]
        pos += 1
        text = line.lstrip()
        indent = len(line) - len(text)
        header = re.match(r"(async\s+def|def|class)\s", text)
        if header:
            inside = indent
            out.append(line)
            doc = re.match(r"[rRuU]?(\"\"\"|''')", lines[pos].lstrip()) if pos < len(lines) else None
            if doc:
                last = pos
                opened = lines[pos].lstrip()[doc.end() :]
                while doc.group(1) not in opened and last + 1 < len(lines):
                    last += 1
                    opened = lines[last]
                if docs:
                    out.extend(lines[pos : last + 1])
                pos = last + 1
            if header.group(1) != "class":
                out.append(" " * (indent + 4) + "...")
        elif not text:
            if inside is None:
                out.append(line)
        elif text.startswith(("import ", "from ")) or inside is None or indent <= inside:
            out.append(line)
            if inside is not None and indent <= inside and not text.startswith("@"):
                inside = None
    return "\n".join(out)


def skeleton_text(source: str, language: str, docs: bool = True) -> str:
    if language == "python":
        return python_skeleton(source, docs)
    family = {"typescript": "typescript", "javascript": "typescript", "go": "go"}.get(language, "generic")
    return braces_skeleton(source, family, docs)


def signatures_only(source: Column, language: Column, preserve_docstrings: bool = True) -> Column:
    """Column form of :func:`skeleton_text`."""

    @F.pandas_udf("string")
    def reduce_source(src: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([skeleton_text(s, x, preserve_docstrings) if s is not None else None for s, x in zip(src, lang)])

    return reduce_source(source, language)
