"""Named requests with checked parameters, answered as DataFrames or as JSON rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodagraf.operators import context, repomap, search
from kodagraf.params import (
    BUILD_QUERY_CHARS,
    CONTEXT_TOKENS,
    DEPTH,
    MAX_ENTRIES,
    MAX_SYMBOLS_PER_MODULE,
    SEARCH_LIMIT,
    SEARCH_QUERY_CHARS,
    BuildConfig,
    text_within,
    within,
)
from kodagraf.plans import catalog


@dataclass(frozen=True)
class Parameter:
    bounds: tuple[int, int]
    default: Any = None
    text: bool = False

    def checked(self, name: str, value: Any) -> Any:
        value = self.default if value is None else value
        return text_within(name, value, self.bounds) if self.text else within(name, value, self.bounds)


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Parameter]
    run: Callable[[CodeIndex, dict[str, Any]], DataFrame]

    def describe(self) -> dict[str, Any]:
        props = {
            k: {"type": "string", "minLength": p.bounds[0], "maxLength": p.bounds[1]}
            if p.text
            else {"type": "integer", "minimum": p.bounds[0], "maximum": p.bounds[1], "default": p.default}
            for k, p in self.parameters.items()
        }
        needed = [k for k, p in self.parameters.items() if p.default is None]
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": props, "required": needed}}


@dataclass
class CodeIndex:
    """The unit and edge tables, with importance scores kept between requests until told otherwise."""

    units: DataFrame
    edges: DataFrame
    rank_options: dict[str, Any] = field(default_factory=dict)
    _scores: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    def scores(self) -> DataFrame:
        if self._scores is None:
            self._scores = repomap.importance(self.units, self.edges, **self.rank_options).persist()
        return self._scores

    def invalidate(self) -> None:
        if self._scores is not None:
            self._scores.unpersist()
        self._scores = None

    def one(self, column: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(0, value)], f"query_id bigint, {column} string")


TOOLS: dict[str, Tool] = {}
QUERY_TEXT = Parameter(BUILD_QUERY_CHARS, text=True)
SYMBOL = Parameter(SEARCH_QUERY_CHARS, text=True)


def add_tool(name: str, description: str, **parameters: Parameter):
    def keep(run: Callable[[CodeIndex, dict[str, Any]], DataFrame]):
        TOOLS[name] = Tool(name, description, parameters, run)
        return run

    return keep


@add_tool("search_symbol", "Symbols by exact, prefix or similar name.", query=SYMBOL, limit=Parameter(SEARCH_LIMIT, 10))
def _(ix, p):
    found = search.search_symbols(ix.units, ix.one("query", p["query"]), p["limit"])
    return found.select(
        F.col("name").alias("symbol_name"), F.col("id").alias("unit_id"), "unit_kind", "file_path",
        F.col("start_line").alias("line_number"), "match_score", "match_type", "signature", "rank",
    ).orderBy("rank")


@add_tool("get_symbol_context", "A symbol with its direct dependencies.", symbol_name=SYMBOL)
def _(ix, p):
    return context.symbol_context(ix.units, ix.edges, ix.one("name", p["symbol_name"])).drop("query_id")


@add_tool("expand_dependencies", "Everything a symbol depends on.", symbol_name=SYMBOL, depth=Parameter(DEPTH, 1))
def _(ix, p):
    rows = context.expand_dependencies(ix.units, ix.edges, ix.one("name", p["symbol_name"]), p["depth"])
    return rows.drop("query_id").orderBy("file_path", "line", "id")


@add_tool(
    "get_repo_map", "The most important symbols by module.",
    max_entries=Parameter(MAX_ENTRIES, 100), max_symbols_per_module=Parameter(MAX_SYMBOLS_PER_MODULE, 10),
)
def _(ix, p):
    rows = repomap.build_map(ix.units, ix.scores(), p["max_entries"], p["max_symbols_per_module"])
    return rows.withColumn("score", F.bround("score", 3)).orderBy("position")


@add_tool(
    "build_context", "The code that a request in words is about, within a token budget.",
    query=QUERY_TEXT, max_tokens=Parameter(CONTEXT_TOKENS, 4000), dependency_depth=Parameter(DEPTH, 1),
)
def _(ix, p):
    config = BuildConfig(dependency_depth=p["dependency_depth"], max_context_tokens=p["max_tokens"], enforce_budget=True)
    asked = ix.one("query", p["query"])
    rows = context.build_context(ix.units, ix.edges, asked, config)
    return context.context_text(asked, rows).drop("query_id")


def call(ix: CodeIndex, name: str, arguments: dict[str, Any] | None = None) -> DataFrame:
    """The answer of one request; unknown names, unknown parameters and values out of bounds raise ``ValueError``."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}, known are {sorted(TOOLS)}")
    tool, given = TOOLS[name], dict(arguments or {})
    extra = sorted(set(given) - set(tool.parameters))
    if extra:
        raise ValueError(f"{name} has no parameters {extra}")
    return tool.run(ix, {k: p.checked(k, given.get(k)) for k, p in tool.parameters.items()})


def call_json(ix: CodeIndex, name: str, arguments: dict[str, Any] | None = None) -> DataFrame:
    """:func:`call` with each row as a JSON text."""
    rows = call(ix, name, arguments)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def call_batch(ix: CodeIndex, requests: list[tuple[str, dict[str, Any]]]) -> list[DataFrame]:
    return [call(ix, name, arguments) for name, arguments in requests]


def list_tools() -> list[dict[str, Any]]:
    return [t.describe() for t in TOOLS.values()]


def registered_queries() -> list[str]:
    return list(catalog.QUERIES)
