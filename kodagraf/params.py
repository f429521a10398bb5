"""Parameters of the operators and the limits a request has to keep."""

from __future__ import annotations

from dataclasses import dataclass

# The limits of the request parameters.
MAX_ENTRIES = (10, 500)
MAX_SYMBOLS_PER_MODULE = (1, 50)
SEARCH_QUERY_CHARS = (1, 200)
BUILD_QUERY_CHARS = (1, 1000)
SEARCH_LIMIT = (1, 100)
DEPTH = (1, 3)
CONTEXT_TOKENS = (500, 16000)


@dataclass(frozen=True)
class BuildConfig:
    """How a context bundle is built."""

    dependency_depth: int = 1
    max_context_tokens: int = 4000
    include_repo_map: bool = True
    skeletonize_dependencies: bool = True
    prioritize_same_file: bool = True
    enforce_budget: bool = False

    def __post_init__(self) -> None:
        within("dependency_depth", self.dependency_depth, DEPTH)
        within("max_context_tokens", self.max_context_tokens, CONTEXT_TOKENS)


@dataclass(frozen=True)
class PruneConfig:
    """How a dependency set is cut down to a token budget."""

    max_depth: int = 2
    max_tokens: int = 4000
    keep_high_centrality: bool = True
    preserve_interfaces: bool = True


def within(name: str, value: int, bounds: tuple[int, int]) -> int:
    low, high = bounds
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}, got {value!r}")
    return value


def text_within(name: str, value: str, bounds: tuple[int, int]) -> str:
    if not isinstance(value, str) or not bounds[0] <= len(value) <= bounds[1]:
        raise ValueError(f"{name} must have {bounds[0]} to {bounds[1]} characters")
    return value
