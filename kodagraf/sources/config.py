"""Settings of an index, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from kodagraf.functions.globs import DEFAULT_IGNORES

FILE_NAME = ".kodagraf.json"
# What may be named as a language or a log level.
KNOWN_LANGUAGES = "python typescript javascript go rust java cpp c ruby php swift kotlin".split()
LOG_LEVELS = "DEBUG INFO WARNING ERROR CRITICAL".split()


@dataclass(frozen=True)
class IndexConfig:
    languages: list[str] = field(default_factory=lambda: ["python", "typescript", "javascript", "go", "rust", "java", "cpp"])
    watch: bool = True
    ignore_patterns: list[str] = field(default_factory=lambda: list(DEFAULT_IGNORES))
    project_root: str = "."
    max_file_size: int = 1_048_576
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        unknown = sorted(set(self.languages) - set(KNOWN_LANGUAGES))
        if not self.languages or unknown:
            raise ValueError(f"languages must be some of {KNOWN_LANGUAGES}, got {self.languages}")
        if self.log_level.upper() not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {LOG_LEVELS}, got {self.log_level}")
        if self.max_file_size < 1024:
            raise ValueError("max_file_size must be at least 1024")
        object.__setattr__(self, "log_level", self.log_level.upper())


def load_config(path: str | None = None, project_root: str = ".") -> IndexConfig:
    """From ``path``, else from the working folder, else from the project root, else the defaults."""
    places = [Path(path)] if path else [Path(FILE_NAME), Path(project_root) / FILE_NAME]
    for place in places:
        if place.exists():
            return replace(IndexConfig(project_root=project_root), **json.loads(place.read_text()))
    if path:
        raise FileNotFoundError(path)
    return IndexConfig(project_root=project_root)


def save_config(config: IndexConfig, path: str | None = None) -> Path:
    target = Path(path) if path else Path(config.project_root) / FILE_NAME
    target.write_text(json.dumps(asdict(config), indent=2))
    return target
