"""Candidate symbol names in a natural-language request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of names, in the order in which they are looked for.
BACKTICK = r"`([^`]+)`"
SINGLE_QUOTED = r"'([a-zA-Z_][a-zA-Z0-9_]*)'"
DOUBLE_QUOTED = r'"([a-zA-Z_][a-zA-Z0-9_]*)"'
CAMEL_CASE = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\b"
SNAKE_CASE = r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)*)\b"

# Words that are no symbol names.
COMMON_WORDS = """
the and for are but not you all can had her was one our out day get has him his how its may new now old
see two who boy did she use way many oil sit set run eat far sea eye ago off too any try ask end why let
put say own tell very when much would there their what said each which will about could other after first
never these think where being every great might shall still those while this that with have from they know
want been good some time than them well were look more find here over such take make come made most only
work life even back into just also your call came dont feel seem turn hand part move both five once same
must name left done open case show live play went told seen hear talk soon read stop face fact land line
kind next word need high sure upon head help home side
""".split()


def _all(query: Column, pattern: str) -> Column:
    # (?U): word boundaries as for Unicode text; the letter classes stay ASCII.
    return F.regexp_extract_all(query, F.lit("(?U)" + pattern), F.lit(1))


def query_symbols(query: Column) -> Column:
    """Ordered distinct candidates: quoted names, CamelCase, then snake_case words."""
    snake = F.filter(_all(query, SNAKE_CASE), lambda w: ~w.isin(COMMON_WORDS))
    found = F.concat(
        _all(query, BACKTICK),
        _all(query, SINGLE_QUOTED),
        _all(query, DOUBLE_QUOTED),
        _all(query, CAMEL_CASE),
        snake,
    )
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))
