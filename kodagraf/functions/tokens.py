"""Token estimates: four characters to a token, floors taken once per text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def estimate(chars: Column) -> Column:
    """Characters to tokens."""
    return F.floor(chars / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def text_tokens(text: Column) -> Column:
    return estimate(F.coalesce(F.length(text), F.lit(0)))


def unit_chars() -> Column:
    return F.length("signature") + F.length("body") + F.coalesce(F.length("docstring"), F.lit(0))


def skeleton_chars() -> Column:
    return F.length("signature") + F.coalesce(F.length("docstring"), F.lit(0))


def unit_tokens() -> Column:
    return estimate(unit_chars())


def skeleton_tokens() -> Column:
    return estimate(skeleton_chars())


def quoted_skeleton_tokens() -> Column:
    """Skeleton with the six quote characters that surround its docstring."""
    doc = F.length("docstring")
    return estimate(F.length("signature") + F.when(doc > 0, doc + 6).otherwise(F.lit(0)))


def quarter(tokens: Column) -> Column:
    """What a unit costs as a skeleton when only its full cost is known."""
    return F.floor(tokens * F.lit(0.25)).cast("bigint")


def compression_ratio(original: Column, skeleton: Column) -> Column:
    return F.when(original == 0, F.lit(0.0)).otherwise(F.lit(1.0) - skeleton / original)
