"""Scores of search hits and priorities of units under a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bounds and boosts.
EXACT, PREFIX, FUZZY = 1.0, 0.8, 0.3
SAME_FILE, SAME_DIR, NEAR_DIR = 0.3, 0.15, 0.05


def prefix_score(query: Column, name: Column) -> Column:
    return F.least(F.lit(0.8) + F.lit(0.2) * F.length(query) / F.length(name), F.lit(0.99))


def match_type(score: Column) -> Column:
    """Label from the score alone, whichever tier produced it."""
    return F.when(score >= 0.99, "exact").when(score >= PREFIX, "prefix").otherwise("fuzzy")


def round3(score: Column) -> Column:
    """Three decimals, ties to even."""
    return F.bround(score, 3)


def dependents_boost(edge_rows: Column) -> Column:
    return F.when(edge_rows > 10, 1.5).when(edge_rows > 5, 1.3).when(edge_rows > 0, 1.1).otherwise(F.lit(1.0))


def keep_priority(n_deps: Column, preserve_interfaces: bool = True, keep_high_centrality: bool = True) -> Column:
    """Order in which units are kept; needs unit_kind, docstring and body."""
    out = F.lit(100.0) / (F.length("body") + 1)
    out = out + F.when(F.length("docstring") > 0, 2.0).otherwise(F.lit(0.0))
    if preserve_interfaces:
        out = out + F.when(F.col("unit_kind").isin("INTERFACE", "CLASS"), 10.0).otherwise(F.lit(0.0))
    if keep_high_centrality:
        out = out + F.when(n_deps > 5, 5.0).otherwise(F.lit(0.0))
    return out
