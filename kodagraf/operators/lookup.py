"""Symbol lookup: by id, name, prefix, substring, pattern, file and line.

Requests come as a DataFrame, so a million lookups are one join. Where several
units qualify, the first is the one with the same letter case, then the smallest
file path, start line and id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions.ids import symbol_name
from kodagraf.schema import SLIM_COLS


def named(units: DataFrame) -> DataFrame:
    """Slim unit rows with their symbol name."""
    return units.select(*SLIM_COLS, symbol_name(F.col("id")).alias("name"))


def _first(order: list[Column], carry: list[str]) -> Column:
    """Aggregate: the row that comes first by ``order``; partial sums stay one row per key."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    return F.min(F.struct(*keys, *carry)).alias("_first")


def _unpack(df: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(f"_first.{c}").alias(c) for c in carry])


UNIT_ORDER = ["file_path", "start_line", "id"]


def distinct_names(units: DataFrame) -> DataFrame:
    return units.select(symbol_name(F.col("id")).alias("name")).distinct()


def by_id(units: DataFrame, ids: DataFrame) -> DataFrame:
    """Units of the wanted ``id`` values."""
    return units.join(ids.select("id").distinct(), "id", "left_semi")


def lookup_exact(units: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, name) -> the first unit of that name, ignoring case.

    Requests are reduced to distinct names, and units to the first of each name, before
    they meet: neither a name that a third of the requests share nor one that a third of
    the units bear makes more than one row.
    """
    wanted = requests.select(F.col("name").alias("wanted")).filter(F.length(F.trim("wanted")) > 0).distinct()
    first = named(units).groupBy("name").agg(_first([F.col(c) for c in UNIT_ORDER], SLIM_COLS))
    u = _unpack(first, ["name"], SLIM_COLS)
    hits = wanted.join(u, F.lower("wanted") == F.lower("name"))
    order = [F.col("name") != F.col("wanted"), *map(F.col, UNIT_ORDER)]
    carry = [*SLIM_COLS, "name"]
    best = _unpack(hits.groupBy("wanted").agg(_first(order, carry)), ["wanted"], carry)
    best = best.withColumnRenamed("name", "symbol_name")
    return requests.join(best, F.col("name") == F.col("wanted")).drop("wanted")


def lookup_prefix(units: DataFrame, requests: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, prefix) -> all units whose name starts with it, ignoring case.

    With ``limit`` only the first so many of each query, in unit order, with their ``position`` and with ``total``, the
    number of all; both are reduced before the shuffle.

    Names are cut to each requested prefix length, which turns the prefix test into
    an equi-join.
    """
    wanted = requests.filter(F.length("prefix") > 0).withColumn("_p", F.lower("prefix"))
    u = named(units).withColumn("_n", F.lower("name"))
    lengths = wanted.agg(F.collect_set(F.length("_p"))).scalar()
    cuts = u.withColumn("_len", F.explode(F.array_intersect(F.sequence(F.lit(1), F.length("_n")), lengths)))
    cuts = cuts.withColumn("_p", F.substring(F.col("_n"), F.lit(1), F.col("_len")))
    found = wanted.join(cuts, "_p").drop("_p", "_n", "_len")
    if limit is None:
        return found
    total = found.groupBy("query_id").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*UNIT_ORDER))
    return found.withColumn("position", place).filter(F.col("position") <= limit).join(total, "query_id")


def search_substring(
    units: DataFrame, needle: str, file_path: str | None = None, limit: int | None = None, compat_like: bool = False
) -> DataFrame:
    """Units whose name contains ``needle``, ignoring case; ``compat_like`` lets ``%`` and ``_`` be wildcards."""
    u = named(units)
    hit = F.col("name").ilike(f"%{needle}%") if compat_like else F.contains(F.lower("name"), F.lower(F.lit(needle)))
    u = u.filter(hit)
    if file_path is not None:
        u = u.filter(F.col("file_path") == file_path)
    return u if limit is None else u.orderBy(*UNIT_ORDER).limit(limit)


def lookup_pattern(units: DataFrame, pattern: str) -> DataFrame:
    """One unit for each distinct name in which the regular expression is found, ignoring case."""
    re.compile(pattern)
    u = named(units).filter(F.col("name").rlike(f"(?iU){pattern}"))
    carry = [*SLIM_COLS]
    return _unpack(u.groupBy("name").agg(_first([F.col(c) for c in UNIT_ORDER], carry)), ["name"], carry)


def units_of_file(units: DataFrame, file_path: str) -> DataFrame:
    return units.filter(F.col("file_path") == file_path).orderBy("start_line", "id")


def units_of_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units of the wanted ``file_path`` values."""
    return units.join(files.select("file_path").distinct(), "file_path", "left_semi")


def symbol_location(units: DataFrame, requests: DataFrame) -> DataFrame:
    found = lookup_exact(units, requests)
    return found.select("query_id", "file_path", F.col("start_line").alias("line"), F.lit(1).cast("bigint").alias("column"))


def at_line(units: DataFrame, requests: DataFrame, nearest: int = 3) -> DataFrame:
    """(query_id, file_path, line) -> the units around the line, else the nearest by start line.

    Windows run per request, over the units of one file, whose size the scan limits.
    """
    joined = requests.join(units.select(*SLIM_COLS), "file_path")
    per_query = Window.partitionBy("query_id")
    by_distance = per_query.orderBy(F.abs(F.col("start_line") - F.col("line")), "start_line", "id")
    ranked = (
        joined.withColumn("contains_line", F.col("line").between(F.col("start_line"), F.col("end_line")))
        .withColumn("_rank", F.row_number().over(by_distance))
        .withColumn("_any", F.max("contains_line").over(per_query))
    )
    return ranked.filter(F.col("contains_line") | (~F.col("_any") & (F.col("_rank") <= nearest))).drop("_rank", "_any")


# Edges of single nodes


def edges_out(edges: DataFrame, nodes: DataFrame, edge_type: str | None = None) -> DataFrame:
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    return e.join(nodes.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def edges_in(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")


def edges_touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a wanted node at either end, each once."""
    wanted = nodes.select("id").distinct()
    out = edges_out(edges, wanted)
    back = edges_in(edges, wanted).join(wanted, F.col("source_id") == F.col("id"), "left_anti")
    return out.unionByName(back.select(*out.columns))


def dependency_ids(edges: DataFrame) -> DataFrame:
    """(id, dependency_id): the dependencies of a unit as rows, since a hub may have any number."""
    return edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("dependency_id")).distinct()
