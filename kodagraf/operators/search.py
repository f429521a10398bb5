"""Ranked symbol search: exact, prefix and similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions import scoring
from kodagraf.functions.fuzzy import nearest_names
from kodagraf.functions.ids import parent_dir
from kodagraf.operators.lookup import UNIT_ORDER, _first, _unpack, distinct_names, named
from kodagraf.params import SEARCH_LIMIT, within
from kodagraf.runtime import cut
from kodagraf.schema import SLIM_COLS


def exact_and_prefix(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, query, name, score, tier): equal names (tier 0) and names that start with the query (tier 1)."""
    q = queries.select("query_id", "query").filter(F.length("query") > 0).withColumn("_q", F.lower("query"))
    n = names.withColumn("_n", F.lower("name"))
    lengths = q.agg(F.collect_set(F.length("_q"))).scalar()
    cuts = n.withColumn("_len", F.explode(F.array_intersect(F.sequence(F.lit(1), F.length("_n")), lengths)))
    cuts = cuts.withColumn("_q", F.substring(F.col("_n"), F.lit(1), F.col("_len")))
    equal = F.col("_len") == F.length("_n")
    score = F.when(equal, F.lit(scoring.EXACT)).otherwise(scoring.prefix_score(F.col("query"), F.col("name")))
    return q.join(cuts, "_q").select(
        "query_id", "query", "name", score.alias("score"), F.when(equal, 0).otherwise(1).alias("tier")
    )


def ranked_names(units: DataFrame, queries: DataFrame, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """(query_id, query, name, score, tier, rank): the best ``limit`` names of each query."""
    names = cut(distinct_names(units), "names") if fuzzy else distinct_names(units)
    hits = exact_and_prefix(queries, names).withColumn("pos", F.lit(0))
    if fuzzy:
        found = hits.groupBy("query_id").agg(F.count("*").alias("_n"))
        short = (
            queries.select("query_id", "query")
            .filter(F.length("query") > 0)
            .join(found, "query_id", "left")
            .filter(F.coalesce("_n", F.lit(0)) < limit)
        )
        near = nearest_names(cut(short, "short"), names, k=2 * limit, cutoff=scoring.FUZZY)
        near = near.filter(~F.startswith(F.lower("name"), F.lower("query")) & (F.col("score") >= scoring.FUZZY))
        hits = hits.unionByName(
            near.select("query_id", "query", "name", "score", F.lit(2).alias("tier"), F.col("rank").alias("pos"))
        )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "tier", "pos", "name")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("pos")


def search(units: DataFrame, queries: DataFrame, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """Search results with their units: one unit per name, the first in unit order."""
    hits = ranked_names(units, queries, limit, fuzzy)
    return units_of_names(units, cut(hits, "hits") if fuzzy else hits)  # read twice, and dear to find


def search_symbols(units: DataFrame, queries: DataFrame, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """:func:`search` with the limit checked as for a request."""
    return search(units, queries, within("limit", limit, SEARCH_LIMIT), fuzzy)


def units_of_names(units: DataFrame, hits: DataFrame) -> DataFrame:
    carry = [*SLIM_COLS]
    wanted = hits.select("name").distinct()
    first = named(units).join(wanted, "name").groupBy("name").agg(_first([F.col(c) for c in UNIT_ORDER], carry))
    found = hits.join(_unpack(first, ["name"], carry), "name")
    return found.withColumn("match_type", scoring.match_type(F.col("score"))).withColumn(
        "match_score", scoring.round3(F.col("score"))
    )


def search_with_context(units: DataFrame, queries: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Best 10 of 50 hits after a boost for hits near ``file_context`` (may be NULL)."""
    hits = search(units, queries, 50, fuzzy).join(queries.select("query_id", "file_context"), "query_id")
    own, near = F.col("file_path"), F.col("file_context")
    boost = (
        F.when(near.isNull(), 0.0)
        .when(own == near, scoring.SAME_FILE)
        .when(parent_dir(own) == parent_dir(near), scoring.SAME_DIR)
        .when(parent_dir(parent_dir(own)) == parent_dir(parent_dir(near)), scoring.NEAR_DIR)
        .otherwise(0.0)
    )
    boosted = hits.withColumn("match_score", scoring.round3(F.least(F.col("match_score") + boost, F.lit(1.0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "rank")
    return boosted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= 10).drop("rank", "tier")
