"""Importance of symbols and the ranked map of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions.ids import is_exported, map_symbol_name, module_name, module_path
from kodagraf.functions.scoring import dependents_boost
from kodagraf.operators import graph
from kodagraf.params import MAX_ENTRIES, MAX_SYMBOLS_PER_MODULE, within

TOP_LEVEL = 20


def boosted(scores: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): raised for dependents (by edge rows), a docstring, and classes.

    Ids without a unit, such as files that define units, keep their score.
    """
    users = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_users"))
    traits = units.select("id", (F.length("docstring") > 0).alias("documented"), (F.col("unit_kind") == "CLASS").alias("is_class"))
    raised = (
        F.col("score")
        * dependents_boost(F.coalesce("n_users", F.lit(0)))
        * F.when(F.col("documented"), 1.1).otherwise(F.lit(1.0))
        * F.when(F.col("is_class"), 1.2).otherwise(F.lit(1.0))
    )
    joined = scores.join(traits, "id", "left").join(users, "id", "left")
    return joined.select("id", F.when(F.col("is_class").isNull(), F.col("score")).otherwise(raised).alias("score"))


def importance(units: DataFrame, edges: DataFrame, **rank_options) -> DataFrame:
    return boosted(graph.pagerank(edges, **rank_options), units, edges)


def map_entries(units: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per unit with its module, score and visibility."""
    u = units.select("id", "unit_kind", "file_path", "start_line", "signature").join(scores, "id", "left")
    name = map_symbol_name(F.col("id"))
    return u.select(
        "id",
        module_path(F.col("id")).alias("module"),
        name.alias("symbol_name"),
        "unit_kind",
        "file_path",
        "start_line",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        is_exported(F.col("file_path"), F.col("signature"), name).alias("is_exported"),
    )


def module_importance(entries: DataFrame) -> DataFrame:
    """(module, module_name, importance, symbol_count): the mean score of the members."""
    grouped = entries.groupBy("module").agg(F.avg("score").alias("importance"), F.count("*").alias("symbol_count"))
    return grouped.withColumn("module_name", module_name(F.col("module")))


def module_map(entries: DataFrame) -> DataFrame:
    """Every module with its entries, best first, as rows in that order."""
    return entries.orderBy("module", F.desc("score"), "id")


def build_map(units: DataFrame, scores: DataFrame, max_entries: int = 100, max_symbols_per_module: int = 10) -> DataFrame:
    """Rows of the map: the best modules, in each its best symbols, up to ``max_entries`` in all.

    A module gives at least one entry, so the best ``max_entries`` modules are enough.
    Their symbols are cut to the first few per module before they are shuffled.
    """
    within("max_entries", max_entries, MAX_ENTRIES)
    within("max_symbols_per_module", max_symbols_per_module, MAX_SYMBOLS_PER_MODULE)
    entries = map_entries(units, scores)
    # Compared at twelve digits: sums of the same scores in another order are the same mean.
    key = F.round("importance", 12)
    best = module_importance(entries).withColumn("_key", key).orderBy(F.desc("_key"), "module").limit(max_entries)
    in_module = Window.partitionBy("module").orderBy(F.desc(F.round("score", 12)), "id")
    top = entries.withColumn("rank_in_module", F.row_number().over(in_module)).filter(
        F.col("rank_in_module") <= max_symbols_per_module
    )
    rows = top.join(best, "module").orderBy(F.desc("_key"), "module", "rank_in_module").limit(max_entries)
    overall = Window.orderBy(F.desc("_key"), "module", "rank_in_module")  # at most max_entries rows
    rows = rows.withColumn("position", F.row_number().over(overall)).drop("_key")
    return rows.withColumn("top_level", F.col("position") <= TOP_LEVEL)


def map_totals(units: DataFrame, map_rows: DataFrame) -> DataFrame:
    """One row: symbols, modules, and the token estimate of the map."""
    symbol_chars = F.length("symbol_name") + F.length("unit_kind") + 30
    per_row = symbol_chars * F.when(F.col("top_level"), 2).otherwise(1)
    head = F.when(F.col("rank_in_module") == 1, F.length("module_name") + F.length("module") + 50).otherwise(0)
    estimate = map_rows.agg(F.floor(F.coalesce(F.sum(per_row + head), F.lit(0)) / 4).cast("bigint")).scalar()
    return units.agg(
        F.countDistinct("id").alias("total_symbols"), F.countDistinct(module_path(F.col("id"))).alias("total_modules")
    ).withColumn("token_estimate", estimate)


def repo_stats(scores: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` scores with the number and mean of all, rounded to four digits."""
    totals = scores.agg(F.struct(F.count("*").alias("n"), F.avg("score").alias("mean"))).scalar()
    return (
        scores.orderBy(F.desc(F.round("score", 12)), "id")
        .limit(top)
        .select("id", F.round("score", 4).alias("score"), totals["n"].alias("n_scored"), F.round(totals["mean"], 4).alias("mean_score"))
    )
