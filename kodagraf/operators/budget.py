"""Token budgets: what is kept in full, as a skeleton, or not at all.

The rules are sequential: units are visited in an order and each is
taken if it still fits. What is left of the budget only shrinks, so among units of
equal cost the ones taken are the first ones, and of cost ``c`` at most
``budget / c``. All others can be settled without visiting them. What remains to
be visited is bounded by the budget, not by the data, so a query whose candidates
are a third of the table is no more work in its one group than any other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions import scoring, tokens
from kodagraf.params import PruneConfig

SALTS = 64


def first_of_equal(items: DataFrame, keys: list[str], order: list[Column], bound: Column) -> DataFrame:
    """Rows whose rank within ``keys`` is at most ``bound``; a hot group is first cut in ``SALTS`` parts."""
    salt = F.pmod(F.xxhash64("item_id"), F.lit(SALTS))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    cut_down = items.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= bound)
    return cut_down.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= bound).drop("_salt", "_rn")


def _id_types(items: DataFrame) -> tuple[str, str]:
    return tuple(items.schema[c].dataType.simpleString() for c in ("query_id", "item_id"))


def greedy_fill(items: DataFrame, budgets: DataFrame, order: list[Column]) -> DataFrame:
    """(query_id, item_id, cost) x (query_id, budget) -> the items taken in ``order`` while they fit.

    ``order`` holds ascending sort keys.
    """
    fits = items.join(budgets.select("query_id", "budget"), "query_id").filter(F.col("cost") <= F.col("budget"))
    free = fits.filter("cost = 0").select("query_id", "item_id", "cost")
    paid = first_of_equal(fits.filter("cost > 0"), ["query_id", "cost"], order, F.expr("budget div cost"))
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    paid = paid.select("query_id", "item_id", "cost", "budget", *keys)
    qt, it = _id_types(items)

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c for c in group.columns if c.startswith("_o")], kind="stable")
        left = int(group["budget"].iloc[0])
        taken = []
        for i, cost in enumerate(group["cost"].tolist()):
            if cost <= left:
                left -= cost
                taken.append(i)
        return group.iloc[taken][["query_id", "item_id", "cost"]]

    done = paid.groupBy("query_id").applyInPandas(take, f"query_id {qt}, item_id {it}, cost bigint")
    return free.unionByName(done)


def allocate(items: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """(query_id, item_id, tokens, is_focal) -> the same with ``tier`` and ``used``.

    Focal items are full. The others are visited from the largest: full if that fits,
    else as a skeleton at a quarter of the cost, else pruned.
    """
    spent = items.groupBy("query_id").agg(F.sum(F.when(F.col("is_focal"), F.col("tokens")).otherwise(0)).alias("_spent"))
    deps = items.filter(~F.col("is_focal")).join(spent, "query_id").withColumn("budget", F.lit(max_tokens) - F.col("_spent"))
    deps = deps.withColumn("skel", tokens.quarter(F.col("tokens")))
    bound = F.expr("budget div tokens + CASE WHEN skel > 0 THEN budget div skel ELSE 0 END")
    visit = deps.filter("tokens > 0 AND skel <= budget").select("query_id", "item_id", "tokens", "skel", "budget")
    visit = first_of_equal(visit, ["query_id", "tokens"], [F.col("item_id")], bound)
    qt, it = _id_types(items)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "item_id"], ascending=[False, True], kind="stable")
        left = int(group["budget"].iloc[0])
        tiers = []
        for full, skeleton in zip(group["tokens"].tolist(), group["skel"].tolist()):
            tier, cost = ("full", full) if full <= left else ("skeleton", skeleton) if skeleton <= left else ("pruned", 0)
            left -= cost
            tiers.append(tier)
        return group[["query_id", "item_id"]].assign(tier=tiers)

    decided = visit.groupBy("query_id").applyInPandas(fold, f"query_id {qt}, item_id {it}, tier string")
    settled = (
        F.when(F.col("is_focal"), "full")
        .when(F.col("tier").isNotNull(), F.col("tier"))
        .when((F.lit(max_tokens) - F.col("_spent")) < 0, "pruned")
        .when(F.col("tokens") == 0, "full")
        .when(tokens.quarter(F.col("tokens")) == 0, "skeleton")
        .otherwise("pruned")
    )
    joined = items.join(spent, "query_id").join(decided, ["query_id", "item_id"], "left").withColumn("tier", settled)
    used = F.when(F.col("tier") == "full", F.col("tokens")).when(F.col("tier") == "skeleton", tokens.quarter(F.col("tokens")))
    return joined.withColumn("used", F.coalesce(used, F.lit(0))).drop("_spent")


def budget_stats(allocated: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Per query: use of the budget and the number of units in each tier."""

    def n(tier: str) -> Column:
        return F.count(F.when(F.col("tier") == tier, 1))

    used = F.sum("used")
    return allocated.groupBy("query_id").agg(
        F.lit(max_tokens).cast("bigint").alias("max_tokens"),
        used.alias("used_tokens"),
        (F.lit(max_tokens) - used).alias("remaining_tokens"),
        (used / F.lit(max_tokens)).alias("utilization"),
        n("full").alias("full_units_count"),
        n("skeleton").alias("skeleton_units_count"),
        n("pruned").alias("pruned_units_count"),
        F.sum(F.when(F.col("tier") == "full", F.col("used")).otherwise(0)).alias("full_tokens"),
        F.sum(F.when(F.col("tier") == "skeleton", F.col("used")).otherwise(0)).alias("skeleton_tokens"),
    )


def prune_by_tokens(items: DataFrame, max_tokens: int) -> DataFrame:
    """(query_id, item_id, tokens, priority): kept by priority, skipping what does not fit."""
    costed = items.select("query_id", "item_id", F.col("tokens").alias("cost"), (-F.col("priority")).alias("_prio"))
    budgets = items.select("query_id").distinct().withColumn("budget", F.lit(max_tokens).cast("bigint"))
    return greedy_fill(costed, budgets, [F.col("_prio"), F.col("item_id")])


def tiered_prune(items: DataFrame, config: PruneConfig = PruneConfig(), compat: bool = False) -> DataFrame:
    """(query_id, item_id, tokens, hop, priority, position) -> the same with ``tier`` and ``used``.

    Hop 0 is full. Hop 1 is visited in input order at skeleton cost. Of the rest, within
    ``max_depth``, a quarter of what is left buys candidates at full cost by priority;
    they then become skeletons by the same order. ``compat`` leaves the rest out, instead
    of reporting it as pruned, when nothing was left for it.
    """
    out = items.filter((F.col("hop") <= 1) | (F.lit(config.max_depth - 1) >= 0))
    spent = out.groupBy("query_id").agg(F.sum(F.when(F.col("hop") == 0, F.col("tokens")).otherwise(0)).alias("_spent"))
    budgets = spent.select("query_id", (F.lit(config.max_tokens) - F.col("_spent")).alias("budget"))
    skel = tokens.quarter(F.col("tokens"))
    near = out.filter("hop = 1").select("query_id", "item_id", skel.alias("cost"), F.col("position").alias("_at"))
    taken_near = greedy_fill(near, budgets, [F.col("_at"), F.col("item_id")])

    left = _left_over(budgets, taken_near).filter("budget > 0")
    far = out.filter("hop > 1").select("query_id", "item_id", F.col("tokens").alias("cost"), (-F.col("priority")).alias("_prio"))
    by_prio = [F.col("_prio"), F.col("item_id")]
    quarter = left.select("query_id", F.expr("budget div 4").alias("budget"))
    chosen = greedy_fill(far, quarter, by_prio)
    # Every one of these fits: together they cost a quarter of what a quarter of the rest paid for.
    far_skeletons = chosen.select("query_id", "item_id", tokens.quarter(F.col("cost")).alias("cost"))
    kept = taken_near.unionByName(far_skeletons).withColumn("_kept", F.lit(True))
    tier = F.when(F.col("hop") == 0, "full").when(F.col("_kept"), "skeleton").otherwise("pruned")
    result = out.join(kept, ["query_id", "item_id"], "left").withColumn("tier", tier)
    used = F.when(F.col("hop") == 0, F.col("tokens")).otherwise(F.coalesce("cost", F.lit(0)))
    result = result.withColumn("used", used).drop("cost", "_kept")
    if compat:
        had_rest = left.select("query_id").withColumn("_rest", F.lit(True))
        result = result.join(had_rest, "query_id", "left").filter(F.col("_rest") | (F.col("hop") <= 1)).drop("_rest")
    return result


def _left_over(budgets: DataFrame, taken: DataFrame) -> DataFrame:
    paid = taken.groupBy("query_id").agg(F.sum("cost").alias("_paid"))
    joined = budgets.join(paid, "query_id", "left")
    return joined.select("query_id", (F.col("budget") - F.coalesce("_paid", F.lit(0))).alias("budget"))


def prune_stats(pruned: DataFrame) -> DataFrame:
    """Per query: counts and shares of the tiers, and tokens per unit."""
    total = F.count("*")

    def n(tier: str) -> Column:
        return F.count(F.when(F.col("tier") == tier, 1))

    counts = {"kept_full": n("full"), "skeletonized": n("skeleton"), "pruned": n("pruned")}
    used = F.sum("used")
    return pruned.groupBy("query_id").agg(
        total.alias("total_units"),
        *[c.alias(f"{k}_count") for k, c in counts.items()],
        *[(c / total).alias(f"{k}_ratio") for k, c in counts.items()],
        used.alias("token_estimate"),
        (used / total).alias("tokens_per_unit"),
    )


def relevance(units: DataFrame, edges: DataFrame, focal: DataFrame) -> DataFrame:
    """(query_id, id, relevance) of every unit for every focal set (query_id, id): 1 focal, 0.8 using it.

    Only units above the floor of 0.5 are rows; the floor holds for all others.
    """
    own = focal.select("query_id", "id").distinct().withColumn("relevance", F.lit(1.0))
    users = focal.withColumnRenamed("id", "target_id").join(edges.select("source_id", "target_id"), "target_id")
    using = users.select("query_id", F.col("source_id").alias("id"), F.lit(0.8).alias("relevance"))
    best = own.unionByName(using).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))
    return best.join(units.select("id"), "id", "left_semi")


def prune_by_relevance(units: DataFrame, edges: DataFrame, focal: DataFrame, min_relevance: float) -> DataFrame:
    """Units of one focal set (id) with at least the wanted relevance."""
    scored = relevance(units, edges, focal.select(F.lit(0).alias("query_id"), "id")).drop("query_id")
    if min_relevance > 0.5:
        return units.join(scored.filter(F.col("relevance") >= min_relevance), "id")
    return units.join(scored, "id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.5)))


def prune_by_depth(reached: DataFrame, max_depth: int) -> DataFrame:
    """Rows of a breadth-first search up to a depth."""
    return reached.filter(F.col("depth") <= max_depth)


def priorities(units: DataFrame, edges: DataFrame, config: PruneConfig = PruneConfig()) -> DataFrame:
    """(id, tokens, priority) of every unit."""
    uses = edges.select("source_id", "target_id").distinct().groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("_n"))
    prio = scoring.keep_priority(F.coalesce("_n", F.lit(0)), config.preserve_interfaces, config.keep_high_centrality)
    u = units.select("id", "unit_kind", "signature", "body", "docstring").join(uses, "id", "left")
    return u.select("id", tokens.unit_tokens().alias("tokens"), prio.alias("priority"))
