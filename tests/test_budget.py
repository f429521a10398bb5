import random

import pytest

from kodagraf.operators import budget
from kodagraf.params import PruneConfig

SCHEMA = "query_id string, item_id bigint, tokens bigint, is_focal boolean, hop int, priority double, position bigint"


def items(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def dep(i, tokens, hop=2, prio=0.0, q="q"):
    return (q, i, tokens, hop == 0, hop, prio, i)


def test_fixture(spark):
    rows = [dep(0, 0, 0), dep(1, 900), dep(2, 600), dep(3, 200), dep(4, 90)]
    got = {r.item_id: (r.tier, r.used) for r in budget.allocate(items(spark, rows), 1000).collect()}
    assert got == {0: ("full", 0), 1: ("full", 900), 2: ("pruned", 0), 3: ("skeleton", 50), 4: ("skeleton", 22)}
    stats = budget.budget_stats(budget.allocate(items(spark, rows), 1000), 1000).first()
    assert (stats.used_tokens, stats.remaining_tokens, stats.skeleton_units_count) == (972, 28, 2)


def test_nothing_fits_behind_too_large_a_focus(spark):
    rows = [dep(0, 1500, 0), dep(1, 10), dep(2, 0)]
    got = {r.item_id: r.tier for r in budget.allocate(items(spark, rows), 1000).collect()}
    assert got == {0: "full", 1: "pruned", 2: "pruned"}


def brute_allocate(rows, limit):
    left = limit - sum(r[2] for r in rows if r[3])
    out = {r[1]: "full" for r in rows if r[3]}
    for r in sorted((r for r in rows if not r[3]), key=lambda r: (-r[2], r[1])):
        cost = r[2] if r[2] <= left else r[2] // 4 if r[2] // 4 <= left else None
        out[r[1]] = "pruned" if cost is None else "full" if r[2] <= left else "skeleton"
        left -= cost or 0
    return out


def brute_fill(rows, limit, cost, key):
    taken, left = {}, limit
    for r in sorted(rows, key=key):
        if cost(r) <= left:
            taken[r[1]] = cost(r)
            left -= cost(r)
    return taken, left


@pytest.mark.parametrize("seed,top", [(1, 300), (2, 40), (3, 8)])
def test_against_sequential_rules(spark, seed, top):
    rng = random.Random(seed)
    by_query = {}
    for q in ("a", "b", "c"):
        n = 400 if q == "a" else 40
        by_query[q] = [dep(0, rng.randrange(300), 0, 0.0, q)] + [
            dep(i, rng.randrange(top), rng.choice([1, 2]), rng.choice([0.5, 1.0, 2.5, rng.random()]), q) for i in range(1, n)
        ]
    df = items(spark, [r for rows in by_query.values() for r in rows])
    allocated = budget.allocate(df, 700).collect()
    kept = budget.prune_by_tokens(df, 700).collect()
    tiers = budget.tiered_prune(df, PruneConfig(max_tokens=700)).collect()
    for q, rows in by_query.items():
        assert {r.item_id: r.tier for r in allocated if r.query_id == q} == brute_allocate(rows, 700)
        want, _ = brute_fill(rows, 700, lambda r: r[2], lambda r: (-r[5], r[1]))
        assert {r.item_id: r.cost for r in kept if r.query_id == q} == want
        near, left = brute_fill([r for r in rows if r[4] == 1], 700 - rows[0][2], lambda r: r[2] // 4, lambda r: r[1])
        far, _ = brute_fill([r for r in rows if r[4] == 2], left // 4, lambda r: r[2], lambda r: (-r[5], r[1])) if left > 0 else ({}, 0)
        skeletons = near | {i: c // 4 for i, c in far.items()}
        got = {r.item_id: (r.tier, r.used) for r in tiers if r.query_id == q}
        assert got == {
            r[1]: ("full", r[2]) if r[4] == 0 else ("skeleton", skeletons[r[1]]) if r[1] in skeletons else ("pruned", 0) for r in rows
        }


def test_compat_leaves_out_what_found_no_budget(spark):
    rows = [dep(0, 800, 0), dep(1, 4, 1), dep(2, 4, 2)]
    df = items(spark, rows)
    assert {r.item_id: r.tier for r in budget.tiered_prune(df, PruneConfig(max_tokens=700)).collect()} == {0: "full", 1: "pruned", 2: "pruned"}
    assert {r.item_id for r in budget.tiered_prune(df, PruneConfig(max_tokens=700), compat=True).collect()} == {0, 1}
    stats = budget.prune_stats(budget.tiered_prune(df, PruneConfig(max_tokens=700))).first()
    assert (stats.total_units, stats.pruned_count, stats.token_estimate) == (3, 2, 800)


def test_relevance(spark, make_units, make_edges):
    units = make_units([(f"a.py:{n}", "FUNCTION", 1, 2, "", "", None) for n in "abc"])
    focal = spark.createDataFrame([("a.py:a",)], "id string")
    edges = make_edges([("a.py:b", "a.py:a")])
    low = budget.prune_by_relevance(units, edges, focal, 0.5)
    assert {r.id: r.relevance for r in low.collect()} == {"a.py:a": 1.0, "a.py:b": 0.8, "a.py:c": 0.5}
    assert {r.id for r in budget.prune_by_relevance(units, edges, focal, 0.7).collect()} == {"a.py:a", "a.py:b"}
