import glob
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kodagraf.functions import corners, meeting, packing
from kodagraf.operators import graph, modules
from kodagraf.runtime import cut, shared_dir

CHAIN = [("module_a/file1.py:func1", "module_b/file2.py:func2"), ("module_b/file2.py:func2", "module_c/file3.py:func3")]


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def requests(spark, *starts):
    return spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "query_id int, start_id string")


def test_bfs_depths(spark, make_edges):
    e = make_edges([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d", "IMPORTS")])
    got = {(r.node_id, r.depth) for r in graph.bfs(e, requests(spark, "a"), 3).collect()}
    assert got == {("b", 1), ("c", 1), ("d", 2)}
    assert {r.node_id for r in graph.bfs(e, requests(spark, "a"), 3, ["CALLS"]).collect()} == {"b", "c"}
    assert {r.node_id for r in graph.dependents(e, requests(spark, "c"), 1).collect()} == {"a", "b"}
    assert graph.bfs(e, requests(spark, "a"), -1).count() == 0
    assert [r.node_id for r in graph.bfs(e, requests(spark, "a"), 0, include_start=True).collect()] == ["a"]


def test_dfs_meets_a_node_at_the_limit_only_once(spark, make_edges):
    e = make_edges([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")])
    assert [r.node_id for r in graph.dfs_preorder(e, requests(spark, "a"), 2).orderBy("path").collect()] == ["a", "b", "c"]


def test_dfs_equals_recursion(spark, make_edges):
    pairs = random_pairs(15, 40, 3)
    targets = {}
    for a, b in pairs:
        targets.setdefault(a, []).append(b)

    def recursive(start, limit):
        order, seen = [], set()

        def go(node, depth):
            seen.add(node)
            order.append(node)
            if depth < limit:
                for t in sorted(targets.get(node, [])):
                    if t not in seen:
                        go(t, depth + 1)

        go(start, 0)
        return order

    starts = ["n1", "n4", "n9"]
    rows = graph.dfs_preorder(make_edges(pairs), requests(spark, *starts), 3).orderBy("query_id", "path").collect()
    for i, s in enumerate(starts):
        assert [r.node_id for r in rows if r.query_id == i] == recursive(s, 3)


def test_shortest_paths(spark, make_edges):
    e = make_edges([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e")])
    asked = spark.createDataFrame([(1, "a", "e"), (2, "e", "a"), (3, "b", "b")], "query_id int, from_id string, to_id string")
    got = {r.query_id: r.path for r in graph.reachable_paths(e, asked).collect()}
    assert got == {1: ["a", "b", "d", "e"], 2: None, 3: ["b"]}


@pytest.mark.parametrize("seed,n,m", [(1, 14, 22), (2, 30, 48), (3, 8, 40)])
def test_shortest_paths_equal_a_search_from_one_end(spark, make_edges, seed, n, m):
    pairs = [*random_pairs(n, m, seed), ("n1", "n1"), ("n1", "n2"), ("n1", "n2")]
    nodes = sorted({x for p in pairs for x in p})
    step = {x: sorted({d for s, d in pairs if s == x}) for x in nodes}

    def least(start, end):
        level, seen = {start: [start]}, {start}
        while level and end not in level:
            grown = {}
            for x, way in level.items():
                for y in step[x]:
                    if y not in seen:
                        grown[y] = min(grown.get(y, [*way, y]), [*way, y])
            level, seen = grown, seen | set(grown)
        return level.get(end)

    asked = [(i, a, b) for i, (a, b) in enumerate(itertools.product(nodes, nodes))] + [(-1, "n1", "nowhere"), (-2, None, "n1")]
    rows = graph.shortest_paths(make_edges(pairs), spark.createDataFrame([*asked, asked[0]], "query_id int, from_id string, to_id string")).collect()
    got = {r.query_id: r.path for r in rows}
    assert len(got) == len(rows) and got == {i: w for i, a, b in asked if a and b in step and (w := least(a, b))}
    short = graph.shortest_paths(make_edges(pairs), spark.createDataFrame(asked, "query_id int, from_id string, to_id string"), 2).collect()
    assert {r.query_id: r.path for r in short} == {i: w for i, w in got.items() if len(w) <= 3}


def test_tree_takes_the_least_depth(spark, make_edges):
    e = make_edges([("a", "b"), ("b", "c"), ("a", "c", "IMPORTS"), ("c", "d")])
    got = {(r.node_id, r.parent_id, r.depth, r.edge_type) for r in graph.dependency_tree(e, requests(spark, "a"), 2).collect()}
    assert got == {("b", "a", 1, "CALLS"), ("c", "a", 1, "IMPORTS"), ("d", "c", 2, "CALLS")}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_brute_force(make_edges, seed):
    pairs = random_pairs(9, 30, seed)
    have = set(pairs)
    nodes = sorted({x for p in pairs for x in p})
    want = set()
    for size in (2, 3, 4):
        for c in itertools.permutations(nodes, size):
            if c[0] == min(c) and all((c[i], c[(i + 1) % size]) in have for i in range(size)):
                want.add(c)
    rows = [tuple(r.cycle) for r in graph.cycles(make_edges(pairs), 4).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_corners_of_triangles_hold_numbers(make_edges):
    """Ids are long and corners many: on the way only numbers are joined, and the order of the ids decides as before."""
    names = {f"n{i}": f"src/{'x' * (i % 5)}é{i}.py:f" for i in range(12)}
    pairs = [(names[a], names[b]) for a, b in random_pairs(12, 60, 8) if a in names and b in names and a != b]
    have = set(pairs)
    want = {
        c for c in itertools.permutations({n for p in pairs for n in p}, 3)
        if c[0] == min(c, key=str.encode) and all(p in have for p in zip(c, (*c[1:], c[0])))
    }
    found = graph.triangles(graph.pairs(make_edges(pairs)))
    rows = [tuple(r.cycle) for r in found.collect()]
    assert sorted(rows) == sorted(want) and want


def test_corner_columns_are_short(make_edges, monkeypatch):
    kept = []
    monkeypatch.setattr(graph, "cut", lambda df, tag: kept.append(df) or cut(df, tag))
    graph.triangles(graph.pairs(make_edges([("a", "b"), ("b", "c"), ("c", "a")])))
    turned = dict(kept[-1].dtypes)
    assert turned["a"] == turned["b"] == "bigint"


@pytest.mark.parametrize("sparse,edges_a_cell,digest", [(32, 8_000_000, F.xxhash64), (0, 40, F.length), (1000, 40, F.xxhash64)])
def test_triangles_in_cells_equal_trying_every_one(make_edges, monkeypatch, sparse, edges_a_cell, digest):
    """Found by lookups and by tables, in one cell and in many; ids that share a hash, repeated edges and edges without an end."""
    monkeypatch.setattr(corners, "_SPARSE", sparse)
    monkeypatch.setattr(graph, "_TRIANGLE_EDGES", edges_a_cell)
    monkeypatch.setattr(graph, "_digest", lambda c: digest(c))
    pairs = random_pairs(30, 300, 7)
    hub = [("n5", f"n{i}") for i in range(30)] + [(f"n{i}", "n5") for i in range(30)]
    have = {p for p in (*pairs, *hub) if p[0] != p[1]}
    nodes = sorted({x for p in have for x in p})
    want = {c for c in itertools.permutations(nodes, 3) if c[0] == min(c) and all(p in have for p in zip(c, (*c[1:], c[0])))}
    want |= {p for p in have if p[0] < p[1] and p[::-1] in have}
    rows = [tuple(r.cycle) for r in graph.cycles(make_edges([*pairs, *hub, *pairs[:50], ("n1", None), (None, "n2")]), 3).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_neither_corners_nor_triangles_travel(make_edges):
    """Only packed edges are dealt to cells; what closes there gets its ids without a shuffle."""
    plan = graph.triangles(graph.pairs(make_edges(random_pairs(20, 100, 3))))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in plan[: plan.index("MapInArrow")].replace("BroadcastExchange", "")
    assert below.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("lookups", [1, 50, 1 << 20])
@pytest.mark.parametrize("wide", [False, True])
def test_thirds_of_packed_edges(monkeypatch, lookups, wide):
    monkeypatch.setattr(corners, "_LOOKUPS", lookups)
    monkeypatch.setattr(packing, "_PACKED", 7)
    rng = np.random.default_rng(2)
    sides = [np.unique(rng.integers(0, 12, (60, 2)), axis=0) for _ in range(3)]
    want = {(u, v, w) for u, v in sides[0].tolist() for w in range(12) if [v, w] in sides[1].tolist() and [w, u] in sides[2].tolist()}
    first, second, third = (packing.unpacked(list(packing.packed(tuple(s[::-1].T), wide)), wide) for s in sides)
    for sparse in (0, 1000):
        monkeypatch.setattr(corners, "_SPARSE", sparse)
        got = []
        for edge, count, w in corners.thirds(first, second, third):
            each = np.repeat(edge, count)
            got += zip(first[0][each].tolist(), first[1][each].tolist(), w.tolist())
        assert sorted(got) == sorted(want) and want


def test_cycles_without_bound(make_edges):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    two_rings = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e")]
    rows = [tuple(r.cycle) for r in graph.cycles(make_edges([*ring, *two_rings, ("r3", "a"), ("a", "a"), ("z", "z")])).collect()]
    want = {tuple(f"r{i}" for i in range(7)), ("a", "b", "c", "d"), ("e", "f", "g"), ("a",), ("z",)}
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("seed,n,m", [(3, 12, 30), (4, 25, 45), (5, 40, 60)])
def test_a_shortest_cycle_of_each_edge(make_edges, seed, n, m):
    pairs = random_pairs(n, m, seed)
    after = {}
    for s, t in pairs:
        after.setdefault(s, set()).add(t)

    def turned(c):
        at = c.index(min(c))
        return c[at:] + c[:at]

    want = set()
    for s, t in set(pairs):
        ways = [(t,)]
        for _ in range(n):
            closed = [w for w in ways if w[-1] == s]
            if closed:
                want.add(turned(min(closed)))
                break
            ways = [(*w, x) for w in ways for x in sorted(after.get(w[-1], ())) if x not in w]
    rows = [tuple(r.cycle) for r in graph.cycles(make_edges(pairs)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def least_back(pairs, s, t):
    """The least shortest way from t to s, by looking at all ways of each length."""
    after, ways = {}, [(t,)]
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    while not any(w[-1] == s for w in ways):
        ways = [(*w, x) for w in ways for x in after.get(w[-1], ()) if x not in w]
    return min(w for w in ways if w[-1] == s)


def test_ways_back_meet_in_cells(make_edges, monkeypatch):
    """Open edges and paths are dealt to many cells, in which no pair of an edge and a path is more than looked up."""
    monkeypatch.setattr(graph, "_CELL_PATHS", 60)
    monkeypatch.setattr(graph, "_CELL_EDGES", 15)
    rng = random.Random(11)
    pairs = sorted({(f"n{i:02}", f"n{(i + rng.choice((1, 2, 3, 4))) % 20:02}") for i in range(20) for _ in range(3)})
    cells = []
    monkeypatch.setattr(graph, "_met", lambda *a, met=graph._met: cells.append(cut(met(*a), "met")) or cells[-1])
    rows = [tuple(r.cycle) for r in graph.cycles(make_edges(pairs)).collect()]
    want = set()
    for s, t in pairs:
        way = least_back(pairs, s, t)
        at = way.index(min(way))
        want.add(way[at:] + way[:at])
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(c.groupBy("s", "t").count().filter("count > 1").count() for c in cells)


@pytest.mark.parametrize("lookups", [1, 7, 1 << 22])
def test_least_ways(monkeypatch, lookups):
    monkeypatch.setattr(meeting, "_LOOKUPS", lookups)
    rng = np.random.default_rng(5)
    ahead = np.unique(rng.integers(0, 12, (60, 3)), axis=0)
    ahead = ahead[np.unique(ahead[:, :2], axis=0, return_index=True)[1]].T  # one path for each owner and middle node
    behind = np.unique(rng.integers(0, 12, (40, 2)), axis=0).T
    s, t = rng.integers(0, 14, (2, 50))
    want = {}
    for e in range(50):
        ways = [(p, x) for o, x, p in ahead.T.tolist() if o == t[e] and [s[e], x] in behind.T.tolist()]
        if ways:
            want[e] = min(ways)
    which, way = meeting.least_ways(list(ahead), list(behind), s, t)
    assert {int(e): tuple(int(c[i]) for c in way) for i, e in enumerate(which)} == want and want
    assert len(meeting.least_ways(list(ahead), [c[:0] for c in behind], s, t)[0]) == 0


def test_memory_of_a_cell():
    """Paths are held as narrow numbers and edges packed; what is made of them on the way is bounded."""
    rng = np.random.default_rng(3)
    n, n_paths, n_edges = 2000, 400_000, 600_000
    rows = [(0, meeting.AHEAD if i % 2 else meeting.BEHIND, None, *rng.integers(0, n, 3)) for i in range(1000)]
    columns = [list(c) for c in zip(*rows)]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["cell", "kind", "edges", "owner", "x", "p0"]
    ends = rng.integers(0, n, (2, n_edges))

    def batches():
        for low in range(0, n_paths, 1000):
            fresh = [pa.array(rng.integers(0, n, 1000)) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:3], types)), *fresh], names)
        for row in packing.packed(tuple(ends), False):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((0, meeting.EDGES, row, 0, 0, 0), types)], names)

    tracemalloc.start()
    found = sum(b.num_rows for b in meeting.met_in_cells(batches(), 1, 0, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 120_000_000


def test_cells_of_ways_are_partitions(make_edges):
    """No cell is sorted or gathered as a group, and its edges come packed."""
    step = graph._numbered(graph.pairs(make_edges(random_pairs(20, 100, 3))).filter("src <> dst"))[2].toDF("s", "t")
    met = graph._met(step, step.toDF("x", "t"), step.toDF("s", "x"), False)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Sort " not in plan and plan.count("MapInArrow") == 2


def test_pairs_within_strong_components(make_edges):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e"), ("x", "a"), ("f", "y")]
    hop = graph._within_components(graph.pairs(make_edges(pairs)))
    assert {(r.src, r.dst) for r in hop.collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "e")}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(make_edges, seed):
    pairs = random_pairs(60, 45, seed) + [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(25)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in graph.components(make_edges(pairs)).collect()}
    assert got == {x: find(x) for x in root}


def python_rank(pairs, rounds):
    pairs = set(pairs)
    nodes = {x for p in pairs for x in p}
    deg = {n: sum(1 for a, _ in pairs if a == n) for n in nodes}
    score = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        score = {n: 0.15 / len(nodes) + 0.85 * sum(score[a] / deg[a] for a, b in pairs if b == n) for n in nodes}
    return score


@pytest.mark.parametrize("hub_rows", [1_000_000, 3])
def test_pagerank(make_edges, hub_rows):
    pairs = random_pairs(12, 40, 7) + [("hub", f"n{i}") for i in range(12)] + [("n1", "sink")]
    typed = [(a, b, t) for a, b in pairs for t in ("CALLS", "IMPORTS")]
    got = {r.id: r.score for r in graph.pagerank(make_edges(typed), max_iter=8, tol=None, hub_rows=hub_rows).collect()}
    assert got == pytest.approx(python_rank(pairs, 8))


def test_rank_queries_go_on_until_converged(spark, make_edges, monkeypatch):
    from kodagraf.plans import catalog

    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    monkeypatch.setattr(catalog, "RANK_ROUNDS", 1)
    monkeypatch.setattr(catalog, "part_edges", lambda spark, sf: make_edges(pairs))
    got = {r.id: r.score for r in catalog.QUERIES["pagerank"](spark, "").collect()}
    assert got == pytest.approx(python_rank(pairs, 20), abs=1e-7)


def test_pagerank_converges_and_drops_dangling_mass(make_edges):
    got = {r.id: r.score for r in graph.pagerank(make_edges(CHAIN)).collect()}
    assert list(got.values()) and sum(got.values()) < 1
    links = modules.module_edges(make_edges(CHAIN))
    ranked = {r.module: round(r.score, 6) for r in modules.module_centrality(links).collect()}
    assert ranked == {"module_a": 0.05, "module_b": 0.0925, "module_c": 0.128625}


def test_modules_of_a_chain(spark, make_edges):
    links = modules.module_edges(make_edges(CHAIN))
    assert {(r.module, r.layer) for r in modules.architecture_layers(links).collect()} == {("module_a", 0), ("module_b", 1), ("module_c", 2)}
    assert [tuple(r) for r in modules.most_connected(links).select("module", "degree").collect()] == [("module_b", 2), ("module_a", 1), ("module_c", 1)]
    assert [r.module for r in modules.root_modules(links).collect()] == ["module_a"]
    assert [r.module for r in modules.leaf_modules(links).collect()] == ["module_c"]
    assert tuple(modules.module_counts(make_edges(CHAIN)).first()) == (3, 2)
    asked = spark.createDataFrame([("module_b",)], "module string")
    assert [r.neighbour for r in modules.neighbours(links, asked).collect()] == ["module_c"]
    assert [r.neighbour for r in modules.neighbours(links, asked, reverse=True).collect()] == ["module_a"]


def test_cyclic_modules_form_the_last_layer(make_edges):
    links = modules.module_edges(make_edges([("module_a/x.py:f", "module_b/y.py:g"), ("module_b/y.py:g", "module_a/x.py:f")]))
    assert [tuple(r.cycle) for r in modules.module_cycles(links).collect()] == [("module_a", "module_b")]
    assert {(r.module, r.layer) for r in modules.architecture_layers(links).collect()} == {("module_a", 0), ("module_b", 0)}


@pytest.mark.parametrize("seed,n,m", [(1, 30, 28), (2, 40, 45), (3, 10, 40)])
def test_layers_equal_peeling(make_edges, seed, n, m):
    pairs = [*random_pairs(n, m, seed), ("n3", "n3"), ("top", "n0"), ("alone", "alone")]
    nodes = {x for p in pairs for x in p}

    def peel(nodes, pairs):
        layer, left = {}, set(nodes)
        while free := {x for x in left if not any(d == x and s in left for s, d in pairs)}:
            layer |= dict.fromkeys(free, max(layer.values(), default=-1) + 1)
            left -= free
        return layer | dict.fromkeys(left, max(layer.values(), default=-1) + 1)

    assert {r.id: r.layer for r in graph.layers(make_edges(pairs)).collect()} == peel(nodes, pairs)
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for s, d in pairs:
            reach[s] |= reach[d]
    whole = {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
    want = peel(set(whole.values()), {(whole[s], whole[d]) for s, d in pairs if whole[s] != whole[d]})
    assert {r.id: r.layer for r in graph.layers(make_edges(pairs), condense=True).collect()} == {x: want[whole[x]] for x in nodes}


def test_layers_of_no_edges(make_edges):
    none = make_edges([("a", "b")]).limit(0)
    assert graph.layers(none).collect() == [] and graph.layers(none, condense=True).collect() == []


def test_degree_counts_edge_rows(make_edges, make_units):
    from kodagraf.operators import repomap

    units = make_units([("t.py:func1", "FUNCTION", 10, 20, "def func1()", "", None), ("t.py:func2", "FUNCTION", 30, 40, "def func2()", "", "doc")])
    scores = units.select("id", F.when(F.col("id") == "t.py:func1", 0.9).otherwise(0.5).alias("score"))
    none = make_edges([("x", "y")]).limit(0)
    raised = repomap.boosted(scores, units, none)
    assert {r.id: round(r.score, 6) for r in raised.collect()} == {"t.py:func1": 0.9, "t.py:func2": 0.55}
    rows = repomap.build_map(units, raised)
    assert [r.symbol_name for r in rows.orderBy("position").collect()] == ["func1", "func2"]
    assert round(rows.first().importance, 6) == 0.725
    assert repomap.map_totals(units, rows).first().token_estimate == 56
    twice = make_edges([(f"u{i}", "t.py:func1", t) for i in range(3) for t in ("CALLS", "IMPORTS")])
    assert {r.id: round(r.score, 6) for r in repomap.boosted(scores, units, twice).collect()}["t.py:func1"] == 1.17


@pytest.mark.parametrize("steps_per_edge", [0, 8])
@pytest.mark.parametrize("seed,n,m", [(5, 12, 18), (6, 40, 60), (7, 25, 90)])
def test_strong_members_equal_mutual_reachability(spark, monkeypatch, seed, n, m, steps_per_edge):
    monkeypatch.setattr(graph, "_STEPS_PER_EDGE", steps_per_edge)
    pairs = [p for p in random_pairs(n, m, seed) if p[0] != p[1]]
    reach = {x: {d for s, d in pairs if s == x} for p in pairs for x in p}
    for k, i in itertools.product(list(reach), list(reach)):
        if k in reach[i]:
            reach[i] |= reach[k]
    want = {frozenset(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    got = {}
    for r in graph._strong_members(spark.createDataFrame(pairs, "src string, dst string")).collect():
        got.setdefault(r.whole, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == want


def test_rounds_of_strong_components_do_not_grow_with_linked_cycles(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, tag: written.append(tag) or cut(df, tag))
    way = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    both = way + [(b, a) for a, b in way]
    hop = spark.createDataFrame(both, "src string, dst string")
    assert {(r.src, r.dst) for r in graph._within_components(hop).collect()} == set(both)
    assert len(written) < 40  # not a round for every step along the way


def test_components_shuffle_numbers_and_keep_self_edges(spark, make_edges, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, tag: written.append((tag, dict(df.dtypes))) or cut(df, tag))
    e = make_edges([("b", "c"), ("b", "c"), ("c", "a"), ("x", "x"), ("a", "a"), ("z", "y"), (None, "q"), (None, None)])
    assert sorted((r.id, r.component) for r in graph.components(e).collect()) == [
        ("a", "a"), ("b", "a"), ("c", "a"), ("q", "q"), ("x", "x"), ("y", "y"), ("z", "y")
    ]
    assert {t for tag, cols in written if tag == "components" for t in cols.values()} == {"bigint"}


@pytest.mark.parametrize("hub_rows", [1_000_000, 2])
def test_pagerank_with_repeated_edges_and_ends_without_an_id(make_edges, hub_rows):
    """A repeated pair counts once, an end without an id counts in the degree and as a node; pairs of texts are not written."""
    rows = [("a", "b", t) for t in "xyzw"] + [("a", None), ("a", None, "y"), ("b", "c"), ("c", "a"), (None, "c"), ("d", "c")]
    edges = make_edges(rows)
    tables = set(glob.glob(f"{shared_dir(edges.sparkSession)}/pagerank-pairs-*"))
    got = {r.id: r.score for r in graph.pagerank(edges, max_iter=6, tol=None, hub_rows=hub_rows).collect()}
    pairs = {(r[0], r[1]) for r in rows}
    nodes = {x for p in pairs for x in p}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(6):
        part = {v: want[v] / max(1, sum(p[0] == v for p in pairs)) for v in nodes}
        want = {v: 0.15 / len(nodes) + 0.85 * sum(part[s] for s, t in pairs if t == v and None not in (s, t)) for v in nodes}
    assert got == pytest.approx(want)
    assert set(glob.glob(f"{shared_dir(edges.sparkSession)}/pagerank-pairs-*")) == tables
