"""Traversals and fixpoints over an edge list (source_id, target_id, edge_type).

Iterations write their state with :func:`kodagraf.runtime.cut`, so a round reads a
table instead of replaying the rounds before it, and a lost executor costs one
round at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kodagraf.functions.corners import cycles_in_cells
from kodagraf.functions.meeting import AHEAD, BEHIND, EDGES, met_in_cells, packed_by_block
from kodagraf.functions.packing import packed
from kodagraf.runtime import cut, drop_cut, grown


def pairs(edges: DataFrame, edge_types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst) of an edge list."""
    e = edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types))
    src, dst = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return e.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    return ends.distinct()


def bfs(
    edges: DataFrame,
    starts: DataFrame,
    max_depth: int = 2,
    edge_types: list[str] | None = None,
    reverse: bool = False,
    include_start: bool = False,
) -> DataFrame:
    """(query_id, start_id) -> (query_id, node_id, depth) with the least depth of each node."""
    begin = starts.select("query_id", F.col("start_id").alias("node_id"), F.lit(0).alias("depth")).distinct()
    if max_depth < 0:
        return begin.filter(F.lit(False))
    begin = cut(begin, "bfs")  # every level reads it
    # Duplicate edges cost nothing here: the distinct after the join removes what they add.
    step_edges = edges if edge_types is None else edges.filter(F.col("edge_type").isin(edge_types))
    src, dst = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    hop = step_edges.select(F.col(src).alias("node_id"), F.col(dst).alias("next_id"))
    levels = [begin]
    for depth in range(1, max_depth + 1):
        reached = levels[-1].join(hop, "node_id").select("query_id", F.col("next_id").alias("node_id")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("query_id", "node_id")
        fresh = reached.join(seen, ["query_id", "node_id"], "left_anti").withColumn("depth", F.lit(depth))
        levels.append(fresh if depth == max_depth else cut(fresh, "bfs"))
    return reduce(DataFrame.unionByName, levels if include_start else levels[1:] or [begin.filter(F.lit(False))])


def dependencies(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, starts, depth)


def dependents(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, starts, depth, reverse=True)


def dependency_tree(edges: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """(query_id, node_id, parent_id, depth, edge_type): a spanning tree by least depth.

    Of several parents on the level above the smallest id is taken, and of several
    edges to it the smallest type.
    """
    reached = cut(bfs(edges, starts, max_depth, include_start=True), "tree")
    above = reached.select("query_id", F.col("node_id").alias("source_id"), (F.col("depth") + 1).alias("depth"))
    steps = above.join(edges.select("source_id", "target_id", "edge_type"), "source_id")
    parents = (
        steps.withColumnRenamed("target_id", "node_id")
        .join(reached.filter("depth > 0"), ["query_id", "node_id", "depth"], "left_semi")
        .groupBy("query_id", "node_id", "depth")
        .agg(F.min(F.struct(F.col("source_id").alias("parent_id"), "edge_type")).alias("_p"))
    )
    return parents.select("query_id", "node_id", "_p.parent_id", "depth", "_p.edge_type")


def shortest_paths(edges: DataFrame, requests: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(query_id, from_id, to_id) -> (query_id, path): unweighted, ties by the smallest path.

    Two frontiers, one from each end, hold the least way to every node of their level; in a round the one with
    fewer rows takes a step. They first meet when their steps together are the distance, in a node of every
    shortest path, so the least of the joined ways is the answer. A request leaves both when it is
    answered or when one of them has nowhere to go. ``max_rounds`` bounds the number of edges of a path.
    """
    hop = cut(pairs(edges).filter("src <> dst"), "path-edges")
    asked = cut(requests.select("query_id", "from_id", "to_id").distinct(), "path-asked")
    done = [asked.filter("from_id = to_id").select("query_id", F.array("from_id").alias("path"))]
    apart = asked.filter("from_id <> to_id")
    sides = [
        apart.select("query_id", F.col(end).alias("node_id"), F.array(end).alias("way")) for end in ("from_id", "to_id")
    ]
    seen = [[side.select("query_id", "node_id")] for side in sides]
    steps = [
        hop.select(F.col(near).alias("node_id"), F.col(far).alias("next_id")) for near, far in (("src", "dst"), ("dst", "src"))
    ]
    longer = [F.array_append, F.array_prepend]
    sizes, stale, rounds = [apart.count()] * 2, [], 0
    while sizes[0] and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        i = 0 if sizes[0] <= sizes[1] else 1
        answered = reduce(DataFrame.unionByName, done).select("query_id")
        moving = sides[i].join(sides[1 - i].select("query_id"), "query_id", "left_semi").join(answered, "query_id", "left_anti")
        reached = moving.join(steps[i], "node_id").groupBy("query_id", F.col("next_id").alias("node_id")).agg(F.min("way").alias("way"))
        fresh = reached.join(reduce(DataFrame.unionByName, seen[i]), ["query_id", "node_id"], "left_anti")
        sides[i] = cut(fresh.withColumn("way", longer[i]("way", F.col("node_id"))), "path")
        stale.append(sides[i])
        seen[i].append(sides[i].select("query_id", "node_id"))
        ahead, behind = (side.withColumnRenamed("way", name) for side, name in zip(sides, ("ahead", "behind")))
        met = ahead.join(behind, ["query_id", "node_id"])
        whole = F.concat("ahead", F.slice("behind", 2, F.size("behind")))
        done.append(cut(met.groupBy("query_id").agg(F.min(whole).alias("path")), "path-found"))
        sizes[i] = sides[i].join(done[-1].select("query_id"), "query_id", "left_anti").count()
        if not sizes[i]:
            break
    for table in (hop, *stale):
        drop_cut(table)
    return reduce(DataFrame.unionByName, done)


def reachable_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """:func:`shortest_paths` with a row for every request, ``path`` NULL when there is none."""
    return requests.join(shortest_paths(edges, requests), "query_id", "left")


def cycles(edges: DataFrame, max_len: int | None = None, self_edges: bool | None = None) -> DataFrame:
    """(cycle array): cycles from their smallest node, each once.

    Without ``max_len`` every edge that lies on a cycle is shown on one: a shortest cycle through it, of several
    the one whose nodes from the edge's end on are smallest. These are at most as many as there are edges. With
    ``max_len`` all elementary cycles of at most so many nodes are listed, whose number has no such bound.
    A self-edge is a cycle of one node; by default it is left out if there is a bound.
    """
    out = []
    if self_edges or (self_edges is None and max_len is None):
        out.append(pairs(edges).filter("src = dst").select(F.array("src").alias("cycle")))
    if max_len is None:
        hop = cut(pairs(edges).filter("src <> dst"), "cycles")
        return reduce(DataFrame.unionByName, [*out, _cycle_of_each_edge(_within_components(hop))])
    hop = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).filter("src <> dst")
    ids, n, step = _numbered(hop)
    down = step.filter("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    out.append(_with_ids(step.filter("a < b").join(grown(down), ["a", "b"], "left_semi"), ids, n))
    if max_len >= 3:
        out.append(_triangles(ids, n, step))
    if max_len >= 4:
        out.append(_long_cycles(cut(hop.distinct(), "cycles"), max_len))
    return reduce(DataFrame.unionByName, out)


def _cycle_of_each_edge(hop: DataFrame) -> DataFrame:
    """(cycle): a shortest cycle through each (src, dst), all of which lie in strongly connected components.

    For an edge s -> t the way back from t to s is sought by two frontiers: the least paths of i steps
    from t, and of j steps to s. They meet in a node when i + j is the length of the way. So no
    frontier goes further than half the way, and edges with a cycle leave both.
    """
    ids, n, step = _numbered(hop)
    step = step.select(F.col("a").alias("s"), F.col("b").alias("t"))
    back = step.join(step.select(F.col("s").alias("t"), F.col("t").alias("s")), ["s", "t"], "left_semi")
    found = [cut(back.select("s", "t", F.array("t", "s").alias("way")), "cycles-found")]
    todo = cut(step.join(found[0].select("s", "t"), ["s", "t"], "left_anti"), "cycles-open")
    # Paths t -> p0 -> ... -> x, and x -> p0 -> ... -> s; none has a p at first.
    ahead = step.select(F.col("s").alias("t"), F.col("t").alias("x"))
    behind = step.select(F.col("t").alias("s"), F.col("s").alias("x"))
    length = 1
    while not todo.isEmpty():
        length += 1
        if length > 2:  # one more step for the frontier that is behind
            if length % 2:
                ahead = _one_step_on(ahead, "t", step.select(F.col("s").alias("x"), F.col("t").alias("y")), todo)
            else:
                behind = _one_step_on(behind, "s", step.select(F.col("t").alias("x"), F.col("s").alias("y")), todo, before=True)
        met = _met(todo, ahead, behind, n >= 1 << 31)
        between = [c for c in met.columns if c not in ("s", "t")]
        way = F.array("t", *(F.col(f"least.{c}") for c in between), "s").alias("way")
        least = met.groupBy("s", "t").agg(F.min(F.struct(*between)).alias("least"))
        found.append(cut(least.select("s", "t", way), "cycles-found"))
        left = cut(todo.join(found[-1].select("s", "t"), ["s", "t"], "left_anti"), "cycles-open")
        drop_cut(todo)
        todo = left
    ways = reduce(DataFrame.unionByName, found)
    distinct = cut(ways.select(canonical_cycle(F.col("way")).alias("ids")).distinct(), "cycles-ways")
    named = distinct.select("ids", F.posexplode("ids").alias("at", "n")).join(ids, "n")
    whole = named.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("c"))  # one cycle's nodes
    return whole.select(F.col("c.id").alias("cycle"))


#: Paths, and open edges, that one cell of :func:`_met` holds; paths of a cell while there are fewer cells than cores.
_CELL_PATHS, _CELL_EDGES, _FEW_PATHS = 2_000_000, 4_000_000, 250_000


def _one_step_on(paths: DataFrame, owner: str, step: DataFrame, todo: DataFrame, before: bool = False) -> DataFrame:
    """The least paths with one more step, of the owners that still have an open edge; ``x`` becomes the first or last node between."""
    between = [F.col(c) for c in paths.columns if c not in (owner, "x")]
    between = [F.col("x"), *between] if before else [*between, F.col("x")]
    names = [f"p{i}" for i in range(len(between))]
    longer = paths.join(todo.select(owner).distinct(), owner, "left_semi").join(grown(step), "x")
    least = longer.groupBy(owner, F.col("y").alias("x")).agg(F.min(F.struct(*(c.alias(n) for c, n in zip(between, names)))).alias("least"))
    after = cut(least.select(owner, "x", *(F.col(f"least.{n}").alias(n) for n in names)), "cycles-paths")
    if len(between) > 1:  # the first ones are the edges themselves
        drop_cut(paths)
    return after


def _met(todo: DataFrame, ahead: DataFrame, behind: DataFrame, wide: bool) -> DataFrame:
    """(s, t, c0, c1, ...): nodes of a least way from t to s for each cell of the open edges (s, t) where there is one.

    Paths meet in cells of middle nodes, which hold a bounded number of paths and look up the open edges in them. So neither a path nor
    the far more pairs of an edge and a path travel, but the edges do, packed, once for each block of middle nodes. When they are
    too many for one cell they are dealt out by s as well, and the paths from t are copied for each block of those. A cell is a
    partition: its rows are neither sorted nor held but as narrow numbers. ``wide`` says that the numbers need 64 bits.
    """
    cores = todo.sparkSession.sparkContext.defaultParallelism
    n_paths = ahead.count() + behind.count()
    by_x = max(-(-n_paths // _CELL_PATHS), min(cores, -(-n_paths // _FEW_PATHS)))
    by_s = max(1, -(-todo.count() // _CELL_EDGES))
    n_ahead, n_behind = len(ahead.columns) - 2, len(behind.columns) - 2
    nodes = [f"p{i}" for i in range(max(n_ahead, n_behind))]
    zero = F.lit(0).cast("bigint")

    def block(column: str, n: int) -> Column:
        return F.pmod(column, F.lit(n).cast("bigint"))

    def each(n: int) -> Column:
        return F.explode(F.sequence(zero, F.lit(n - 1).cast("bigint")))

    def cell(rows: DataFrame, kind: int, edges: Column, *numbers: Column) -> DataFrame:
        number = (F.col("bs") * by_x + F.col("bx")).cast("int")
        return rows.select(number.alias("cell"), F.lit(kind).alias("kind"), edges.alias("edges"), *numbers)

    def side(paths: DataFrame, owner: str, kind: int) -> DataFrame:
        of_s = block(owner, by_s) if kind == BEHIND else each(by_s)
        rows = paths.select(block("x", by_x).alias("bx"), of_s.alias("bs"), "*")
        between = [F.col(p) if p in paths.columns else zero.alias(p) for p in nodes]
        return cell(rows, kind, F.lit(None).cast("binary"), F.col(owner).alias("owner"), F.col("x"), *between)

    # Batch by batch, so no task holds more than one.
    asked = todo.select("s", "t").mapInArrow(lambda batches: packed_by_block(batches, by_s, wide), "bs bigint, edges binary")
    asked = cell(asked.select(each(by_x).alias("bx"), "bs", "edges"), EDGES, F.col("edges"), *(zero.alias(c) for c in ("owner", "x", *nodes)))
    every = side(ahead, "t", AHEAD).unionByName(side(behind, "s", BEHIND)).unionByName(asked).repartitionById(by_x * by_s, "cell")
    schema = ", ".join(f"{c} bigint" for c in ("s", "t", *(f"c{i}" for i in range(n_ahead + n_behind + 1))))
    return every.mapInArrow(lambda batches: met_in_cells(batches, n_ahead, n_behind, wide), schema)


def _digest(text: str) -> Column:
    return F.xxhash64(text)


def _numbered(hop: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """(id, n) with the numbers from 0 on of the ids in their order, how many there are, and the distinct (a, b) numbers of (src, dst)."""
    ends = hop.select(F.col("src").alias("id")).unionByName(hop.select(F.col("dst").alias("id"))).distinct()
    # Written at once, so the numbers stay as they are.
    ids = cut(ends.orderBy("id").withColumn("n", F.monotonically_increasing_id()), "cycles-ids")
    part = F.shiftright("n", 33)
    counts = sorted(ids.groupBy(part).count().collect())  # a row for each task that wrote
    before, n = [], 0
    for number, count in counts:
        before.append((number, n - (number << 33)))
        n += count
    less = hop.sparkSession.createDataFrame(before, "_part bigint, _less bigint")
    ids = ids.withColumn("_part", part).join(F.broadcast(less), "_part").select("id", (F.col("n") + F.col("_less")).alias("n"))
    # Edges travel as hashes of their ids, unless two ids share one.
    key = _digest if ids.groupBy(_digest("id").alias("id")).count().filter("count > 1").isEmpty() else F.col
    step = hop.select(key("src").alias("src"), key("dst").alias("dst"))
    for end, number in (("src", "a"), ("dst", "b")):
        step = step.join(grown(ids.select(key("id").alias(end), F.col("n").alias(number))), end).drop(end)
    return ids, n, cut(step.distinct(), "cycles")


#: So many ids are sent to all tasks, where cycles get them without travelling.
_IDS_AT_ONCE = 100_000


def _with_ids(found: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(cycle) of numbered nodes a, b and perhaps c, the last of which may be an array of several."""
    names = F.broadcast(ids) if n <= _IDS_AT_ONCE else grown(ids)
    columns = found.columns
    for c in columns:
        if isinstance(found.schema[c].dataType, T.ArrayType):
            found = found.withColumn(c, F.explode(c))
        found = found.join(names.withColumnsRenamed({"n": c, "id": f"id_{c}"}), c).drop(c)
    return found.select(F.array(*(f"id_{c}" for c in columns)).alias("cycle"))


#: Edges that one cell of :func:`_triangles` holds; edges of a cell while there are fewer cells than cores.
_TRIANGLE_EDGES, _FEW_EDGES = 8_000_000, 250_000


def triangles(hop: DataFrame) -> DataFrame:
    """(cycle): the directed 3-cycles of (src, dst) pairs without self-edges."""
    return _triangles(*_numbered(hop))


def _triangles(ids: DataFrame, n: int, step: DataFrame) -> DataFrame:
    """Directed 3-cycles of numbered edges, each found at its edge from the least node on, a -> b.

    Nodes are dealt to blocks and edges to cells of three blocks, which hold a bounded number of them. There the fewer
    of what b leads to and what leads to a are looked up in the others, so a hub does not multiply its in-edges with its
    out-edges. Only edges travel, packed, once or twice for each block: neither corners nor, but for their ids, cycles do.
    """
    n_edges, cores = step.count(), step.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(math.sqrt(2 * n_edges / _TRIANGLE_EDGES)))
    while blocks**3 < 2 * cores and 2 * n_edges > _FEW_EDGES * blocks**2:
        blocks += 1
    wide = n // blocks >= 1 << 31

    def pack(key: tuple[pa.Scalar, ...], edges: pa.Table) -> pa.Table:
        ends = [edges.column(c).to_numpy() // blocks for c in ("a", "b")]
        rows = list(packed((ends[0], ends[1]), wide))
        keys = [pa.array([k.as_py()] * len(rows), k.type) for k in key]
        return pa.Table.from_arrays([*keys, pa.array(rows, pa.binary())], ["block_a", "block_b", "up", "edges"])

    block = [F.pmod(end, F.lit(blocks)).cast("int").alias(f"block_{end}") for end in ("a", "b")]
    rows = step.select(*block, F.expr("a < b").alias("up"), "a", "b").groupBy("block_a", "block_b", "up").applyInArrow(pack, "block_a int, block_b int, up boolean, edges binary")
    # Of a cycle a -> b -> c -> a from its least node on, the first edge leads up and the last one down.
    each = F.sequence(F.lit(0), F.lit(blocks - 1))
    block_a, block_b = F.col("block_a"), F.col("block_b")

    def cells(side: int, cell: Callable[[Column], Column]) -> Column:
        return F.transform(each, lambda x: F.struct(cell(x).alias("cell"), F.lit(side).alias("side")))

    first = cells(0, lambda x: (block_a * blocks + block_b) * blocks + x)
    last = cells(2, lambda x: (block_b * blocks + x) * blocks + block_a)
    between = cells(1, lambda x: (x * blocks + block_a) * blocks + block_b)
    copies = rows.select(F.explode(F.concat(F.when(F.col("up"), first).otherwise(last), between)).alias("_to"), "edges")
    copies = copies.select("_to.cell", "_to.side", "edges").repartitionById(blocks**3, "cell")
    found = copies.mapInArrow(lambda batches: cycles_in_cells(batches, blocks, wide), "a bigint, b bigint, c array<bigint>")
    return _with_ids(found, ids, n)


def canonical_cycle(cycle: Column) -> Column:
    """A cycle turned so that it starts at its smallest node."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def _within_components(hop: DataFrame) -> DataFrame:
    """The (src, dst) whose ends lie in one strongly connected component."""
    whole = _strong_members(hop)
    ends = hop.join(grown(whole.select(F.col("id").alias("src"), F.col("whole").alias("a"))), "src")
    ends = ends.join(grown(whole.select(F.col("id").alias("dst"), F.col("whole").alias("b"))), "dst")
    return cut(ends.filter("a = b").select("src", "dst"), "cycles")


#: Two-step pairs are listed when there are at most so many for each edge.
_STEPS_PER_EDGE = 8


def _strong_members(hop: DataFrame) -> DataFrame:
    """(id, whole): the nodes of strongly connected components of two and more; ``whole`` is a number of each.

    What is known to lie in one component is contracted until no edge is left. Nodes without an in-edge or
    out-edge go first. While two-step paths are few, nodes that reach each other in at most two steps are put together, so
    short cycles vanish in a round or two; else, or when there are none, :func:`_labelled` settles some components.
    """
    hop = _trimmed(hop, "src", "dst", rounds=2)
    ends = hop.select(F.col("src").alias("id")).unionByName(hop.select(F.col("dst").alias("id"))).distinct()
    # A hash of one number is a number of its own for each, in no order that paths could follow; written at once.
    ids = cut(ends.withColumn("n", F.xxhash64(F.monotonically_increasing_id())), "strong-ids")
    step = hop.join(grown(ids.select(F.col("id").alias("src"), F.col("n").alias("s"))), "src")
    step = step.join(grown(ids.select(F.col("id").alias("dst"), F.col("n").alias("t"))), "dst").select("s", "t")
    step = _trimmed(step, "s", "t")
    moves: list[DataFrame] = []
    while not step.isEmpty():
        same = _near_pairs(step)
        if same is None:
            same, step = _labelled(step)
        else:
            same = components(same).filter("id <> component").select("id", F.col("component").alias("whole"))
        same = cut(same, "strong")
        moves.append(same)
        for end in ("s", "t"):
            step = step.join(same.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("whole", end)).drop("whole")
        step = _trimmed(step.filter("s <> t").distinct(), "s", "t")
    whole = ids.select("id", F.col("n").alias("whole"))
    for same in moves:
        same = same.select(F.col("id").alias("whole"), F.col("whole").alias("_to"))
        whole = whole.join(same, "whole", "left").select("id", F.coalesce("_to", "whole").alias("whole"))
    whole = cut(whole, "strong-members")
    return whole.join(whole.groupBy("whole").agg(F.count("*").alias("_n")).filter("_n > 1"), "whole").select("id", "whole")


def _trimmed(hop: DataFrame, src: str, dst: str, rounds: int | None = None) -> DataFrame:
    """Edges without those of nodes that have no in-edge or no out-edge, written; goes on while a round takes a tenth of them."""
    hop = cut(hop.select(src, dst), "trimmed")
    size, done = hop.count(), 0
    while size and (rounds is None or done < rounds):
        inside = hop.join(hop.select(F.col(src).alias(dst)).distinct(), dst, "left_semi")
        after = cut(inside.join(hop.select(F.col(dst).alias(src)).distinct(), src, "left_semi").select(src, dst), "trimmed")
        drop_cut(hop)
        before, hop, size, done = size, after, after.count(), done + 1
        if size > 0.9 * before:
            break
    return hop


def _near_pairs(step: DataFrame) -> DataFrame | None:
    """(source_id, target_id): nodes that reach each other in at most two steps; None if there are none, or too many to look at."""
    out = step.groupBy(F.col("s").alias("x")).agg(F.count("*").alias("n_out"))
    into = step.groupBy(F.col("t").alias("x")).agg(F.count("*").alias("n_in"))
    through = out.join(into, "x").agg(F.sum(F.col("n_out") * F.col("n_in").cast("double"))).first()[0] or 0
    if through > _STEPS_PER_EDGE * step.count():
        return None
    two = step.withColumnRenamed("t", "x").join(step.withColumnRenamed("s", "x"), "x").filter("s <> t").select("s", "t")
    near = cut(step.unionByName(two).distinct(), "strong-near")
    back = near.select(F.col("t").alias("s"), F.col("s").alias("t"))
    same = cut(near.filter("s < t").join(grown(back), ["s", "t"], "left_semi"), "strong-same")
    drop_cut(near)
    return None if same.isEmpty() else same.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"))


def _labelled(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, whole) of the nodes that reach, and are reached from, the least node that does; and the edges left to look at.

    Every node gets the least node that reaches it and the least that it reaches. Where both are one node, it lies in the component of
    that; an edge between nodes with other labels lies in none. The least node of all is settled in any case.
    """
    ends = step.select(F.col("s").alias("v")).unionByName(step.select(F.col("t").alias("v"))).distinct()
    state, open_ = cut(ends.select("v", F.col("v").alias("f"), F.col("v").alias("b")), "labels"), True
    none = F.lit(None).cast("bigint")
    while open_:
        onward = step.join(state.select(F.col("v").alias("s"), "f"), "s").select(F.col("t").alias("v"), "f", none.alias("b"))
        backward = step.join(state.select(F.col("v").alias("t"), "b"), "t").select(F.col("s").alias("v"), none.alias("f"), "b")
        own = state.select("v", "f", "b", F.col("f").alias("own_f"), F.col("b").alias("own_b"))
        every = own.unionByName(onward.unionByName(backward), allowMissingColumns=True)
        sums = [F.min("f").alias("f"), F.min("b").alias("b"), F.max("own_f").alias("own_f"), F.max("own_b").alias("own_b")]
        after = cut(every.groupBy("v").agg(*sums), "labels")
        open_ = not after.filter("f <> own_f OR b <> own_b").isEmpty()
        drop_cut(state)
        state = after
    same = state.filter("f = b AND v <> f").select(F.col("v").alias("id"), F.col("f").alias("whole"))
    ends = step.join(state.select(F.col("v").alias("s"), F.col("f").alias("fs"), F.col("b").alias("bs")), "s")
    ends = ends.join(state.select(F.col("v").alias("t"), F.col("f").alias("ft"), F.col("b").alias("bt")), "t")
    return same, ends.filter("fs = ft AND bs = bt AND fs <> bs").select("s", "t")


def _long_cycles(hop: DataFrame, max_len: int) -> DataFrame:
    """Cycles of 4 and more nodes by growing paths from the smallest node, inside strongly connected components.

    The number of paths is of the order of the number of cycles and can be very large.
    """
    hop = _within_components(hop)
    paths = hop.filter("src < dst").select(F.array("src", "dst").alias("cycle"), F.col("dst").alias("last"))
    step = hop.select(F.col("src").alias("last"), "dst")
    closing = hop.select(F.col("src").alias("last"), F.col("dst").alias("first"))
    found = [paths.select("cycle").limit(0)]
    length = 2
    while length < max_len and not paths.isEmpty():
        length += 1
        grown = paths.join(step, "last").filter(
            (F.col("dst") > F.col("cycle")[0]) & ~F.array_contains("cycle", F.col("dst"))
        )
        paths = cut(grown.select(F.array_append("cycle", F.col("dst")).alias("cycle"), F.col("dst").alias("last")), "cycles")
        if length >= 4:
            closed = paths.withColumn("first", F.col("cycle")[0]).join(closing, ["last", "first"], "left_semi")
            found.append(closed.select("cycle"))
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components, named by their smallest node.

    Texts are numbered in their order, as every round shuffles the ends of all links several times.
    """
    both = edges.select(F.col("source_id").alias("v"), F.col("target_id").alias("u"))
    if isinstance(both.schema["v"].dataType, T.StringType):
        # Written at once, so the numbers stay as they are.
        ids = nodes_of(edges).filter("id IS NOT NULL")
        ids = cut(ids.orderBy("id").withColumn("n", F.monotonically_increasing_id()), "components-ids")
        links = both.filter("v <> u")
        for end in ("v", "u"):
            links = links.join(grown(ids.withColumnRenamed("id", end)), end).drop(end).withColumnRenamed("n", end)
        members = _stars(links).select(F.col("v").alias("n"), F.col("u").alias("root"))
        members = ids.join(grown(members), "n", "left").select("id", F.coalesce("root", "n").alias("root"))
        return members.join(grown(ids.select(F.col("n").alias("root"), F.col("id").alias("component"))), "root").select("id", "component")
    links = _stars(both.filter("v <> u"))
    members = links.select(F.col("v").alias("id"), F.col("u").alias("component"))
    roots = links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    alone = both.filter("v = u").select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    alone = alone.join(members.unionByName(roots), "id", "left_anti")
    return members.unionByName(roots).unionByName(alone)


def _stars(links: DataFrame) -> DataFrame:
    """(v, u): every node v of a component but its smallest, u.

    Alternates two rewrites of the edge list until it is a set of stars: every node
    hands its larger neighbours, then its smaller ones, to the smallest node it
    knows. The number of rounds grows with the logarithm of the size.
    """
    links = cut(links.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "components")
    while True:
        ways = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = ways.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = ways.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.repartition("v").distinct()  # laid out once for what follows
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(smallest, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = cut(small.unionByName(smallest.select("v", F.col("m").alias("u"))).distinct(), "components")
        drop_cut(links)
        links = after
        if _is_stars(links):
            return links


def _is_stars(links: DataFrame) -> bool:
    """No centre is a leaf as well, and no leaf has two centres."""
    leaf = links.select(F.col("v").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre"))
    centre = links.select(F.col("u").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    roles = leaf.unionByName(centre).groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.filter("leaf > 1 OR (leaf = 1 AND centre = 1)").isEmpty()


#: Out-edges in one part of the layout. Larger parts add up more of a target's contributions before the shuffle.
_EDGES_PER_PART = 4_000_000


def pagerank(
    edges: DataFrame,
    damping: float = 0.85,
    max_iter: int = 100,
    tol: float | None = 1e-8,
    hub_rows: int = 1_000_000,
    min_iter: int = 0,
) -> DataFrame:
    """(id, score) over the distinct pairs of an edge list; dangling mass is dropped.

    Ends when no score changes by ``tol``, after ``min_iter`` rounds at least and ``max_iter`` at most.

    The out-edges of a hub are dealt to several partitions by a salt, and the edge
    list is laid out by (source, salt) once. A round then moves only the scores (with
    a copy for each salt) and the partially summed contributions.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("most")).unionByName(
        edges.select(F.col("target_id").alias("id"), F.lit(0).alias("most"))
    )
    # Short numbers stand for the ids from here on; written at once, so they stay as they are.
    nodes = ends.groupBy("id").agg(F.sum("most").cast("bigint").alias("most"))
    nodes = cut(nodes.withColumn("nid", F.monotonically_increasing_id()), "pagerank-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("score"))
    copies = F.ceil(F.col("most") / F.lit(hub_rows)).cast("int")
    hubs = nodes.filter(copies > 1).select(F.col("nid").alias("s"), copies.alias("copies"))  # one for each hub_rows edges, at most
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = min(most, max(cores, edges.count() // _EDGES_PER_PART))
    # Repeated pairs are dropped as numbers, where the layout puts them. An end without an id counts as one, and gets nothing.
    layout = (
        edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
        .join(nodes.select(F.col("id").alias("src"), F.col("nid").alias("s")), "src")
        .join(nodes.select(F.col("id").alias("dst"), F.col("nid").alias("d")), "dst", "left")
        .select("s", F.coalesce("d", F.lit(-1).cast("bigint")).alias("d"))
        .join(F.broadcast(hubs), "s", "left")
        .select("s", F.pmod(F.xxhash64("d"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"), "d")
        .repartition(partitions, "s", "salt")
        .distinct()
        .sortWithinPartitions("s", "salt")
        .persist()
    )
    degrees = layout.groupBy(F.col("s").alias("nid")).agg(F.count("*").alias("deg"))
    state = nodes.select("nid").join(degrees, "nid", "left")
    state = cut(state.select("nid", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(1.0 / n).alias("score")), "pagerank")
    base = (1.0 - damping) / n
    for done in range(1, max_iter + 1):
        giving = state.filter("deg > 0").select(F.col("nid").alias("s"), (F.col("score") / F.col("deg")).alias("part"))
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt")
        giving = giving.join(F.broadcast(hubs), "s", "left").select("s", "part", salts)
        got = layout.filter("d >= 0").join(giving, ["s", "salt"]).select(F.col("d").alias("nid"), "part")
        # A zero row for every node saves the outer join back to the nodes.
        kept = state.select("nid", F.lit(0.0).alias("part"), "deg", F.col("score").alias("prev"))
        total = got.unionByName(kept, allowMissingColumns=True).groupBy("nid").agg(
            F.sum("part").alias("part"), F.max("deg").alias("deg"), F.max("prev").alias("prev")
        )
        score = F.lit(base) + F.lit(damping) * F.col("part")
        before, state = state, cut(total.select("nid", "deg", score.alias("score"), "prev"), "pagerank")
        drop_cut(before)
        if tol is not None and done >= min_iter and state.agg(F.max(F.abs(F.col("score") - F.col("prev")))).first()[0] < tol:
            break
    layout.unpersist()
    return state.join(nodes.select("nid", "id"), "nid").select("id", "score")


def layers(edges: DataFrame, condense: bool = False) -> DataFrame:
    """(id, layer): nodes by rounds of removing those without an in-edge.

    Nodes on or behind a cycle are left when the rounds come to an end; they form one
    last layer. With ``condense`` every strongly connected component is contracted to one node first, so
    all nodes get a layer of their component and edges between components lead to a later layer.
    """
    every = cut(pairs(edges), "layers-edges")
    nodes = every.select(F.col("src").alias("id")).unionByName(every.select(F.col("dst").alias("id"))).distinct()
    if not condense:
        return _peeled(nodes, every)
    named = _strong_members(every.filter("src <> dst"))
    # A component goes by the id of one of its nodes, so that it is told from the nodes that are alone.
    called = named.groupBy("whole").agg(F.min("id").alias("called"))
    named = named.join(called, "whole").select("id", "called")
    member = cut(nodes.join(named, "id", "left").select("id", F.coalesce("called", "id").alias("whole")), "layers-members")
    ends = every.join(member.select(F.col("id").alias("src"), F.col("whole").alias("a")), "src")
    ends = ends.join(member.select(F.col("id").alias("dst"), F.col("whole").alias("b")), "dst")
    hop = cut(ends.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "layers-hop")
    peeled = _peeled(member.select(F.col("whole").alias("id")).distinct(), hop)
    return member.join(peeled.withColumnRenamed("id", "whole"), "whole").select("id", "layer")


def _peeled(nodes: DataFrame, hop: DataFrame) -> DataFrame:
    """(id, layer) of :func:`layers`; ``hop`` is a written table and goes when it is spent.

    The edges of removed nodes are dropped whenever they are more than half of the table, so that all rounds
    together read a small multiple of it.
    """
    ends = hop.select(F.col("dst").alias("id"), F.lit(1).alias("deg"), F.lit(0).alias("out")).unionByName(
        hop.select(F.col("src").alias("id"), F.lit(0).alias("deg"), F.lit(1).alias("out"))
    )
    zero = nodes.select("id", F.lit(0).alias("deg"), F.lit(0).alias("out"))
    left = cut(zero.unionByName(ends).groupBy("id").agg(F.sum("deg").alias("deg"), F.sum("out").alias("out")), "layers")
    out: list[DataFrame] = []
    held, spent = left.agg(F.coalesce(F.sum("out"), F.lit(0))).first()[0], 0
    while True:
        free = left.filter("deg = 0")
        n_free, n_out = free.agg(F.count("*"), F.coalesce(F.sum("out"), F.lit(0))).first()
        if not n_free:
            break
        out.append(free.select("id", F.lit(len(out)).alias("layer")))
        gone = hop.join(free.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("less"))
        rest = left.filter("deg > 0").join(gone, "id", "left")
        left = cut(rest.select("id", (F.col("deg") - F.coalesce("less", F.lit(0))).alias("deg"), "out"), "layers")
        spent += n_out
        if 2 * spent > held > 0:
            after = cut(hop.join(left.select(F.col("id").alias("src")), "src", "left_semi"), "layers-hop")
            drop_cut(hop)
            hop, held, spent = after, held - spent, 0
    out.append(left.select("id", F.lit(len(out)).alias("layer")))
    return reduce(DataFrame.unionByName, out)


def dfs_preorder(edges: DataFrame, starts: DataFrame, max_depth: int = 2, edge_types: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, depth, path): depth-first, neighbours in id order; sorting by ``path`` gives the preorder.

    A node first met at the depth limit is not entered again from a shallower one, so
    the result can be smaller than that of a breadth-first search.

    Depth-first order is the order of tree paths, and the path of a node is the least
    among the paths of its entered predecessors, each extended by the node. That is
    computed for all nodes at once and repeated until nothing changes: a path rests on
    smaller paths only, so the end state is the one the step-by-step search reaches.
    """
    hop = pairs(edges, edge_types).withColumnRenamed("src", "node_id")
    if max_depth > 0:
        near = bfs(edges, starts, max_depth - 1, edge_types, include_start=True).select("node_id").distinct()
        hop = cut(hop.join(near, "node_id", "left_semi"), "dfs-edges")
    begin = starts.select("query_id", F.col("start_id").alias("node_id"), F.array("start_id").alias("path")).distinct()
    labels = cut(begin, "dfs")
    while True:
        entered = labels.filter(F.size("path") <= max_depth)
        steps = entered.join(hop, "node_id").select(
            "query_id", F.col("dst").alias("node_id"), F.array_append("path", F.col("dst")).alias("path")
        )
        best = begin.unionByName(steps).groupBy("query_id", "node_id").agg(F.min("path").alias("path"))
        after = cut(best, "dfs")
        moved = after.join(labels, ["query_id", "node_id", "path"], "left_anti").isEmpty()
        gone = moved and labels.join(after, ["query_id", "node_id", "path"], "left_anti").isEmpty()
        drop_cut(labels)
        labels = after
        if moved and gone:
            return labels.select("query_id", "node_id", (F.size("path") - 1).alias("depth"), "path")
