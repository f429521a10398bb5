"""The prefix trie of conversations, by truncation peeling.

From the greatest depth down, the conversations that end at a depth join the nodes that
survived from below; each is one node with all its figures. Then every node loses its last
turn, and those that have become equal are merged into one: the node above. So a
level's nodes are found and summed up in the same step.

A subtree below ``TURNS`` turns is peeled by one task, many of them together. Prefixes that
more turns share are peeled by Spark, a level at a time, and partial sums meet before the
shuffle. Turns are held as digests; the key of a prefix is the XOR of hashes of its (place, turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t
from kodagraf.runtime import cut, drop_cut

GROUP = 5
MOST_SHARED = 9
#: Turns below a prefix from which on its subtree is split.
TURNS = 20_000
#: Conversation ids joined in one piece of a digest; turns of the subtrees that a task peels together.
PIECE, TOGETHER = 1_000, 100_000
#: Nodes shared by that many turns are sent to all tasks up to this number, and joined by a shuffle beyond it.
SENT = 1_000_000

KEY = 16
#: One row for each distinct conversation and piece of its ids. ``path`` holds the keys of its prefixes.
PIECES = t.struct(full=T.BinaryType(), first="long", n="long", ids="string", depth="int", path=T.BinaryType(), bytes=T.ArrayType(T.LongType()))
NODE = t.struct(conv_id="long", depth="long", parent_conv_id="long", n_convs="long", n_children="long", n_leaves="long", saved_tokens="long", ends_sha256="string")
#: ``path`` is null for a node below the top of its subtree; ``ends`` marks conversations that end above all subtrees.
PEELED = T.StructType([*NODE.fields, *t.struct(ends="boolean", path=T.BinaryType(), bytes=T.ArrayType(T.LongType())).fields])
NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and size of each turn, the first ones taken from the group's first conversation."""
    number = F.col("conv_id").cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        number.alias("conv"),
        (number - number % GROUP).alias("base"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
    )
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "digest", "bytes")
    held = rows.repartition("base").groupBy("base", "conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    short = F.transform("turns", lambda x: F.struct(F.xxhash64(x.role, x.digest).alias("h"), F.xxhash64(F.lit(1), x.digest, x.role).alias("g"), x.bytes.alias("bytes")))
    held = held.select("base", "conv", short.alias("turns"))
    shared = held.filter("conv = base").select("base", F.slice("turns", 1, MOST_SHARED - 1).alias("start"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    start = F.coalesce(F.slice("start", F.lit(1), h), F.expr("slice(turns, 1, 0)"))
    whole = F.concat(start, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1))))
    return held.join(shared, "base", "left").select(F.col("conv").alias("conv_id"), whole.alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece for each conversation, with the keys of its prefixes."""
    schema = to_arrow_schema(PIECES)
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column("turns")
        offsets = turns.offsets.to_numpy()
        flat = turns.values.slice(offsets[0], offsets[-1] - offsets[0])
        starts = offsets - offsets[0]
        place = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
        keys = np.zeros((len(flat) + 1, 2), np.uint64)
        for i, (name, seed) in enumerate((("h", 3), ("g", 5))):
            x = flat.field(name).to_numpy().view(np.uint64)
            keys[1:, i] = t.mix(x ^ t.mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))
        keys = np.bitwise_xor.accumulate(keys)
        size, ids, full, path, sizes = flat.field("bytes").to_numpy(), batch.column("conv_id").to_pylist(), [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            mine = (keys[a + 1 : b + 1] ^ keys[a]).tobytes()
            path.append(mine)
            full.append(mine[-KEY:] or b"\0" * KEY)
            sizes.append(size[a:b])
        n = batch.num_rows
        columns = [full, ids, np.ones(n, np.int64), [str(i) for i in ids], np.diff(starts), path, sizes]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key that follow each other become one piece, of ``PIECE`` ids at most."""
    schema, held, ids = to_arrow_schema(PIECES), None, []

    def piece() -> dict:
        return held | {"n": len(ids), "ids": ",".join(ids)}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is None or row["full"] != held["full"] or row["depth"] != held["depth"] or len(ids) == PIECE:
                out += [piece()] if held else []
                held, ids = row, []
            ids.append(row["ids"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([piece()], schema=schema)


class Node:
    """A prefix: its smallest conversation, and the sums over its subtree. ``of`` is a conversation that has it."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "of", "kids")

    def __init__(self, of: dict):
        self.of, self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.kids = of, of["first"], 0, 0, 0, 0, NONE, []


def _peel(classes: list[dict]) -> Iterator[dict]:
    """Nodes of whole subtrees, from their greatest depth up to their tops."""
    ending: dict[int, list[dict]] = {}
    for c in classes:
        ending.setdefault(c["depth"], []).append(c)
    alive: dict[bytes, Node] = {}
    for depth in range(max(ending), 0, -1):
        for c in ending.get(depth, []):
            node = alive.setdefault(c["path"][-KEY:], Node(c))
            node.conv, node.n, node.ends = min(node.conv, c["first"]), node.n + c["n"], c["sha"]
        above: dict[bytes, Node] = {}
        for node in alive.values():
            c = node.of
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * c["bytes"][depth - 1]
            for kid in node.kids:
                yield kid | {"parent_conv_id": node.conv}
            row = dict(conv_id=node.conv, depth=depth, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, ends_sha256=node.ends, ends=False)
            if depth == c["top"]:
                yield row | {"path": c["path"][: KEY * (depth - 1)], "bytes": c["bytes"][: depth - 1]}
                continue
            key = c["path"][KEY * (depth - 2) : KEY * (depth - 1)]
            up = above.setdefault(key, Node(c))
            up.conv, up.n, up.children = min(up.conv, node.conv), up.n + node.n, up.children + 1
            up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
            up.kids.append(row)
        alive = above


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of subtree, conversation and first id: digests, then nodes."""
    schema = to_arrow_schema(PEELED)
    whole: list[dict] = []
    now: dict | None = None
    turns = 0

    def peeled(classes: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = []
        for c in classes:
            if c["top"] > c["depth"]:  # ends in a prefix that is peeled later
                rows.append(dict(conv_id=c["first"], depth=c["depth"], n_convs=c["n"], n_children=0, n_leaves=0, saved_tokens=0, ends_sha256=c["sha"], ends=True, path=c["path"], bytes=c["bytes"]))
        inside = [c for c in classes if c["top"] <= c["depth"]]
        for row in _peel(inside) if inside else ():
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and row["full"] == now["full"] and row["depth"] == now["depth"]:
                now["n"] += row["n"]
                now["digest"].update(b"," + row["ids"].encode())
                continue
            if now is not None:
                now["sha"] = now.pop("digest").hexdigest()
                if turns >= TOGETHER and row["subtree"] != now["subtree"]:
                    yield from peeled(whole)
                    whole, turns = [], 0
            now = row | {"digest": hashlib.sha256(row["ids"].encode())}
            whole.append(now)
            turns += row["depth"] + 1
    if now is not None:
        now["sha"] = now.pop("digest").hexdigest()
        yield from peeled(whole)


def _key_at(depth: Column | int) -> Column:
    """The key of a prefix; the root's is empty."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.substring("path", (depth - 1) * KEY + 1, F.lit(KEY))).otherwise(F.lit(b""))


def _with_tops(pieces: DataFrame) -> tuple[DataFrame, int]:
    """Pieces with ``top``, the depth at which their subtree starts, and the greatest depth that is shared too widely.

    ``top`` is one more than ``depth`` where the whole conversation is such a prefix.
    """
    settled, todo, depth = [], pieces, 0
    while True:
        depth += 1
        todo = todo.withColumn("top", F.lit(depth))
        settled.append(todo.filter(F.col("depth") < depth))
        todo = todo.filter(F.col("depth") >= depth)
        turns = todo.withColumn("key", _key_at(depth)).groupBy("key").agg(F.sum("depth").alias("turns"))
        wide = cut(turns.filter(F.col("turns") > TURNS).select("key"), "trie-wide")
        n_wide = wide.count()
        if not n_wide:
            settled.append(todo)
            return reduce(DataFrame.unionByName, settled), depth - 1
        wide = F.broadcast(wide) if n_wide <= SENT else wide
        keyed = todo.withColumn("key", _key_at(depth))
        settled.append(keyed.join(wide, "key", "left_anti").drop("key"))
        todo = cut(keyed.join(wide, "key", "left_semi").drop("key", "top"), "trie-todo")


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth from the nodes below them and the conversations that end there."""
    summed = rows.withColumn("key", _key_at(depth)).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.count_if(~F.col("ends")).alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved"),
        F.max(F.when(F.col("ends"), F.col("ends_sha256"))).alias("sha"),
        F.max(F.when(F.lit(depth > 0), F.substring("path", 1, KEY * depth))).alias("path"),
        F.max(F.slice("bytes", 1, max(depth, 1))).alias("bytes"),
    )
    last = F.element_at("bytes", depth) if depth else F.lit(0)
    return summed.select(
        "conv_id",
        F.lit(depth).cast("long").alias("depth"),
        "n_convs",
        "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"),
        F.coalesce("sha", F.lit(NONE)).alias("ends_sha256"),
        F.lit(False).alias("ends"),
        "path",
        "bytes",
        "key",
    )


def nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in the order of ``turn``, null first; equal ones in the order of role and of the text's
    MD5, and a repeated row is one more turn. Null role or text counts as empty, also very long ones as
    they are (only digests are held). Rows without conv_id belong to no conversation and are left out. Without conversations
    there is no node, not even a root. Other columns are not looked at. A conversation's
    turns (24 bytes each) must fit into a task.
    """
    single = cut(rebuilt(conversations).mapInArrow(_paths, PIECES), "trie-paths")
    by_text = single.repartitionByRange("full", "first").sortWithinPartitions("full", "depth", "first")
    pieces = cut(by_text.mapInArrow(_joined, PIECES), "trie-pieces")
    drop_cut(single)
    topped, widest = _with_tops(pieces)
    # A subtree goes to one task, and so does a conversation that ends above all subtrees.
    keyed = topped.withColumn("subtree", F.when(F.col("top") > F.col("depth"), F.col("full")).otherwise(_key_at(F.col("top"))))
    dealt = keyed.repartition("subtree").sortWithinPartitions("subtree", "full", "depth", "first")
    peeled = cut(dealt.mapInArrow(_subtrees, PEELED), "trie-peeled")
    drop_cut(pieces)

    result = [peeled.filter(F.col("path").isNull())]
    tops = peeled.filter(F.col("path").isNotNull())
    below: DataFrame | None = None
    for depth in range(widest, -1, -1):
        starts = tops.filter((F.col("ends") & (F.col("depth") == depth)) | (~F.col("ends") & (F.col("depth") == depth + 1)))
        children = starts if below is None else starts.unionByName(below, allowMissingColumns=True)
        level = cut(_level(children, depth), f"trie-level{depth}")
        kids = children.filter(~F.col("ends")).drop("parent_conv_id").withColumn("key", _key_at(depth))
        if depth:
            parents = level.select("key", F.col("conv_id").alias("parent_conv_id"))
            kids = kids.join(F.broadcast(parents) if level.count() <= SENT else parents, "key")
        else:  # the root is one row
            root = level.first()
            kids = kids.withColumn("parent_conv_id", F.lit(root and root["conv_id"]).cast("long"))
        result.append(kids)
        below = level.drop("key")
    result.append(below.withColumn("parent_conv_id", F.lit(None).cast("long")))
    return reduce(DataFrame.unionByName, [r.select(*[F.col(f.name).cast(f.dataType) for f in NODE.fields]) for r in result])


def report(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of the conversations."""
    return nodes(conversations)


SQL = r"""
WITH RECURSIVE crc(v, i, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT v, i + 1, list_reduce(list_prepend(xor(c, ascii(substr(v::VARCHAR, i + 1, 1))::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                               lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM crc WHERE i < length(v::VARCHAR)
),
h AS (SELECT v AS conv_id, (xor(c, 4294967295) % 9)::BIGINT AS h FROM crc WHERE i = length(v::VARCHAR)),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND p <= h
      UNION ALL SELECT h.conv_id, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND p > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, md5(length(role) || ':' || role || text) AS k,
             strlen(text)::BIGINT AS bytes FROM r),
x AS (SELECT conv_id, d, bytes, string_agg(k, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM o
      UNION ALL SELECT conv_id, 0, 0, '' FROM h),
e AS (SELECT *, max(d) OVER (PARTITION BY conv_id) = d AS ends FROM x),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS sha FROM e GROUP BY path),
c AS (SELECT left(path, length(path) - 32) AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT left(n.path, 32 * a) AS path, sum(saved)::BIGINT AS saved, count(*) FILTER (c.path IS NULL) AS leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM n) n LEFT JOIN c ON c.path = n.path GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(children, 0)::BIGINT AS n_children, leaves AS n_leaves,
       s.saved AS saved_tokens, n.sha AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN c ON c.path = n.path
LEFT JOIN n p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""
