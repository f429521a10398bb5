"""Near-duplicate join on word shingles by parity sketches.

Toggling one bit per shingle makes a sketch whose Hamming distance never exceeds the
symmetric difference of two sets. Sizes fall into bands such that linked sets are in
the same or neighbouring bands. For each pair of bands a long sketch is cut into
segments of 2^32 bits, which are never laid out: a segment stands as the XOR of the
hashes of its shingles. Two sets that may differ in ``d`` shingles differ in at most
``d`` segments. All segments have one order (most shingles first, then by hash), so
among the first ``d + 1`` segments of both sets there is an equal one: an equi-join on
those finds every linked pair.

Sets that are equal are one class. Segments shared by several classes are searched
within bounded blocks: only pairs of classes that are not known to be connected and
whose short sketches (some bits per shingle, folded to equal length) are close enough
come out, as a forest, and are verified on their whole shingle sets. Rounds go on until no untried pair is left, so no link is lost and no
group is expanded into all its pairs.

Shingles are compared by 64-bit hashes, sets of equal size by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.llm import text as t
from kodagraf.llm.skew import hot_keys
from kodagraf.operators.graph import components
from kodagraf.runtime import cut, drop_cut

BATCH = 1 << 20
#: Up to this number of rows (16 bytes each) a key set is broadcast to spare the larger side its shuffle.
BROADCAST_ROWS = 1_000_000
#: Stands for a missing doc_id in keys.
NO_ID = -(1 << 63)
#: Classes that are compared in one block; larger groups are cut.
BLOCK = 4_096
CLUSTER = 8 * BLOCK
#: Bits of a short sketch for each shingle, at least.
BITS = 4
#: Bytes of sketches in a block, about.
BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """Sets link when ``of * intersection >= part * union``; shingles of ``words`` words."""

    words: int = 5
    part: int = 80
    of: int = 100

    def close(self, size: np.ndarray | int, difference: np.ndarray | int) -> np.ndarray | bool:
        """Whether sets with this sum of sizes may differ in so many elements."""
        return (self.of + self.part) * difference <= (self.of - self.part) * size


@lru_cache(maxsize=8)
def bands(rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Smallest size of each band, and the segments of the sketches for bands (k, k + 1); 0: only equal sets link."""
    low = [1, 2]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, rule.of * (low[-1] - 1) // rule.part + 1))
    segments = []
    for following in low[1:]:
        most = following - 1
        d = (rule.of - rule.part) * (most + rule.of * most // rule.part) // (rule.of + rule.part)
        n = d + 1
        for _ in range(20):  # spare segments for those with at most one element
            mean = most / n
            light = min(0.3, math.exp(-mean) * (1 + mean))
            n = math.ceil((d + 1) / (1 - light)) + (1 if d else 0)
        segments.append(n if d else 0)
    return np.array(low, np.int64), np.array(segments, np.int64)


def differences(rule: Rule, band: int) -> int:
    most = int(bands(rule)[0][band + 1]) - 1
    return (rule.of - rule.part) * (most + rule.of * most // rule.part) // (rule.of + rule.part)


def sketch(elements: np.ndarray, segments: int) -> np.ndarray:
    """Parities of the elements over ``segments`` words of 64 bits."""
    if segments == 0:
        return np.zeros(0, np.uint64)
    place = ((elements >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    at = place.astype(np.int64) * 64 + (elements & np.uint64(63)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * segments) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A sketch of 2^k words brought down to ``size`` words; it bounds the difference as before."""
    while len(words) > size:
        words = words[0::2] ^ words[1::2]
    return words


def width(rule: Rule, band: int) -> int:
    """Words of the short sketch, a power of two."""
    return 1 << max(0, (BITS * int(bands(rule)[0][band]) - 1) // 64).bit_length()


def keys(elements: np.ndarray, rule: Rule, band: int) -> np.ndarray:
    """Join keys of a set (sorted) for its own band with the following, and for the one below with its own."""
    low, segments = bands(rule)
    n, found = len(elements), []
    for b, partner in ((band, min(rule.of * n // rule.part, int(low[band + 2]) - 1)), (band - 1, int(low[band]) - 1)):
        d = (rule.of - rule.part) * (n + partner) // (rule.of + rule.part)
        if b < 0 or d == 0 or segments[b] == 0:
            continue  # only equal sets link
        place = ((elements >> np.uint64(32)) * np.uint64(segments[b])) >> np.uint64(32)
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        total, count, place = np.bitwise_xor.reduceat(elements, start), np.diff(np.append(start, n)), place[start]
        if len(start) <= d:
            empty = np.setdiff1d(np.arange(segments[b], dtype=np.uint64), place, assume_unique=True)
            place = np.append(place, empty)
            total = np.append(total, np.zeros(len(empty), np.uint64))
            count = np.append(count, np.zeros(len(empty), np.int64))
        salt = (place << np.uint64(16)) + np.uint64(b)
        h = t.mix(total ^ t.mix(salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        found.append(h[np.lexsort((h, -count))[: d + 1]])
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in t.slices(batches, "text", BATCH):
        h, at = t.word_hashes(*t.flat(part.column(part.schema.get_field_index("text"))), t.NOT_SPACE)
        yield part, [t.shingles(h[at[i] : at[i + 1]], k) for i in range(part.num_rows)]


def _digest(elements: np.ndarray) -> tuple[int, int]:
    other = t.mix(elements * np.uint64(0xD6E8FEB86659FD93) + np.uint64(5))
    return int(elements.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def semi(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``wanted`` (a written table): by broadcast if it is small, else by shuffle."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, on, "left_semi")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``id`` (of the document, never null) and ``content`` (a hash of the text)."""
    return docs.withColumns({"id": F.coalesce(F.col(doc_id), F.lit(NO_ID)), "content": F.xxhash64(text)})


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(row, id, content, n, f1, f2, band, bits, keys): set size, set digest, short sketch and join keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, _ = bands(rule)
        for part, sets in _sets(batches, rule.words):
            n = [len(s) for s in sets]
            band = np.searchsorted(low, n, "right") - 1
            digest = [_digest(s) for s in sets]
            bits = [sketch(s, width(rule, int(b))).tobytes() if b >= 0 else b"" for s, b in zip(sets, band)]
            of = [keys(s, rule, int(b)) if b >= 0 else np.zeros(0, np.int64) for s, b in zip(sets, band)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in of])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array(n, pa.int64()),
                    pa.array([x for x, _ in digest], pa.int64()),
                    pa.array([x for _, x in digest], pa.int64()),
                    pa.array(band, pa.int32()),
                    pa.array(bits, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(of))),
                ],
                names=["row", "id", "content", "n", "f1", "f2", "band", "bits", "keys"],
            )

    return docs.select(F.monotonically_increasing_id().alias("row"), "id", "content", "text").mapInArrow(
        run,
        "row long, id long, content long, n long, f1 long, f2 long, band int, bits binary, keys array<long>",
    )


def _groups(segments: DataFrame) -> DataFrame:
    """(grp, size, row): groups of classes such that every linked pair is within one.

    Classes that shared keys connect are one cluster, and each class is in it once. A
    cluster above ``CLUSTER`` is left as its keys (of keys with the same holders, one).
    """
    hot = cut(hot_keys(segments, ["key"], segments.count()), "jaccard-hot")
    by_key = Window.partitionBy("key")
    cold = segments.join(F.broadcast(hot), "key", "left_anti").withColumns(
        {"n": F.count("*").over(by_key), "lead": F.min("row").over(by_key)}
    )
    of_hot = segments.join(F.broadcast(hot), "key", "left_semi")
    leads = of_hot.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("lead"))  # as few as ``hot``
    columns = ["key", "row", "n", "lead"]
    members = cold.filter("n > 1").select(*columns).unionByName(of_hot.join(F.broadcast(leads), "key").select(*columns))
    members = cut(members, "jaccard-members")
    stars = members.filter("row <> lead").select(F.col("row").alias("source_id"), F.col("lead").alias("target_id"))
    stars = cut(stars.distinct(), "jaccard-stars")
    # Classes take the smallest lead as a label; only what connects different labels is left to search.
    label = cut(stars.groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("label")), "jaccard-labels")

    def labelled(rows: DataFrame, column: str) -> DataFrame:
        few = label.count() <= BROADCAST_ROWS
        found = rows.join(F.broadcast(label) if few else label, F.col(column) == F.col("id"), "left")
        return found.withColumn(column, F.coalesce("label", column)).drop("id", "label")

    between = labelled(labelled(stars, "source_id"), "target_id").filter("source_id <> target_id").distinct()
    joined = components(between).select(F.col("id").alias("label"), F.col("component").alias("cluster"))
    rows = label.select(F.col("id").alias("row"), "label").unionByName(stars.select(F.col("target_id").alias("row"), F.col("target_id").alias("label")).distinct())
    rows = rows.groupBy("row").agg(F.min("label").alias("label"))
    cluster = cut(
        rows.join(joined, "label", "left").select("row", F.coalesce("cluster", "label").alias("cluster")), "jaccard-clusters"
    )
    sizes = cut(cluster.groupBy("cluster").agg(F.count("*").alias("size")), "jaccard-sizes")
    small = cluster.join(sizes.filter(F.col("size") <= CLUSTER), "cluster").select(
        F.concat(F.lit("c"), F.hex("cluster")).alias("grp"), "size", "row"
    )
    inside = cluster.join(sizes.filter(F.col("size") > CLUSTER), "cluster").select("row")
    large = members.join(inside, "row", "left_semi")
    holders = large.groupBy("key", "n").agg(
        F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x2")
    )
    one = holders.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    large = large.join(one.select("key"), "key", "left_semi")
    large = large.select(F.concat(F.lit("k"), F.hex("key")).alias("grp"), F.col("n").alias("size"), "row")
    groups = cut(small.unionByName(large), "jaccard-groups")
    for spent in (members, stars, label, cluster, sizes):
        drop_cut(spent)
    return groups


def _candidates(members: DataFrame, rule: Rule, tried: DataFrame | None, at_once: int) -> DataFrame:
    """(a, b): close pairs of different components that connect the classes of a block.

    members: block, row, component, n, band, bits. tried: pairs that verification has refused. With
    ``at_once`` above 1 a class is tried with so many of a component in one turn, since
    pairs near the bound are often refused; the others wait for the next turn.
    """
    columns = ["block", "row", "component", "n", "band", "bits"]
    rows = members.select(*columns, F.lit(None).cast("bigint").alias("not_with"))
    if tried is not None:
        held = members.select("block", F.col("row").alias("a")).join(tried, "a")
        both = held.join(members.select("block", F.col("row").alias("b")), ["block", "b"])
        empty = [F.lit(None).cast(members.schema[c].dataType).alias(c) for c in columns[2:]]
        rows = rows.unionByName(both.select("block", F.col("a").alias("row"), *empty, F.col("b").alias("not_with")))

    def close(group: list[tuple], refused: set[tuple[int, int]]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {g[1]: g[1] for g in group}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs: list[tuple[int, int]] = []
        for band in sorted({g[3] for g in group}):
            here = [g for g in group if g[3] in (band, band + 1)]
            if len(here) < 2:
                continue
            bits = np.stack([fold(np.frombuffer(g[4], np.uint64), width(rule, band)) for g in here])
            size, same = np.array([g[2] for g in here]), np.array([g[3] for g in here])
            for i in range(1, len(here)):
                if same[i] == band:
                    others = np.arange(i)
                else:
                    others = np.flatnonzero(same[:i] == band)
                apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(rule.close(size[others] + size[i], apart))
                tries: dict[int, int] = {}
                for j in near[np.argsort(apart[near], kind="stable")]:
                    x, y = here[others[j]], here[i]
                    if (a := root(x[1])) == (b := root(y[1])):
                        continue
                    pair = (min(x[0], y[0]), max(x[0], y[0]))
                    if pair in refused:
                        continue
                    if at_once == 1:
                        parent[a] = b
                    elif (met := tries.get(a, 0)) >= at_once:
                        continue
                    else:
                        tries[a] = met + 1
                    pairs.append(pair)
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, refused = None, [], set()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for block, *row, other in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    out += close(group, refused) if len(group) > 1 else []
                    at, group, refused = block, [], set()
                if other is None:
                    group.append(tuple(row))
                else:
                    refused.add((min(row[0], other), max(row[0], other)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
                )
        if len(group) > 1 and (out := close(group, refused)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
            )

    dealt = rows.repartition("block").sortWithinPartitions("block", "not_with", "n", "row")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _blocks(members: DataFrame, first: bool) -> DataFrame:
    """(block, row, component): a block for each group, and for larger groups blocks that hold every open pair.

    members: grp, size, row, component, bytes. At first a large group is cut and its
    smallest class goes along with each piece, which already connects most copies of one
    text. Later the classes that are connected with that smallest class (the core) need to
    meet only the rest, and the rest each other.
    """
    of_group = members.groupBy("grp").agg(
        F.min(F.struct("row", "component")).alias("lead"), F.sum("bytes").alias("bytes"), F.max("size").alias("n")
    )
    cuts = F.ceil(2 * F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    of_group = of_group.withColumn("cuts", F.when(cuts <= 2, F.lit(1)).otherwise(cuts)).drop("bytes", "n")
    whole = members.join(of_group, "grp")
    small = whole.filter("cuts = 1").withColumn("block", F.col("grp"))
    large = whole.filter("cuts > 1")
    piece = F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int")
    if first:
        pieces = F.when(F.col("row") == F.col("lead.row"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(piece))
        large = large.withColumn("piece", F.explode(pieces)).withColumn(
            "block", F.concat_ws(":", "grp", F.col("piece").cast("string"))
        )
    else:
        in_core = F.col("component") == F.col("lead.component")
        rest = large.groupBy("grp").agg(F.count_if(~in_core).alias("rest"), F.count("*").alias("n"))
        large = large.join(rest.filter("rest > 0"), "grp").withColumn(
            "parts", F.ceil(F.col("cuts") * F.col("rest") / F.col("n")).cast("int")
        )
        of_rest = F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")).cast("int")
        to_rest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.concat_ws("-", i, piece))
        met = F.concat(
            F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.concat_ws("-", of_rest, j)),
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda i: F.concat_ws("+", F.least(i, of_rest), F.greatest(i, of_rest)),
            ),
        )
        large = large.withColumn("piece", F.explode(F.when(in_core, to_rest).otherwise(met)))
        large = large.withColumn("block", F.concat_ws(":", "grp", "piece"))
    columns = ["block", "row", "component"]
    return small.select(*columns).unionByName(large.select(*columns))


def _verified(pairs: DataFrame, docs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked) by the whole shingle sets of both texts, made anew from ``docs`` (id, content, text)."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = cut(held.select("row", "id", "content").join(wanted, "row", "left_semi"), "jaccard-wanted")
    needed = semi(docs.select("id", "content", "text"), wanted.select("id", "content"), ["id", "content"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, rule.words):
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "content", "set"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(rule.of * both >= rule.part * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    made = needed.mapInArrow(of, "id long, content long, set binary").dropDuplicates(["id", "content"])
    sets = cut(made.join(wanted, ["id", "content"]).select("row", "set"), "jaccard-sets")
    wide = pairs.join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b"
    )
    return wide.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")


def links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set digests, classes of equal sets, and the components of classes that have links.

    docs: id, content, text.
    """
    rows = cut(sketches(docs, rule), "jaccard-rows")
    classes = cut(
        rows.filter("n > 0").groupBy("f1", "f2").agg(
            F.min("row").alias("row"), F.min(F.nullif("id", F.lit(NO_ID))).alias("first_id"), F.count("*").alias("copies")
        ),
        "jaccard-classes",
    )
    heads = semi(rows.filter("n > 0").select("row", "keys"), classes.select("row"), ["row"])
    if classes.count() > BROADCAST_ROWS:
        heads = cut(heads, "jaccard-heads")  # shuffled once
    groups = _groups(heads.select(F.explode("keys").alias("key"), "row"))
    wanted = cut(groups.select("row").distinct(), "jaccard-wanted")
    held = cut(semi(rows.drop("f1", "f2", "keys"), wanted, ["row"]), "jaccard-held")
    rows = rows.drop("band", "bits", "keys")
    weight = held.select("row", F.length("bits").cast("bigint").alias("bytes"))
    groups = cut(groups.join(weight, "row"), "jaccard-groups")
    component = docs.sparkSession.createDataFrame([], "id long, component long")
    linked = tried = again = None
    turn = 0
    while True:
        turn += 1
        members = groups
        if turn > 1:
            # A group is open if a pair of it was refused in the last turn, or if it was cut in the first.
            open_ = groups.join(again, "row", "left_semi").select("grp")
            if turn == 2:
                cut_up = groups.groupBy("grp").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("n"))
                open_ = open_.union(cut_up.filter((F.col("n") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).select("grp"))
            groups = members = cut(groups.join(open_.distinct(), "grp", "left_semi"), "jaccard-open")
        members = members.join(component.withColumnRenamed("id", "row"), "row", "left").withColumn(
            "component", F.coalesce("component", F.col("row"))
        )
        if turn > 1:
            mixed = members.groupBy("grp").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
            members = members.join(mixed.filter("c1 <> c2").select("grp"), "grp", "left_semi")
        blocks = cut(_blocks(members, turn == 1), "jaccard-blocks")
        wide = blocks.join(held.drop("id", "content"), "row")
        pairs = cut(_candidates(wide, rule, tried, 1 if turn == 1 else 16), "jaccard-pairs")
        if pairs.isEmpty():
            if turn == 1:  # groups that were cut are still open
                again = pairs.select(F.col("a").alias("row"))
                continue
            break
        judged = cut(_verified(pairs, docs, held, rule), "jaccard-judged")
        good = judged.filter("linked").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
        bad = judged.filter("NOT linked").select("a", "b")
        again = bad.select(F.col("a").alias("row"))
        linked = good if linked is None else linked.unionByName(good)
        tried = bad if tried is None else tried.unionByName(bad)
        if not linked.isEmpty():
            component = cut(components(linked), "jaccard-components")
    return rows, classes, component


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(row, id, content, n_shingles, component_id, component) for every row of ``docs`` (id, content, text).

    component is a number of the group; component_id is the smallest doc_id that links reach, the row's own included. A text
    without words, or null, has no shingles and is alone. Rows that repeat a doc_id count
    as documents of their own; rows without doc_id are linked like others, but never name
    a component that has a doc_id. An empty table gives no rows.
    """
    rows, classes, component = links(docs, rule)
    named = classes.join(component.withColumnRenamed("id", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row")
    )
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(named.join(least, "component").select("f1", "f2", "copies", "component_id", "component"), "jaccard-named")
    slim = rows.select("row", "id", "content", "n", "f1", "f2")
    # Classes above the bound are fewer than SHARE, whatever the input: they may be broadcast.
    bound = max(slim.count() // 10_000, 2_000)
    hot = named.filter(F.col("copies") > bound)
    columns = ["row", "id", "content", F.col("n").alias("n_shingles"), "component_id", "component"]
    with_words = slim.filter("n > 0")
    of_hot = with_words.join(F.broadcast(hot), ["f1", "f2"]).select(*columns)
    others = with_words.join(F.broadcast(hot), ["f1", "f2"], "left_anti")
    of_others = others.join(named.filter(F.col("copies") <= bound), ["f1", "f2"]).select(*columns)
    alone = slim.filter("n = 0").select(
        "row",
        "id",
        "content",
        F.col("n").alias("n_shingles"),
        F.nullif("id", F.lit(NO_ID)).alias("component_id"),
        F.col("row").alias("component"),
    )
    return of_hot.unionByName(of_others).unionByName(alone)


def report(docs: DataFrame, rule: Rule = Rule(3, 90, 100)) -> DataFrame:
    """Three-word shingles linked at nine tenths: doc_id, n_shingles, component_id."""
    found = near_duplicates(keyed(docs.select("doc_id", "text")), rule)
    return found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Columns as in ``docs``.

    Texts without words all stay. Of rows that repeat both doc_id and text, one stays.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    wide = keyed(named, f"_c{columns.index('doc_id')}", f"_c{columns.index('text')}")
    found = cut(near_duplicates(wide.select("id", "content", F.col(f"_c{columns.index('text')}").alias("text")), rule), "jaccard-found")
    order = F.struct((F.col("id") == NO_ID).alias("unnamed"), "id", "row", "content")
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first"))
    kept = first.select("first.id", "first.content").union(found.filter("n_shingles = 0").select("id", "content"))
    repeated = found.filter("n_shingles > 0").groupBy("id", "content").agg(F.count("*").alias("rows")).filter("rows > 1")
    kept = cut(kept.distinct().join(repeated, ["id", "content"], "left"), "jaccard-kept")
    once = semi(wide, kept.filter("rows IS NULL").select("id", "content"), ["id", "content"])
    several = semi(wide, kept.filter("rows > 1").select("id", "content"), ["id", "content"]).dropDuplicates(["id", "content"])
    return once.unionByName(several).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])
