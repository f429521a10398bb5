"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one input partition (about ``SHARD`` bytes), so
nothing is shuffled: each task builds the index of its shards (suffix array by
prefix doubling, wavelet matrix over the Burrows-Wheeler transform, every 32nd text
position sampled), runs all test windows through it by backward search, locates the
occurrences and merges them into removal spans per document.

The test set is a stated query set. It is read in blocks of at most ``BLOCK`` bytes;
each block meets all shards, and the spans of several blocks are united by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t
from kodagraf.runtime import cut

WINDOW = 13
SHARD = 4 << 20
INDEX_WORDS = 1 << 20
BLOCK = 8 << 20
SAMPLE = 32

RESULT = t.struct(
    n_words="long", spans=T.ArrayType(t.struct(start="long", end="long")), items=T.ArrayType(T.StringType())
)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of small positive numbers, by prefix doubling.

    Only suffixes that are still tied are sorted again, with the rank of what follows.
    """
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length())
    take = max(1, min(63 // bits, 4))
    key = np.zeros(n, np.int64)
    for i in range(take):
        key <<= bits
        key[: n - i] |= ids[i:]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[order] = group
    step = take
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        follow = at + step
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        base = rank[at]
        by = (base << 32) | after
        sub = np.argsort(by)
        by = by[sub]
        order[tied] = at[sub]
        fresh = np.empty(len(by), bool)
        fresh[0] = True
        np.not_equal(by[1:], by[:-1], out=fresh[1:])
        first = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = first
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FmIndex:
    """Backward search and location over a sequence of word ids that ends with a single 0."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        order = suffix_array(ids)
        last = ids[order - 1]  # the first suffix is preceded by the final 0
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
        self.levels: list[tuple[int, Bits, int]] = []
        seq = last
        for shift in range(max(1, int(ids.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.places = order[sampled]

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row ``i`` of the transform."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur; words are right-aligned."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = patterns.shape[1]
        for k in range(width):
            ended = lengths[alive] == k
            if ended.any():
                out.append((alive[ended], low[ended], high[ended]))
                alive, low, high = alive[~ended], low[~ended], high[~ended]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - k]
            low, high = (self.starts[symbol] + self._rank(symbol, x) for x in (low, high))
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
        out.append((alive, low, high))
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        place, rest, steps, todo = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            at = self.sampled.get(rest) == 1
            place[todo[at]] = self.places[self.sampled.rank(rest[at])] + steps
            todo, rest = todo[~at], rest[~at]
            start, i, symbol = np.zeros_like(rest), rest, np.zeros_like(rest)
            for shift, bits, zeros in self.levels:
                one = bits.get(i) == 1
                symbol = symbol | np.where(one, 1 << shift, 0)
                a, b = bits.rank(start), bits.rank(i)
                start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            rest, steps = self.starts[symbol] + i - start, steps + 1
        return place


class Windows:
    """The distinct windows of the test items of a block, and which items have them."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        seen: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = t.word_hashes(raw, np.array([0, len(raw)]), t.ALNUM)
            words = h.tolist()
            for i in range(max(1, len(words) - width + 1) if words else 0):
                w = tuple(words[i : i + width])
                k = seen.setdefault(w, len(seen))
                if k == len(owners):
                    owners.append(set())
                if item_id is not None:
                    owners[k].add(item_id)
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.hashes = np.zeros((len(seen), width), np.uint64)
        for w, k in seen.items():
            self.hashes[k, width - len(w) :] = w
        self.names = sorted({x for o in owners for x in o})
        at = {x: i for i, x in enumerate(self.names)}
        self.owners = [np.array(sorted(at[x] for x in o), np.int64) for o in owners]

    def find(self, h: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of all occurrences inside the documents of a shard."""
        if not len(h) or not len(self.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        vocabulary, ids = np.unique(h, return_inverse=True)
        known = np.searchsorted(vocabulary, self.hashes)
        there = vocabulary[np.minimum(known, len(vocabulary) - 1)] == self.hashes
        width = self.hashes.shape[1]
        pad = np.arange(width)[None, :] < width - self.lengths[:, None]
        able = np.flatnonzero((there | pad).all(axis=1))
        if not len(able):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Documents are parted by 1 and the whole ends with 0: word i of document d stands at i + d.
        doc = np.searchsorted(word_at, np.arange(len(h)), "right") - 1
        seq = np.ones(len(h) + len(word_at), np.int64)
        seq[-1] = 0
        seq[np.arange(len(h)) + doc] = ids + 2
        index = FmIndex(seq)
        k, low, high = index.search(known[able] + 2, self.lengths[able])
        many = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        place = index.locate(rows)
        shifted = word_at[:-1] + np.arange(len(word_at) - 1)
        return able[np.repeat(k, many)], place - (np.searchsorted(shifted, place, "right") - 1)


def _shard(windows: Windows, column: pa.Array) -> list[pa.Array]:
    raw, offsets = t.flat(column)
    h, word_at = t.word_hashes(raw, offsets, t.ALNUM)
    width = windows.hashes.shape[1]
    if len(h) <= INDEX_WORDS or len(word_at) > 2:
        window, place = windows.find(h, word_at)
    else:  # one very long document: indexed in blocks that overlap by a window
        parts = []
        for at in range(0, len(h), INDEX_WORDS):
            part = h[at : at + INDEX_WORDS + width - 1]
            w, p = windows.find(part, np.array([0, len(part)]))
            parts.append((w, p + at))
        window, place = (np.concatenate(x) for x in zip(*parts))
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + windows.lengths[window], -1)
    hit = np.concatenate([np.cumsum(change[:-1]) > 0, [False]])
    doc = np.searchsorted(word_at, place, "right") - 1
    seen: dict[int, set[int]] = {}
    for d, w in np.unique(np.stack([doc, window], 1), axis=0).tolist():
        seen.setdefault(d, set()).update(windows.owners[w].tolist())
    spans: list[list[dict[str, int]]] = []
    items: list[list[str]] = []
    for d in range(len(word_at) - 1):
        if d not in seen:
            spans.append([])
            items.append([])
            continue
        a, b = int(word_at[d]), int(word_at[d + 1])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
        spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
        items.append([windows.names[x] for x in sorted(seen[d])])
    columns = (np.diff(word_at), spans, items)
    return [pa.array(x, f.type) for x, f in zip(columns, to_arrow_schema(RESULT))]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """Test items in blocks of at most BLOCK bytes (or one item), read from one hash range each."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = -(-size // (BLOCK // 2))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield [(r["id"], r["text"]) for r in items.filter(part == i).toLocalIterator()]


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """The columns of ``docs`` as _c0, _c1 ... (so no name can clash), n_words, spans, items."""
    spark = docs.sparkSession
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    text = f"_c{docs.columns.index('text')}"

    def run(rows: DataFrame, sent: Broadcast) -> DataFrame:
        schema = T.StructType(rows.schema.fields + RESULT.fields)
        arrow = to_arrow_schema(schema)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value, width)
            for part in t.slices(batches, text, SHARD):
                found = _shard(windows, part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip([*part.columns, *found], arrow)], schema=arrow
                )

        return rows.mapInArrow(search, schema)

    blocks = _blocks(benchmark, id_col, text_col)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return run(named, spark.sparkContext.broadcast(block))  # at most BLOCK bytes
    # One block at a time is on the driver and in the workers; its spans are written before the next is read.
    wide = cut(named.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    parts: list[DataFrame] = []
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        spans = run(wide.select("row", text), sent).drop(text)
        parts.append(cut(spans.filter(F.size("spans") > 0) if parts else spans, "decontam-spans"))
        sent.destroy()
        block, following = following, next(blocks, None)
    found = reduce(DataFrame.unionByName, parts)
    united = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr(
        """aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (done, s) ->
             CASE WHEN size(done) > 0 AND element_at(done, -1).end >= s.start
                  THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                              'end', greatest(element_at(done, -1).end, s.end))))
                  ELSE concat(done, array(s)) END)"""
    )
    return wide.join(united.withColumn("spans", merged), "row").drop("row")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """``docs`` with n_words, removal spans (words from 0, merged), and the items whose windows occur.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item with
    fewer words than ``width`` is one window; one without words never occurs. A null or
    empty text has no words. Repeated rows give repeated rows; an item without id marks
    words but is not listed; items that repeat an id count once. With no items at all,
    every document comes back with no span. Other columns pass through; one that has
    the name of a result gives way to it.
    """
    found = _found(docs, benchmark, id_col, text_col, width)
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULT.names]
    return found.select(*kept, *RESULT.names)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit and the contamination rule: some hit, and at least a twentieth of the words."""
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of :func:`contamination`."""
    listed = F.concat_ws(",", F.array_sort("items"))
    return judged(contamination(docs.select("doc_id", "text"), benchmark)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule does not call contaminated, unchanged."""
    found = judged(_found(docs, benchmark, "item_id", "text", WINDOW)).filter(~F.col("contaminated"))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
