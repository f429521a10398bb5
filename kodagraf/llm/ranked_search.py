"""Ranked lexical search: the best documents of every item, by norm buckets.

Both sides are vectors over the terms of the items. A document's coordinate of term t is
its impact ``w(t) * (1000000000 * tf div (1000 * tf + 20 * m))``, an item's is 1, and the
score is their product. Documents are ordered by the length of their vectors and cut into
buckets. By Cauchy-Schwarz no score of a bucket exceeds the item's length times the
bucket's greatest length, so most buckets are settled without a look inside. Inside a
bucket the greatest value of each coordinate bounds the scores again; an item's
heaviest coordinates are then summed for all its documents, and what the other
coordinates can still add is bounded by the rest of the document's length. Documents that
may still be among the best are scored exactly, in integers.

The threshold an item starts with is the worst of the best scores among the longest
vectors; every task raises it by what it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t
from kodagraf.runtime import cut, drop_cut

BEST = 50
#: Items are handled in blocks of so many bytes, or one item; what is sent to the tasks follows it.
BLOCK = 4 << 20
#: Bytes of text that a task looks at together.
SLICE = 4 << 20
#: Documents and coordinates of a bucket, at most (or one document).
BUCKET, COORDINATES = 2048, 1 << 20
#: The longest vectors, whose scores give the first thresholds.
SEEDS = 4096
#: Room for rounding in the bounds, which are floating-point numbers.
SLACK = 1 + 1e-9

COUNTS = t.struct(doc="long", n="long", ids=T.ArrayType(T.IntegerType()), tfs=T.ArrayType(T.LongType()))
VECTORS = t.struct(doc="long", norm="double", ids=T.ArrayType(T.IntegerType()), x=T.ArrayType(T.LongType()))
FOUND = t.struct(item="int", doc="long", score="long")


class Items:
    """The items of a block as sets of term numbers, one after another."""

    def __init__(self, texts: list[str | None]):
        sets = [np.unique(t.word_hashes(raw, np.array([0, len(raw)]), t.ALNUM)[0]) for raw in (np.frombuffer((x or "").encode(), np.uint8) for x in texts)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        self.terms = np.searchsorted(self.vocabulary, np.concatenate([np.zeros(0, np.uint64), *sets]))
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


def _counts(vocabulary: np.ndarray, column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of terms, and which terms of the vocabulary how often, of each text."""
    raw, offsets = t.flat(column)
    h, word_at = t.word_hashes(raw, offsets, t.ALNUM)
    at = np.searchsorted(vocabulary, h)
    known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
    doc = np.searchsorted(word_at, known, "right") - 1
    key, tfs = np.unique(doc * len(vocabulary) + at[known], return_counts=True)
    starts = np.searchsorted(key, np.arange(len(word_at)) * len(vocabulary))
    return np.diff(word_at), _lists(starts, key % max(len(vocabulary), 1), pa.int32()), _lists(starts, tfs, pa.int64())


def _vectors(counts: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The impacts above 0 and the length of each document's vector."""
    starts, ids = _flat(counts.column("ids"))
    tf = _flat(counts.column("tfs"))[1]
    m = 100 - 50 + (50 * counts.column("n").to_numpy() * n_docs) // n_terms
    row = np.repeat(np.arange(len(m)), np.diff(starts))
    x = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    keep = x > 0
    ids, x, row = ids[keep], x[keep], row[keep]
    norm = np.sqrt(np.bincount(row, x.astype(float) ** 2, len(m)))
    starts = np.searchsorted(row, np.arange(len(m) + 1))
    columns = [counts.column("doc"), pa.array(norm), _lists(starts, ids, pa.int32()), _lists(starts, x, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(VECTORS))


class Best:
    """The best documents of each item so far, and the score that another one must reach."""

    def __init__(self, items: Items, floor: np.ndarray, best: int):
        self.items, self.best = items, best
        self.floor = np.maximum(floor, 1)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)

    def add(self, q: int, docs: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        docs, scores = np.append(self.held[q][0], docs[keep]), np.append(self.held[q][1], scores[keep])
        order = np.lexsort((docs, -scores))[: self.best]
        self.held[q] = docs[order], scores[order]
        if len(order) == self.best:
            self.floor[q] = scores[order[-1]]

    def bucket(self, docs: np.ndarray, norms: np.ndarray, starts: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """A bucket of documents in descending order of their lengths."""
        sizes = np.diff(self.items.starts)
        able = np.sqrt(sizes) * norms[0] * SLACK >= self.floor
        if not able.any() or not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        row = np.repeat(np.arange(len(docs)), np.diff(starts))[order]
        x = x[order]
        coordinates, first = np.unique(ids[order], return_index=True)
        most = np.maximum.reduceat(x, first)
        last = np.append(first[1:], len(x))
        at = np.minimum(np.searchsorted(coordinates, self.items.terms), len(coordinates) - 1)
        there = coordinates[at] == self.items.terms
        bound = np.concatenate([[0], np.cumsum(np.where(there, most[at], 0))])
        able &= bound[self.items.starts[1:]] - bound[self.items.starts[:-1]] >= self.floor
        for q in np.flatnonzero(able):
            mine = slice(self.items.starts[q], self.items.starts[q + 1])
            own = at[mine][there[mine]]
            own = own[np.argsort(-most[own], kind="stable")]
            focus = max(4, len(own) // 4)
            score, squares = np.zeros(len(docs), np.int64), np.zeros(len(docs))
            for c in own[:focus]:
                r, v = row[first[c] : last[c]], x[first[c] : last[c]]
                score[r] += v
                squares[r] += v.astype(float) ** 2
            rest = own[focus:]
            left = np.sqrt(np.maximum(norms**2 * SLACK - squares, 0) * len(rest)) * SLACK
            able_docs = np.flatnonzero(score + np.minimum(left + 1, float(most[rest].sum())) >= self.floor[q])
            if len(able_docs):
                for c in rest:
                    score[row[first[c] : last[c]]] += x[first[c] : last[c]]
                self.add(q, docs[able_docs], score[able_docs])

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(np.arange(len(self.items)), [len(d) for d, _ in self.held])
        docs, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.held))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(docs), pa.array(scores)], schema=to_arrow_schema(FOUND))


def _buckets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    offsets = batch.column("ids").offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + COORDINATES, "right")) - 1
        end = min(max(end, at + 1), at + BUCKET, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _searched(vectors: DataFrame, items: Items, floor: np.ndarray, best: int) -> DataFrame:
    """Each task's best documents of each item; rows in descending order of length prune most."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, floor))  # follows BLOCK

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(*sent.value, best)
        for batch in batches:
            for part in _buckets(batch):
                starts, ids = _flat(part.column("ids"))
                docs, norms = part.column("doc").to_numpy(), part.column("norm").to_numpy()
                order = np.argsort(-norms, kind="stable")
                if (order[:-1] > order[1:]).any():  # rows of the first search come in any order
                    part = part.take(pa.array(order))
                    starts, ids = _flat(part.column("ids"))
                    docs, norms = docs[order], norms[order]
                found.bucket(docs, norms, starts, ids, _flat(part.column("x"))[1])
        if len(found.items):
            yield found.rows()

    return vectors.mapInArrow(search, FOUND)


def _top(found: DataFrame, best: int) -> DataFrame:
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= best)


def _block(docs: DataFrame, texts: list[str | None], best: int) -> DataFrame | None:
    """(item, doc, score, rank) of a block's items; None if no document has a term."""
    spark = docs.sparkSession
    items = Items(texts)
    sent = spark.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text", SLICE):
            columns = [part.column("doc"), *_counts(sent.value, part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(COUNTS))

    counts = cut(docs.mapInArrow(count, COUNTS), "ranked-counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    weights = np.zeros(len(items.vocabulary), np.int64)
    for i, df in counts.select(F.explode("ids").alias("id")).groupBy("id").count().toLocalIterator():  # the block's terms
        weights[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    weighted = spark.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _vectors(batch, weighted.value, n_docs, n_terms)

    vectors = cut(counts.mapInArrow(weigh, VECTORS).filter("norm > 0"), "ranked-vectors")
    drop_cut(counts)
    longest = vectors.select("norm").orderBy(F.desc("norm")).limit(SEEDS).agg(F.min("norm")).first()[0]
    floor = np.zeros(len(items), np.int64)
    if longest is None:
        return None
    seeds = _top(_searched(vectors.filter(F.col("norm") >= longest), items, floor, best), best)
    for q, score in seeds.filter(F.col("rank") == best).select("item", "score").toLocalIterator():
        floor[q] = score
    # Cauchy-Schwarz for whole rows, so that the scan skips what no item can want.
    sizes = np.diff(items.starts)
    least = float((floor[sizes > 0] / np.sqrt(sizes[sizes > 0])).min()) / SLACK if (sizes > 0).any() else 0.0
    by_norm = vectors.filter(F.col("norm") >= least).repartitionByRange(F.desc("norm"), "doc").sortWithinPartitions(F.desc("norm"))
    return _top(_searched(by_norm, items, floor, best), best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII of the whole text, A-Z in
    lower case. A null or empty text, long or short, has the terms it has: none. Each row of ``docs``
    counts as a document, also repeated ones; equal scores stand in the order of ``doc_id``
    (a whole number), a missing one last. Rows of ``items`` that agree in id and text count once; rows that
    share only the id are ranked each for itself. Without documents or items there are no rows.
    Other columns are not looked at. Numbers are 64-bit integers but for the logarithm.
    """
    spark = docs.sparkSession
    last = (1 << 63) - 1
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc"), "text")
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    key = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", key)])
    size = asked.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n_blocks = -(-size // (BLOCK // 2))
    out = []
    for i in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == i).collect()  # about BLOCK / 2 bytes
        found = _block(named, [r["text"] for r in block], best) if block else None
        if found is not None:
            ids = spark.createDataFrame([(q, r["id"]) for q, r in enumerate(block)], schema)
            doc = F.when(F.col("doc") != last, F.col("doc")).cast(docs.schema["doc_id"].dataType)
            out.append(found.join(F.broadcast(ids), "item").select("item_id", "rank", doc.alias("doc_id"), "score"))
    if not out:
        return asked.limit(0).select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, out)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(docs, benchmark)


SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))))::BIGINT AS score
       FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
WHERE rank <= 50
"""
