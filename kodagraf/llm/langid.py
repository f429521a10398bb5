"""Language identification by nearest centroid.

A text is a vector of hashed byte n-gram counts (1 to 4 letters, words padded by a space),
damped, weighted by inverse document frequency and brought to length 1. Each language has
several centroids, from spherical k-means over a bounded sample of its labelled texts; the
prediction is the language of the centroid with the greatest cosine. Each centroid also
has a radius, the distance that nearly all of its own sample stays within: a text outside
of the radius of its nearest centroid is marked as rejected.

Document frequencies cover all labelled texts. Only the k-means sample is bounded:
``SAMPLE`` distinct texts per language, those of the smallest text hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from kodagraf.llm import text as t

DIMENSIONS = 4_096
CENTROIDS = 4
SAMPLE = 500
ROUNDS = 12
#: Share of a centroid's own sample that its radius holds, and the factor by which it is widened.
HELD, WIDER = 0.99, 1.15
BATCH = 1 << 20
UNKNOWN = "und"

#: Bytes of letters keep their place, others part words. The second bytes of capital Latin-1 letters become small.
_LETTER = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0x80)
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x80:0x9F] += 0x20
_SMALL[0x97] = 0x97
_MULTIPLIERS = t.constants(4, 41)


def counts(column: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text, one row each."""
    raw, offsets = t.flat(column)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for first in range(0, len(raw), BATCH):  # long texts go piece by piece
        last = min(first + BATCH, len(raw))
        low = t.LOWER[raw[first:last]]
        after_c3 = np.concatenate([[False], low[:-1] == 0xC3])
        low = np.where(after_c3, _SMALL[low], low)
        low = np.where(_LETTER[low], low, np.uint8(32)).astype(np.uint64)
        row = np.searchsorted(offsets, np.arange(first, last), "right") - 1
        h = np.zeros(len(low), np.uint64)
        blank = low == 32
        inner = np.zeros(len(low), bool)  # a blank inside the n-gram, before its last byte
        for n in range(4):
            if n >= len(low):
                break
            size = len(low) - n
            inner = inner[:size] | (blank[n - 1 : n - 1 + size] if n > 1 else False)
            h = h[:size] + (low[n:] + np.uint64(1)) * _MULTIPLIERS[n]
            # One row for all bytes; n-grams of only a blank, with a blank inside, or across rows do not count.
            good = ~inner & (row[:size] == row[n:])
            good &= ~blank[:size] if n == 0 else ~(blank[:size] & blank[n:])
            place = (t.mix(h[good] + np.uint64(n)) >> np.uint64(40)).astype(np.int64) % DIMENSIONS
            base = int(row[0])
            many = int(row[-1]) - base + 1
            found = np.bincount((row[:size][good] - base) * DIMENSIONS + place, minlength=many * DIMENSIONS)
            out[base : base + many] += found.reshape(many, DIMENSIONS)
    return out


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counted) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in t.slices(batches, column, BATCH):
        for at in range(0, part.num_rows, 512):  # bounds the matrix of counts
            yield part.slice(at, 512)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that have each n-gram, and texts in all: one small row per task is combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for part in _parts(batches, "text"):
            df += (counts(part.column(0)) > 0).sum(axis=0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(df, n), pa.int64())], names=["i", "n"]
        )

    rows = labelled.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["i"]] = r["n"]
    return out[:-1], int(out[-1])


def bounds(hashed: DataFrame, size: int) -> DataFrame:
    """(lang, last): the hash at which the distinct hashes of a language, in order, reach ``size``; copies count once."""

    def reached(counts: DataFrame, column: str) -> DataFrame:
        """The value at which the rows of a language, in order, reach ``size``; its last value if they are fewer."""
        before = F.sum("n").over(Window.partitionBy("lang").orderBy(column)) - F.col("n")
        return counts.withColumn("before", before).filter(F.col("before") < size).groupBy("lang").agg(F.max(column).alias("last"))

    # Counts of 65,536 ranges of hashes tell which range holds the bound, so no task meets all rows of a language.
    ranged = hashed.select("lang", "h").distinct().withColumn("range", F.shiftright("h", 48))
    upto = reached(ranged.groupBy("lang", "range").agg(F.count("*").alias("n")), "range")
    near = ranged.join(F.broadcast(upto), "lang").filter(F.col("range") <= F.col("last"))
    return reached(near.select("lang", "h", F.lit(1).alias("n")), "h")


def sample(labelled: DataFrame, size: int) -> DataFrame:
    """``size`` distinct texts per language, or all if they are fewer."""
    last = bounds(labelled.select("lang", F.xxhash64("text").alias("h")), size)
    return (
        labelled.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(last), "lang")  # a row per language: smaller than the model
        .filter("h <= last")
        .dropDuplicates(["lang", "h"])
        .select("lang", "h", "text")
    )


def fit(labelled: DataFrame, sample_size: int = SAMPLE, per_language: int = CENTROIDS) -> Model:
    """Learn from rows (lang, text) without nulls. Each language is fitted in a task of its own."""
    df, n = document_frequencies(labelled)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def centroids(key: tuple[str], group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        v = np.concatenate(
            [vectors(counts(pa.array(group["text"].iloc[i : i + 64].tolist(), pa.large_string())), idf) for i in range(0, len(group), 64)]
        )
        k = min(per_language, len(v))
        chosen = [0]  # far-apart starts
        for _ in range(1, k):
            chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
        c = v[chosen]
        for _ in range(ROUNDS):
            own = (v @ c.T).argmax(axis=1)
            for j in range(k):
                if (own == j).any():
                    c[j] = v[own == j].mean(axis=0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = v @ c.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        radius = [float(np.quantile(1 - best[own == j], HELD)) * WIDER if (own == j).any() else 0.0 for j in range(k)]
        return pd.DataFrame({"lang": key[0], "centroid": list(c), "radius": radius})

    found = (
        sample(labelled, sample_size)
        .groupBy("lang")
        .applyInPandas(centroids, "lang string, centroid array<float>, radius double")
        .collect()  # languages times ``per_language`` vectors
    )
    found.sort(key=lambda r: (r["lang"], list(r["centroid"])))
    langs = sorted({r["lang"] for r in found})
    return Model(
        langs,
        idf,
        np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMENSIONS),
        np.array([langs.index(r["lang"]) for r in found], np.int64),
        np.array([r["radius"] for r in found]),
    )


RESULT = t.struct(lang_pred="string", score="double", rejected="boolean")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    score: the cosine of the nearest centroid, 0 to 1. A null text or one without a letter
    gets ``und`` and score 0; so does every text if nothing was learned. rejected: outside
    of the nearest centroid's radius, or ``und``. Whole texts count. A column that has the
    name of a result gives way to it; rows are independent and repeated rows repeat.
    """
    columns = [c for c in docs.columns if c not in RESULT.names]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    text = f"_c{columns.index('text')}"
    carried = [f for f in named.schema.fields if f.name != text]
    schema = T.StructType(carried + RESULT.fields)
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in _parts(batches, text):
            column = part.column(part.schema.get_field_index(text))
            letters = [has_letter(x) for x in column.to_pylist()]
            lang, score, out = [UNKNOWN] * len(letters), [0.0] * len(letters), [True] * len(letters)
            if len(m.owner) and any(letters):
                near = vectors(counts(column), m.idf) @ m.centroids.T
                best = near.argmax(axis=1)
                for i, b in enumerate(best):
                    if letters[i]:
                        c = min(1.0, max(0.0, float(near[i, b])))
                        lang[i], score[i], out[i] = m.langs[m.owner[b]], c, 1 - c > m.radius[b]
            own = [part.column(part.schema.get_field_index(f.name)) for f in carried]
            made = [pa.array(x, f.type) for x, f in zip((lang, score, out), list(arrow)[len(own) :])]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow)), *made], schema=arrow)

    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c != "text"], *RESULT.names)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a missing id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(-1))


def report(docs: DataFrame) -> DataFrame:
    """Learn on two folds of three, predict all: doc_id, held_out, lang_pred, score, rejected."""
    rows = docs.select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 3) == 1
    model = fit(rows.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))
    return predict(rows.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected"
    )
