"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lowers the text, maps look-alike letters of other scripts and full-width letters
to Latin ones, and reads digits and signs inside words as the letters they stand for.
Entries are whole words and beginnings of words (3 to 5 letters), with log-odds weights
from a bounded sample of labelled texts; per word the heaviest matching entry counts.
Matches within an exception phrase do not count; phrases are given, or learned where
entries occur in clean labelled texts. The sum of weights, alone and normalised by
length, goes through a logistic curve fitted on the other half of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t
from kodagraf.llm.langid import bounds, fold, sample
from kodagraf.runtime import cut, drop_cut

#: Labelled texts per label that the model is fitted on, at most.
SAMPLE = 3_000
ENTRIES = 2_000
PREFIXES = (3, 4, 5)
#: An entry is held by so many toxic sample texts at least, and is so many times likelier in them.
SUPPORT, LIKELIER = 4, 20.0
THRESHOLD = 0.3
BATCH = 2 << 20

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKE = dict(
    zip("аеорсухіѕјԁһвкмнтԛԝӏαεικνορτυχɡıƚɩոսօ", "aeopcyxisjdhbkmhtqwlaeikvoptuxgililnuo")
)
DIGITS = dict(zip("013457@$", "oieastas"))

_FOLD = {ord(a): b for a, b in LOOK_ALIKE.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
_SPLIT = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W_@$]*[0-9@$][\w@$]*")
_DIGITS = str.maketrans(DIGITS)


def _letters(m: re.Match[str]) -> str:
    word = m.group()
    bare = word.rstrip("$@0123456789")
    if not any(c.isalpha() for c in bare):
        return word
    return bare.translate(_DIGITS)


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if any(c in text for c in "013457@$"):
        text = _MIXED.sub(_letters, text)
    return _SPLIT.findall(text)


@dataclass
class Lexicon:
    """Weights of words (``" word "``) and beginnings (``" begi"``), and phrases that excuse what lies in them."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = f" {' '.join(folded(phrase))} "
            if entry.strip():
                found.add_word(entry, (len(entry), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matched(automaton: ahocorasick.Automaton | None, words: list[str]) -> dict[int, float]:
    """Start of each matched word in the joined text -> weight of its heaviest entry."""
    hits: dict[int, float] = {}
    if automaton is None or not words:
        return hits
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    for a, b in excused:
        for s in [s for s in hits if a <= s < b]:
            del hits[s]
    return hits


def entries(words: Iterable[str]) -> set[str]:
    distinct = set(words)
    return {f" {w} " for w in distinct} | {f" {w[:k]}" for w in distinct for k in PREFIXES if len(w) > k}


def learn_lexicon(labelled: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    """Log-odds of entries over rows (text, toxic); counted per task, combined by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for part in t.slices(batches, "text", BATCH):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found[int(toxic)].update(entries(folded(text)))
            if len(found[0]) + len(found[1]) > 1_000_000:
                yield batch(found)
                found = (Counter(), Counter())
        yield batch(found)

    def batch(found: tuple[Counter[str], Counter[str]]) -> pa.RecordBatch:
        names = list(found[0].keys() | found[1].keys())
        clean, toxic = ([c[x] for x in names] for c in found)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["entry", "t", "c"]
        )

    odds = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
    best = (
        labelled.select("text", "toxic")
        .mapInArrow(run, "entry string, t long, c long")
        .groupBy("entry")
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .filter(F.col("t") >= SUPPORT)
        .withColumn("weight", odds)
        .filter(F.col("weight") >= math.log(LIKELIER))
        .orderBy(F.desc(F.col("weight") * F.col("t")), "entry")
        .limit(ENTRIES)  # the size of the model
    )
    return Lexicon({r["entry"]: r["weight"] for r in best.collect()})


def learn_exceptions(labelled: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around matches that two clean texts have and no toxic one."""
    sent = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for part in t.slices(batches, "text", BATCH):
            out: list[tuple[str, int]] = []
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = folded(text)
                at, places = 0, {}
                for i, w in enumerate(words):
                    places[at] = i
                    at += len(w) + 1
                around = set()
                for s in matched(automaton, words):
                    i = places[s]
                    around |= {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}
                out += [(p, int(toxic)) for p in around if " " in p]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], names=["phrase", "toxic"]
            )

    found = (
        labelled.select("text", "toxic")
        .mapInArrow(run, "phrase string, toxic long")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .filter("t = 0 AND n >= 2")
        .orderBy(F.desc("n"), "phrase")
        .limit(ENTRIES)
    )
    return [r["phrase"] for r in found.collect()]


@dataclass
class Model:
    lexicon: Lexicon
    curve: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.curve, -30, 30)))


def _design(features: np.ndarray) -> np.ndarray:
    """features: (sum of weights, words). The sum alone, and per hundred words."""
    total, words = features[:, 0], np.maximum(features[:, 1], 1)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / words)], 1)


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge; classes count alike."""
    if not len(toxic) or toxic.min() == toxic.max():
        return np.array([-2.0, 1.0, 0.0])
    x, y = _design(features), toxic.astype(float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge @ w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, gradient)
    return w


RESULT = t.struct(score="double", predicted="int", weight="double", n_matches="long")


def _features(automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int, int]:
    words = folded(text)
    hits = matched(automaton, words)
    return sum(hits.values()), len(words), len(hits)


def fit(labelled: DataFrame, exceptions: Iterable[str] = (), sample_size: int = SAMPLE) -> Model:
    """Learn from rows (text, toxic 0/1) without nulls, at most ``sample_size`` per label."""
    return fit_sample(sample(labelled.select(F.col("toxic").cast("string").alias("lang"), "text"), sample_size), exceptions)


def fit_sample(chosen: DataFrame, exceptions: Iterable[str] = ()) -> Model:
    """Learn from the rows (lang, h, text) of a bounded sample, where lang is the label; written once, read several times."""
    written = cut(chosen, "toxicity-sample")
    rows = written.select("text", F.col("lang").cast("int").alias("toxic"), (F.col("h") % 2 == 0).alias("first"))
    n = {(r["first"], r["toxic"]): r["count"] for r in rows.groupBy("first", "toxic").count().collect()}
    first = rows.filter("first")
    lexicon = learn_lexicon(first, n.get((True, 1), 0), n.get((True, 0), 0))
    lexicon.exceptions = [*exceptions, *learn_exceptions(first, lexicon)]
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for part in t.slices(batches, "text", BATCH):
            got = [_features(automaton, x) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), part.column(1)],
                names=["total", "words", "toxic"],
            )

    rest = rows.filter("NOT first").select("text", "toxic").mapInArrow(run, "total double, words long, toxic int").collect()
    drop_cut(written)
    rest.sort()
    features = np.array([[r["total"], r["words"]] for r in rest], float).reshape(len(rest), 2)
    return Model(lexicon, fit_curve(features, np.array([r["toxic"] for r in rest])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without text, with score (0 to 1), predicted (score >= 0.3), weight and n_matches.

    A null or empty text has no match and the score of such texts. Whole texts count.
    A column that has the name of a result gives way to it; repeated rows repeat.
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
        automaton = m.lexicon.automaton()
        for part in t.slices(batches, text, BATCH):
            got = [_features(automaton, x) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            s = m.score(np.array([g[:2] for g in got], float))
            made = [s, (s >= THRESHOLD).astype(np.int32), [g[0] for g in got], [g[2] for g in got]]
            own = [part.column(part.schema.get_field_index(f.name)) for f in carried]
            yield pa.RecordBatch.from_arrays(
                [*(c.cast(f.type) for c, f in zip(own, arrow)), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(own) :]))],
                schema=arrow,
            )

    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c != "text"], *RESULT.names)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn on three folds of four, score all: doc_id, held_out, score, predicted, n_matches."""
    rows = docs.select("doc_id", "text")
    held = fold(F.col("doc_id"), 4) == 2
    known = labels.filter("toxic IS NOT NULL").select("doc_id", "toxic")
    # Labels meet hashes, not texts; at most SAMPLE distinct hashes per label then fetch their texts.
    own = rows.filter(~held & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    keys = own.select("doc_id", "h").join(known, "doc_id").select(F.col("toxic").cast("string").alias("lang"), "h")
    keys = cut(keys, "toxicity-keys")
    last = bounds(keys, SAMPLE)
    wanted = cut(keys.join(F.broadcast(last), "lang").filter("h <= last").select("lang", "h").distinct(), "toxicity-wanted")
    model = fit_sample(own.join(F.broadcast(wanted), "h").dropDuplicates(["lang", "h"]).select("lang", "h", "text"))
    for spent in (keys, wanted):
        drop_cut(spent)
    return score(rows, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_matches")
