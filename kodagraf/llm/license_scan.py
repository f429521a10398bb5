"""Fuzzy search for short license notices.

A notice that may differ by ``k`` edits is cut into ``k + 1`` pieces: one of them stands in
every occurrence unchanged. One Aho-Corasick pass over a text's words finds all pieces of
all notices, each names a stretch of text, and the ``regex`` library looks for the notice
there with its bounded-error matching and reports span and edits. Notices too short to
bear an edit are searched exactly, by the same pass.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t

BATCH = 2 << 20
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int


#: The phrases of the report come first; further notices are the method's own.
BASE = [
    Notice("cc by", "cc-by", 0),
    Notice("general public license", "gpl", 2),
    Notice("all rights reserved", "reserved", 2),
]
NOTICES = [
    *BASE,
    Notice("licensed under the apache license", "apache", 3),
    Notice("the mit license", "mit", 1),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("released into the public domain", "public-domain", 3),
]


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase in ``edits + 1`` parts of nearly equal length, with their offsets."""
    bounds = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


class Scanner:
    """Finds all notices in a text: (notice, first word, words, first character, characters, edits)."""

    def __init__(self, notices: list[Notice]):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for offset, piece in pieces(n.phrase, n.edits) if n.edits else [(-1, f" {n.phrase} ")]:
                at.setdefault(piece, []).append((k, offset))
        for piece, where in at.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.fuzzy = [
            regex.compile(f"(?b)(?: {regex.escape(n.phrase)} ){{e<={n.edits}}}") if n.edits else None for n in notices
        ]

    def scan(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(notice, first word, end word, edits), in order; places of one notice do not overlap."""
        if not words:
            return []
        joined = f" {' '.join(words)} "
        seeded: dict[int, set[int]] = {}  # where each seed puts the blank before its notice
        for end, (size, where) in self.seeds.iter(joined):
            for k, offset in where:
                seeded.setdefault(k, set()).add(end - size - offset)
        if not seeded:
            return []
        starts = np.cumsum([1] + [len(w) + 1 for w in words])
        found: list[tuple[int, int, int, int]] = []
        for k, blanks in seeded.items():
            n = self.notices[k]
            exact, size = f" {n.phrase} ", len(n.phrase)
            covered = bytearray(len(joined) if n.edits else 0)

            def take(s: int, e: int, edits: int) -> None:
                first = int(np.searchsorted(starts, s + (joined[s : s + 1] == " "), "right")) - 1
                last = int(np.searchsorted(starts, max(s + 1, e - (joined[e - 1 : e] == " ")), "left"))
                found.append((k, first, last, edits))
                if n.edits:
                    a, b = int(starts[first]), int(starts[last]) - 1  # whole words, without the blanks around them
                    covered[a:b] = b"\x01" * (b - a)

            for at in blanks:
                if at >= 0 and joined.startswith(exact, at):
                    take(at + 1, at + 1 + size, 0)
            if n.edits:
                self._near(k, joined, blanks, covered, take)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _near(self, k: int, joined: str, blanks: set[int], covered: bytearray, take: Callable[[int, int, int], None]) -> None:
        """Near places around seeds, closest first, in the words that no place covers yet.

        Every place lies whole in the stretch of one of its seeds, so each stretch is searched by itself. When a
        closer place takes a part of a stretch, what is left of it is searched again.
        """
        n = self.notices[k]
        size = len(n.phrase) + 2
        best: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            while (a := covered.find(0, a, b)) >= 0:
                to = covered.find(1, a, b)
                to = b if to < 0 else to
                if to - a >= size - n.edits and (m := self.fuzzy[k].search(joined, a, to)):
                    heapq.heappush(best, (sum(m.fuzzy_counts), m.start(), m.end(), a, to))
                a = to

        for at in blanks:
            search(max(0, at - n.edits), min(len(joined), at + size + n.edits))
        while best:
            edits, s, e, a, b = heapq.heappop(best)
            if covered.find(1, s, e) < 0:  # else a near place at an exact or closer one is the same notice
                take(s, e, edits)
            search(a, b)


RESULT = t.struct(
    n_words="long",
    places=T.ArrayType(t.struct(label="string", phrase="string", first_word="long", end_word="long", edits="int")),
)


def scan(docs: DataFrame, notices: list[Notice] | None = None) -> DataFrame:
    """``docs`` without text, with n_words and the places of all notices.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; places are counted in
    words from 0. Exact places may overlap; a near place gives way to one with fewer edits
    of the same notice. A null or empty text has no words. Repeated rows repeat.
    """
    notices = NOTICES if notices is None else notices
    columns = [c for c in docs.columns if c not in RESULT.names]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    text = f"_c{columns.index('text')}"
    carried = [f for f in named.schema.fields if f.name != text]
    schema = T.StructType(carried + RESULT.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for part in t.slices(batches, text, BATCH):
            sizes, places = [], []
            for x in part.column(part.schema.get_field_index(text)).to_pylist():
                words = _WORD.findall(x.translate(_UPPER)) if x else []
                sizes.append(len(words))
                places.append(
                    [
                        {"label": notices[k].label, "phrase": notices[k].phrase, "first_word": a, "end_word": b, "edits": e}
                        for k, a, b, e in scanner.scan(words)
                    ]
                )
            own = [part.column(part.schema.get_field_index(f.name)) for f in carried]
            made = [pa.array(x, f.type) for x, f in zip((sizes, places), list(arrow)[len(own) :])]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow)), *made], schema=arrow)

    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c != "text"], *RESULT.names)


def report(docs: DataFrame) -> DataFrame:
    """Places of the base phrases, all labels, and a score: certainty of the best place (1 for an exact one)."""
    found = scan(docs.select("doc_id", "text"))
    base = F.array(*[F.lit(n.phrase) for n in BASE])
    exact = F.filter("places", lambda p: (p["edits"] == 0) & F.array_contains(base, p["phrase"]))
    by = {n.phrase: max(len(n.phrase), 1) for n in NOTICES}
    length = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.lit(v))])
    sure = F.transform("places", lambda p: 1 - p["edits"] / F.element_at(length, p["phrase"]))

    def joined(places: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))

    return found.withColumn("exact", exact).select(
        "doc_id",
        "n_words",
        F.size("exact").cast("bigint").alias("n_base"),
        F.array_min(F.transform("exact", lambda p: p["first_word"])).alias("first_word"),
        F.array_max(F.transform("exact", lambda p: p["first_word"])).alias("last_word"),
        joined(F.col("exact")).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).cast("double").alias("score"),
    )
