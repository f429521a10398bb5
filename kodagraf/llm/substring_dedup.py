"""Passages that repeat anywhere in the corpus, by repeated-phrase automata.

A window (35 words) that starts at two places holds the same phrase (12 words) at both:
of the phrases in it, the one of the least hash, the leftmost of equal ones. So only these
phrases, about one word in twelve, are counted. For each, the run of windows that chose
it is a block; if a recurring phrase has the same block everywhere, all its windows recur,
else its windows are counted themselves. That confirms recurring passages without
sending every window through a shuffle.

Documents are dealt to shards. A shard gets the recurring phrases that its documents hold, compiles
them into an Aho-Corasick automaton over word codes and streams its documents through
it. Every place found is checked by full hashes before its windows are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t
from kodagraf.runtime import cut, drop_cut

WINDOW = 35
PHRASE = 12
#: Bytes of text in a shard, on average; of text that a task looks at together; words of a piece of a long text.
SHARD, SLICE, PIECE_WORDS = 16 << 20, 4 << 20, 1 << 21
#: Kinds of rows. In: what a shard must know first, then its documents. Out: finished documents and the rest.
KNOWN, CONFIRMED, DOCUMENT = 0, 1, 2
DONE, PATTERN, COUNTED, OPEN = 0, 1, 2, 3

PHRASES = t.struct(shard="int", a="long", b="long")
SPANS = T.ArrayType(t.struct(start="long", end="long"))
RESULT = t.struct(n_words="long", spans=SPANS, kept="string")
FIRST = t.struct(shard="int", kind="int", a="long", mixed="boolean", w="long", n="long", phrase="string")

_G = np.uint64(0xD1342543DE82EF95)
_G_INVERSE = np.uint64(pow(int(_G), -1, 1 << 64))
_BY_PLACE = t.constants(PHRASE, 41)

Finish = Callable[[list[bytes], np.ndarray | None], str]


def joined(words: list[bytes], keep: np.ndarray | None) -> str:
    """The kept words, joined by one space; ``keep`` is None where all stay."""
    return b" ".join(words if keep is None else compress(words, keep.tolist())).decode()


def digest(words: list[bytes], keep: np.ndarray | None) -> str:
    return hashlib.sha256(joined(words, keep).encode()).hexdigest()


class Runs:
    """Runs of windows that choose the same phrase, in the words ``h`` of some texts.

    Run r has the windows that start at ``low[r]`` to ``high[r]``; its phrase starts at
    ``place[r]`` and has the hash ``a[r]``.
    """

    def __init__(self, h: np.ndarray, word_at: np.ndarray, width: int = WINDOW):
        self.h, self.width = h, width
        n = len(h)
        self._sums: tuple[np.ndarray, np.ndarray] | None = None
        self.low = self.high = self.place = np.zeros(0, np.int64)
        self.a = np.zeros(0, np.uint64)
        if n < width:
            return
        g = np.zeros(n - PHRASE + 1, np.uint64)
        for i in range(PHRASE):
            g += h[i : n - PHRASE + 1 + i] * _BY_PLACE[i]
        g = t.mix(g)
        many = width - PHRASE + 1
        least, have = np.arange(len(g)), 1
        while have < many:  # the least of twice as many phrases; the left one of equals
            step = min(have, many - have)
            left, right = least[:-step], least[step:]
            least, have = np.where(g[right] < g[left], right, left), have + step
        ends = word_at[1:]
        room = np.maximum(np.diff(word_at) - width + 1, 0)
        start = np.repeat(word_at[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        if not len(start):
            return
        place = least[start]
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(start) != 1)))
        self.low, self.high = start[new], start[np.append(new[1:], len(start)) - 1]
        self.place, self.a = place[new], g[place[new]]
        self.doc = np.searchsorted(ends, self.low, "right")

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` up to ``end``, wherever they stand."""
        if self._sums is None:
            n = len(self.h)
            up = np.cumprod(np.append(np.uint64(1), np.full(n, _G)))
            self._sums = np.append(np.uint64(0), np.cumsum(self.h * up[:n])), np.cumprod(np.append(np.uint64(1), np.full(n, _G_INVERSE)))
        sums, down = self._sums
        return t.mix((sums[end] - sums[start]) * down[start])

    def blocks(self) -> np.ndarray:
        """A hash of each run's words and of the phrase's place in them."""
        size = ((self.place - self.low) << 8 | (self.high - self.low)).astype(np.uint64)
        return t.mix(self._hash(self.low, self.high + self.width) ^ t.mix(size + np.uint64(1)))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, first word and hash of each window of some runs."""
        many = self.high[runs] - self.low[runs] + 1
        run = np.repeat(runs, many)
        start = np.repeat(self.low[runs] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return run, start, self._hash(start, start + self.width)


def _pieces(h: np.ndarray, word_at: np.ndarray, width: int) -> Iterator[tuple[int, Runs]]:
    """(first word, runs): all texts at once, or pieces of one long text that share no window."""
    if len(word_at) > 2 or len(h) <= PIECE_WORDS:
        yield 0, Runs(h, word_at, width)
        return
    for at in range(0, len(h), PIECE_WORDS):
        part = h[at : at + PIECE_WORDS + width - 1]
        yield at, Runs(part, np.array([0, len(part)]), width)


def _codes(h: np.ndarray) -> str:
    """One character for each word; other words may share it, so matches are checked."""
    c = (h % np.uint64(0x10F7FF)).astype(np.uint32) + np.uint32(1)
    c[c >= 0xD800] += np.uint32(0x800)
    return c.tobytes().decode("utf-32-le")


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _words(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    return t.word_hashes(*t.flat(part.column(part.schema.get_field_index(text))), t.NOT_SPACE, t.AS_IS)


def _by_shard(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) in the order of the rows; documents in slices of bounded text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(shard) | np.diff(kind)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(at, end - at)
            for rows in t.slices(iter([part]), text, SLICE) if kind[at] == DOCUMENT else [part]:
                yield int(shard[at]), int(kind[at]), rows


def _rows(schema: pa.Schema, size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """A batch with the given columns, nulls in all others."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def _constant(value: int, n: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int32))


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]


def _finished(texts: pa.Array, word_at: np.ndarray, gone: np.ndarray, finish: Finish) -> dict[str, pa.Array]:
    spans, kept = [], []
    for i, text in enumerate(texts):
        mine = gone[word_at[i] : word_at[i + 1]]
        words = (text.as_py() or "").encode().split()  # bytes: only [\x20\x09-\x0D] parts words
        spans.append(_spans(mine) if mine.any() else [])
        kept.append(finish(words, ~mine if mine.any() else None))
    kinds = dict(zip(RESULT.names, to_arrow_schema(RESULT).types))
    return {"n_words": pa.array(np.diff(word_at)), "spans": pa.array(spans, kinds["spans"]), "kept": pa.array(kept, kinds["kept"])}


def _known(parts: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """Columns of all parts, in the order of the first."""
    columns = [np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0) for c in names]
    columns[0] = columns[0].astype(np.int64).view(np.uint64)
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _member(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are known, and where (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _first_pass(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema, width: int, finish: Finish) -> Iterator[pa.RecordBatch]:
    """Finishes documents without a recurring phrase; for others gives patterns and the windows to count."""
    own, parts, told = -1, [], set()
    for shard, kind, rows in _by_shard(batches, text):
        if shard != own:
            own, parts, told, known = shard, [], set(), None
        if kind == KNOWN:
            parts.append(rows)
            continue
        if known is None:
            known, mixed = _known(parts, "a", "mixed")
            mixed = mixed.astype(bool)
        h, word_at = _words(rows, text)
        open_docs = np.zeros(rows.num_rows, bool)
        for first, runs in _pieces(h, word_at, width):
            there, at = _member(runs.a, known)
            if not there.any():
                continue
            open_docs[runs.doc[there]] = True
            unsure = np.flatnonzero(there)[mixed[at[there]]]
            if len(unsure):
                run, _, w = runs.windows(unsure)
                pairs, n = np.unique(np.stack([runs.a[run], w], 1), axis=0, return_counts=True)
                yield _rows(schema, len(n), shard=_constant(shard, len(n)), kind=_constant(COUNTED, len(n)), a=_longs(pairs[:, 0].copy()), w=_longs(pairs[:, 1].copy()), n=pa.array(n))
            fresh = {int(x): r for r, x in zip(np.flatnonzero(there).tolist(), runs.a[there].tolist()) if x not in told}
            told.update(fresh)
            if fresh:
                at_run = np.array(list(fresh.values()))
                phrases = [_codes(runs.h[p : p + PHRASE]) for p in runs.place[at_run].tolist()]
                yield _rows(
                    schema, len(phrases), shard=_constant(shard, len(phrases)), kind=_constant(PATTERN, len(phrases)),
                    a=_longs(runs.a[at_run]), mixed=pa.array(mixed[at[at_run]]), phrase=pa.array(phrases),
                )
        for kind_out, which in ((OPEN, np.flatnonzero(open_docs)), (DONE, np.flatnonzero(~open_docs))):
            if not len(which):
                continue
            part = rows.take(pa.array(which)) if len(which) < rows.num_rows else rows
            columns = {c: part.column(c) for c in part.schema.names if c.startswith("_c")}
            if kind_out == DONE:
                texts = columns.pop(text)
                sizes = np.append(0, np.cumsum(np.diff(word_at)[which]))
                columns |= _finished(texts, sizes, np.zeros(sizes[-1], bool), finish)
            yield _rows(schema, part.num_rows, shard=_constant(shard, part.num_rows), kind=_constant(kind_out, part.num_rows), **columns)


def _second_pass(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema, width: int, finish: Finish) -> Iterator[pa.RecordBatch]:
    """Compiles a shard's phrases, streams its documents and marks every window that recurs."""
    own, patterns, confirmed, automaton = -1, [], [], None
    for shard, kind, rows in _by_shard(batches, text):
        if shard != own:
            own, patterns, confirmed, automaton = shard, [], [], None
        if kind != DOCUMENT:
            (patterns if kind == KNOWN else confirmed).append(rows)
            continue
        if automaton is None:
            known, mixed = _known(patterns, "a", "mixed")
            windows, window_a = _known(confirmed, "w", "a")
            window_a = window_a.astype(np.int64).view(np.uint64)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in patterns:
                for phrase in p.column("phrase").to_pylist():
                    automaton.add_word(phrase)
            patterns = []
            automaton.make_automaton()
        h, word_at = _words(rows, text)
        change = np.zeros(len(h) + 1, np.int32)
        for first, runs in _pieces(h, word_at, width):
            if not len(automaton) or not len(runs.a):
                continue
            ends = np.fromiter((end for end, _ in automaton.iter(_codes(runs.h))), np.int64)
            run = np.unique(np.searchsorted(runs.place, ends - PHRASE + 1))
            run = run[run < len(runs.a)]
            found = np.zeros(len(runs.h), bool)
            found[ends - PHRASE + 1] = True
            run = run[found[runs.place[run]]]
            there, at = _member(runs.a[run], known)
            run, unsure = run[there], mixed[at[there]].astype(bool)
            np.add.at(change, first + runs.low[run[~unsure]], 1)
            np.add.at(change, first + runs.high[run[~unsure]] + width, -1)
            of, start, w = runs.windows(run[unsure])
            there, at = _member(w, windows)
            there[there] = window_a[at[there]] == runs.a[of[there]]
            np.add.at(change, first + start[there], 1)
            np.add.at(change, first + start[there] + width, -1)
        columns = {c: rows.column(c) for c in rows.schema.names if c.startswith("_c") and c != text}
        columns |= _finished(rows.column(text), word_at, np.cumsum(change[:-1]) > 0, finish)
        yield _rows(schema, rows.num_rows, **columns)


def _found(docs: DataFrame, width: int, finish: Finish) -> DataFrame:
    """The columns of ``docs`` but the text as _c0, _c1 ..., with n_words, spans and kept."""
    spark = docs.sparkSession
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    text = f"_c{docs.columns.index('text')}"
    fields = [T.StructField(f.name, f.dataType) for f in named.schema.fields]  # null in rows of other kinds
    size = named.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(-(-size // SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sharded = named.withColumn("shard", F.pmod(F.xxhash64(*[F.col(c) for c, kind in named.dtypes if not kind.startswith(("map", "variant"))]), F.lit(n)).cast("int"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PHRASES)
        for part in t.slices(batches, text, SLICE):
            shard = part.column("shard").to_numpy()
            for _, runs in _pieces(*_words(part, text), width):
                if len(runs.a):
                    columns = [pa.array(shard[runs.doc]), _longs(runs.a), _longs(runs.blocks())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def dealt(*parts: DataFrame) -> DataFrame:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return rows.repartition(n, "shard").sortWithinPartitions("shard", "kind")

    chosen = cut(sharded.select("shard", text).mapInArrow(phrases, PHRASES), "phrases")
    recurring = (
        chosen.groupBy("a")
        .agg(F.count("*").alias("n"), (F.min("b") != F.max("b")).alias("mixed"))
        .filter("n > 1")
        .select("a", "mixed")
    )
    known = chosen.select("shard", "a").join(recurring, "a").groupBy("shard", "a").agg(F.any_value("mixed").alias("mixed"))
    known = cut(known.select("shard", F.lit(KNOWN).alias("kind"), "a", "mixed"), "phrases-known")
    drop_cut(chosen)

    first = T.StructType([*FIRST.fields, *RESULT.fields, *fields])
    arrow = to_arrow_schema(first)
    seen = dealt(known, sharded.withColumn("kind", F.lit(DOCUMENT)))
    seen = cut(seen.mapInArrow(lambda rows: _first_pass(rows, text, arrow, width, finish), first), "phrases-seen")
    drop_cut(known)

    counted = seen.filter(F.col("kind") == COUNTED).select("shard", "a", "w", "n")
    twice = counted.groupBy("a", "w").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "w")
    confirmed = counted.select("shard", "a", "w").join(twice, ["a", "w"]).distinct()
    second = T.StructType([*RESULT.fields, *[f for f in fields if f.name != text]])
    arrow_second = to_arrow_schema(second)
    rest = dealt(
        seen.filter(F.col("kind") == PATTERN).select("shard", F.lit(KNOWN).alias("kind"), "a", "mixed", "phrase").distinct(),
        confirmed.withColumn("kind", F.lit(CONFIRMED)),
        seen.filter(F.col("kind") == OPEN).select("shard", F.lit(DOCUMENT).alias("kind"), *named.columns),
    ).mapInArrow(lambda rows: _second_pass(rows, text, arrow_second, width, finish), second)
    return rest.unionByName(seen.filter(F.col("kind") == DONE).select(*second.names))


def _result(docs: DataFrame, width: int, finish: Finish) -> DataFrame:
    """The columns of ``docs`` with the kept text in the place of the text, then n_words and spans."""
    found = _found(docs, width, finish)
    kept = [
        F.col("kept" if c == "text" else f"_c{i}").alias(c)
        for i, c in enumerate(docs.columns)
        if c not in ("n_words", "spans")
    ]
    return found.select(*kept, "n_words", "spans")


def deduplicated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, as text, and n_words and removal spans before.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``width`` consecutive
    words of its document covers it whose sequence starts anywhere else too, in the same
    document or another one; all copies go, also those of repeated rows. Spans count words from 0. A null
    or empty text has no words and becomes empty, and texts below ``width`` words stay as they are but for
    spaces. Very long texts are looked at in pieces that share no window. An empty table
    stays empty. Other columns pass through; one named n_words or spans gives way.
    """
    return _result(docs, width, joined)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`deduplicated`."""
    found = _result(docs.select("doc_id", "text"), WINDOW, digest)
    gone = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.col("text").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM d),
w AS (SELECT r, p, md5(array_to_string(list_slice(words, p, p + 34), ' ')) AS k FROM s),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT r, p + o AS p FROM (SELECT r, p, unnest(range(0, 35)) AS o FROM w SEMI JOIN t USING (k))),
a AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
g AS (SELECT r, count(*) AS n, count(c.p) AS gone, string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY a.p) AS kept
      FROM a LEFT JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
