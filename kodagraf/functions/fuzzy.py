"""Nearest names by sequence similarity, compared block against block."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.runtime import cut

_BINS = 64


def _spread(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point, word and place of every letter."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    return codes, word, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sizes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _letters(words: list[str]) -> np.ndarray:
    """How often each word has the letters of each bin."""
    codes, word, _ = _spread(words)
    counts = np.bincount(word * _BINS + codes % _BINS, minlength=len(words) * _BINS)
    return counts.reshape(len(words), _BINS).astype(np.int16)


#: From this length of the query on, the matcher leaves out frequent letters.
_JUNK_FROM = 200
#: Queries compared at once, names first looked at for each of them, and pairs taken together by the two measures.
_BATCH, _FIRST, _PAIRS, _CHUNK = 128, 1024, 1 << 16, 2048
#: A round compares with so many times the blocks of names that were taken before it.
_ROUND = 8
#: How often a letter is counted one by one; what a name has beyond that always counts as common.
_TIMES = 8


def _numbers(names: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Letters as small numbers, one column per name, filled up with -1; and the number of each letter."""
    codes, word, place = _spread(names)
    alphabet, number = np.unique(codes, return_inverse=True)
    out = np.full((int(place.max(initial=-1)) + 1, len(names)), -1, dtype=np.int16 if len(alphabet) < 1 << 15 else np.int32)
    out[place, word] = number
    return out, {chr(c): i for i, c in enumerate(alphabet.tolist())}


def _coded(words: list[str], number: dict[str, int], dtype: np.dtype) -> np.ndarray:
    """Words in the numbers of other words' letters, one column each; letters those do not have, and places behind the end, are -2."""
    codes, word, place = _spread(words)
    alphabet, which = np.unique(codes, return_inverse=True)
    out = np.full((int(place.max(initial=-1)) + 1, len(words)), -2, dtype=dtype)
    out[place, word] = np.array([number.get(chr(c), -2) for c in alphabet.tolist()], dtype)[which]
    return out


def matched(letters: np.ndarray, lengths: np.ndarray, queries: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Letters in matching blocks of every name (a column of ``letters``) with its query (the same column of ``queries``).

    The longest common block comes first (of several the one that starts first in the name, then in
    the query), then what is left and right of it, for all names at once. A name that cannot reach its ``least`` is
    left where it stands, below it.
    """
    total = np.zeros(len(lengths), np.int64)
    name = np.flatnonzero((lengths > 0) & (sizes > 0))
    a_low, a_high = np.zeros(len(name), np.int64), lengths[name].astype(np.int64)
    b_low, b_high = np.zeros(len(name), np.int64), sizes[name].astype(np.int64)
    places = np.arange(len(queries))[:, None]
    while len(name):
        wanted = queries[:, name]
        run, before = np.zeros((2, len(queries), len(name)), np.uint8)  # queries are shorter than 256 letters
        inside = (places >= b_low) & (places < b_high)
        best, at_a, at_b = np.zeros((3, len(name)), np.int64)
        for i in range(int(a_low.min()), int(a_high.max())):
            run, before = before, run
            run[0] = 1
            np.add(before[:-1], 1, out=run[1:])
            equal = wanted == np.where((a_low <= i) & (i < a_high), letters[i, name], -1)
            equal &= inside
            run *= equal.view(np.uint8)
            most = run.max(axis=0)
            longer = np.flatnonzero(most > best)  # an equal block that starts later is no better
            if len(longer):
                size = most[longer].astype(np.int64)
                best[longer], at_a[longer] = size, i - size + 1
                at_b[longer] = run[:, longer].argmax(axis=0) - size + 1
        np.add.at(total, name, best)
        some = np.flatnonzero(best)
        name, best, at_a, at_b = (x[some] for x in (name, best, at_a, at_b))
        a_low, a_high, b_low, b_high = (x[some] for x in (a_low, a_high, b_low, b_high))
        name = np.concatenate([name, name])
        a_low, a_high = np.concatenate([a_low, at_a + best]), np.concatenate([at_a, a_high])
        b_low, b_high = np.concatenate([b_low, at_b + best]), np.concatenate([at_b, b_high])
        rest = np.minimum(a_high - a_low, b_high - b_low)
        hope = total + np.bincount(name, rest, len(total))
        go = np.flatnonzero((rest > 0) & (hope[name] >= least[name]))
        name, a_low, a_high, b_low, b_high = (x[go] for x in (name, a_low, a_high, b_low, b_high))
    return total


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The ratio of a sequence matcher for each pair of a left and a right word."""
    sizes = _sizes(right)
    out = np.zeros(len(left))
    order = np.argsort(sizes, kind="stable")
    short = order[: np.searchsorted(sizes[order], _JUNK_FROM)]
    for at in range(0, len(short), _CHUNK):
        pick = short[at : at + _CHUNK]
        a, b = [left[i] for i in pick], [right[i] for i in pick]
        letters, number = _numbers(a)
        lengths = _sizes(a)
        total = lengths + sizes[pick]
        same = matched(letters, lengths, _coded(b, number, letters.dtype), sizes[pick], np.zeros(len(pick)))
        out[pick] = np.where(total > 0, 2.0 * same / np.maximum(total, 1), 1.0)
    for i in order[len(short) :]:
        out[i] = difflib.SequenceMatcher(None, left[i], right[i]).ratio()
    return out


class _Block:
    """Names of one block in ascending order, prepared for the comparison with batches of queries."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.lengths = _sizes(self.names)
        self.letters, self.number = _numbers(self.names)
        counts = _letters(self.names)
        self.levels = [(t, np.flatnonzero(counts.max(axis=0, initial=0) >= t)) for t in range(1, _TIMES + 1)]
        self.steps = self._steps(counts)
        self.beyond = np.maximum(counts - _TIMES, 0).sum(axis=1, dtype=np.float32)

    def _steps(self, counts: np.ndarray) -> np.ndarray:
        """Whether a word has a letter once, twice and so on: a product of two such rows counts their letters in common."""
        return np.concatenate([counts[:, bins] >= t for t, bins in self.levels], axis=1).astype(np.float32)

    def common(self, queries: list[str]) -> np.ndarray:
        """Letters in common of each query with each name, or somewhat more."""
        return self._steps(_letters(queries)) @ self.steps.T + self.beyond

    def in_order(self, coded: np.ndarray, sizes: np.ndarray, query: np.ndarray, name: np.ndarray) -> np.ndarray:
        """For pairs of a query and a name the most letters that both have in the same order.

        Matching blocks are such letters, so no more can match. One bit stands for each letter of the query, in words of 64 bits.
        """
        words = max(1, -(-len(coded) // 64))
        marks = np.zeros((coded.shape[1], len(self.number) + 1, words), np.uint64)
        place, who = np.nonzero(coded >= 0)
        np.bitwise_or.at(marks, (who, coded[place, who], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        marks = marks.reshape(-1, words)
        out = np.zeros(len(query), np.int64)
        order = np.argsort(-self.lengths[name], kind="stable")  # names that have come to their end are left behind
        for at in range(0, len(order), _PAIRS):
            pick = order[at : at + _PAIRS]
            n, base = name[pick], query[pick] * (len(self.number) + 1)
            left = np.full((words, len(pick)), ~np.uint64(0))
            lengths = self.lengths[n]
            for i in range(int(lengths.max(initial=0))):
                go = int(np.searchsorted(-lengths, -i))  # those longer than i
                seen = marks[base[:go] + self.letters[i, n[:go]]]
                carry = np.zeros(go, np.uint64)
                for w in range(words):
                    rest = left[w, :go]
                    hit = rest & seen[:, w]
                    total = rest + hit
                    over = total < hit
                    if words > 1:
                        total += carry
                        carry = (over | (total < carry)).astype(np.uint64)
                    left[w, :go] = total | (rest ^ hit)
            out[pick] = 64 * words - np.bitwise_count(left).sum(axis=0, dtype=np.int64)
        return out

    def ratios(self, queries: list[str], coded: np.ndarray, sizes: np.ndarray, query: np.ndarray, name: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Ratios of pairs; those below the floor of their query may come out smaller."""
        total = np.maximum(self.lengths[name] + sizes[query], 1)
        out = np.zeros(len(query))
        short = np.flatnonzero(sizes[query] < _JUNK_FROM)
        for at in range(0, len(short), _CHUNK):
            pick = short[at : at + _CHUNK]
            q, n = query[pick], name[pick]
            least = np.ceil(floor[q] * total[pick] / 2 - 1e-9)
            longest = int(sizes[q].max())
            out[pick] = 2.0 * matched(self.letters[:, n], self.lengths[n], coded[:longest, q], sizes[q], least) / total[pick]
        long = np.flatnonzero(sizes[query] >= _JUNK_FROM)
        for q in np.unique(query[long]):
            matcher = difflib.SequenceMatcher(b=queries[q])
            for i in long[query[long] == q]:
                matcher.set_seq1(self.names[name[i]])
                out[i] = matcher.ratio()
        return out

    def nearest(self, queries: list[str], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, name, ratio) of the ``k`` best names of each query that reach its floor."""
        sizes = _sizes(queries)
        floor = floor.copy()
        coded = _coded(queries, self.number, self.letters.dtype)
        total = np.maximum(sizes[:, None] + self.lengths, 1).astype(np.float32)
        bound = self.common(queries)
        bound = 2 * np.minimum(bound, np.minimum(sizes[:, None], self.lengths)) / total
        slack = 1e-5  # of the single precision
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for first in (True, False):  # the likeliest names first, for an early floor
            if first and bound.shape[1] > 2 * _FIRST:
                name = np.argpartition(-bound, _FIRST, axis=1)[:, :_FIRST]
                query = np.repeat(np.arange(len(queries)), _FIRST)
                name = name.ravel()
                some = bound[query, name] >= floor[query] - slack
                query, name = query[some], name[some]
                bound[query, name] = -1
            else:
                query, name = np.nonzero(bound >= (floor - slack)[:, None])
                bound[query, name] = -1
            best = self._visit(queries, coded, sizes, query, name, k, floor, best)
        return best

    def _visit(self, queries, coded, sizes, query, name, k, floor, best):
        """Takes the pairs in, best hopes first, against floors that rise with the best ``k`` of each query."""
        hope = 2.0 * self.in_order(coded, sizes, query, name) / np.maximum(self.lengths[name] + sizes[query], 1)
        order = np.lexsort((-hope, query))
        query, name, hope = query[order], name[order], hope[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        low, high = 0, k
        while True:
            open_ = hope >= floor[query]
            go = np.flatnonzero(open_ & (place >= low) & (place < high))
            found = self.ratios(queries, coded, sizes, query[go], name[go], floor)
            q, n, r = (np.concatenate(x) for x in zip(best, (query[go], name[go], found)))
            q, n, r = (x[r >= floor[q]] for x in (q, n, r))
            order = np.lexsort((-n, -r, q))
            q, n, r = q[order], n[order], r[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            best = q[rank < k], n[rank < k], r[rank < k]
            last = rank == k - 1
            floor[q[last]] = np.maximum(floor[q[last]], r[last])
            if not ((hope >= floor[query]) & (place >= high)).any():
                return best
            low, high = high, 2 * high


def nearest_in_block(queries: pd.DataFrame, names: list[str], k: int, cutoff: float) -> pd.DataFrame:
    """The ``k`` best names of one block for each query; with a column ``floor`` only those that reach it.

    The ratio is at most that of the letters in common, and of those in the same order. Names are visited by these bounds,
    against a floor that rises with the best ``k``: nothing that belongs to the result is skipped.
    """
    queries = queries.reset_index(drop=True)
    asked = queries["query"].tolist()
    floors = queries["floor"].to_numpy() if "floor" in queries else np.full(len(asked), cutoff)
    block = _Block(names) if names else None
    order = np.argsort(_sizes(asked), kind="stable")  # queries of one length take the same room
    who, what, ratio = [np.zeros(0, np.int64)], [], [np.zeros(0)]
    for at in range(0, len(order) if block else 0, _BATCH):
        pick = order[at : at + _BATCH]
        q, n, r = block.nearest([asked[i] for i in pick], k, floors[pick])
        who.append(pick[q])
        what += [block.names[i] for i in n]
        ratio.append(r)
    out = queries.loc[np.concatenate(who), ["query_id", "query"]].reset_index(drop=True)
    return out.assign(name=pd.Series(what, dtype=object), ratio=np.concatenate(ratio))


def nearest_names(
    queries: DataFrame,
    names: DataFrame,
    k: int,
    cutoff: float = 0.3,
    names_per_block: int = 20_000,
    queries_per_block: int = 4_000,
) -> DataFrame:
    """(query_id, query, name, score, rank): the ``k`` closest of the distinct ``names`` per query.

    The work is laid out as a grid of blocks of bounded size; each block returns at most
    ``k`` names for a query, so pairs are never written out. Blocks of names are taken in rounds, each of several times
    more blocks than all before it, and a round keeps only names that reach the best ``k`` of those.
    """
    parallel = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, query string, name string, ratio double"
    order = Window.partitionBy("query_id").orderBy(F.desc("ratio"), F.desc("name"))

    rows = F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(names_per_block))).cast("bigint")
    names = names.filter("name IS NOT NULL")
    n_rows, n_queries = names.agg(rows).first()[0], queries.count()

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest_in_block(b, a["name"].tolist(), k, cutoff)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=ratios([x.lower() for x in b["query"]], [x.lower() for x in b["name"]]))

    best, low = None, 0
    while low < n_rows:
        high = min(n_rows, max(1, _ROUND * low))
        # Name blocks as large as allowed, since a larger block is cut off earlier; the
        # queries are then dealt out finely enough to keep all tasks busy.
        n_cols = max(1, -(-n_queries // queries_per_block), -(-2 * parallel // (high - low)))
        left = (
            names.select("name")
            .withColumn("bi", F.pmod(F.xxhash64("name"), F.lit(n_rows)))
            .filter(F.col("bi").between(low, high - 1))
            .withColumn("bj", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cols - 1).cast("bigint"))))
        )
        right = queries.select("query_id", "query")
        if best is None:
            right = right.withColumn("floor", F.lit(float(cutoff)))
        else:
            reached = best.groupBy(F.col("query_id").alias("_id")).agg(F.when(F.count("*") >= k, F.min("ratio")).alias("floor"))
            right = right.join(reached, F.col("query_id").eqNullSafe(F.col("_id")), "left").drop("_id")
            right = right.withColumn("floor", F.coalesce("floor", F.lit(float(cutoff))))
        right = right.withColumn("bj", F.pmod(F.xxhash64("query_id", "query"), F.lit(n_cols))).withColumn(
            "bi", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint")))
        )
        # The rows are few and the work for each is much: with a number of their own the partitions are not put together.
        tasks = min(4 * parallel, n_cols * (high - low))
        pairs = [side.repartition(tasks, "bi", "bj").groupBy("bi", "bj") for side in (left, right)]
        found = pairs[0].cogroup(pairs[1]).applyInPandas(compare, schema)
        found = found if best is None else best.unionByName(found)
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = cut(found.drop("rank"), "nearest") if high < n_rows else found
        low = high
    return best.mapInPandas(scored, f"{schema}, rank int, score double").select("query_id", "query", "name", "score", "rank")
