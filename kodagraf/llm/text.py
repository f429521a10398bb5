"""Words of many UTF-8 texts at once, as numpy arrays: used inside Arrow batches.

A text column is one flat byte array with offsets. Words are runs of bytes of a
class; each gets a 64-bit hash. Texts above ``PIECE`` bytes are hashed piece by
piece, so the working memory does not follow the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

PIECE = 4 << 20
LONG_WORD = 64

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = np.arange(256)
#: ``[^\x20\x09-\x0D]`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, the latter after lower-casing.
NOT_SPACE = (_BYTES != 0x20) & ((_BYTES < 0x09) | (_BYTES > 0x0D))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_PLAIN = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def struct(**columns: str | T.DataType) -> T.StructType:
    """A struct type without a session."""
    return T.StructType([T.StructField(k, _PLAIN[v] if isinstance(v, str) else v) for k, v in columns.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants by a rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed)) | np.uint64(1)


_BYTE_HASH = constants(256, 17)
_STEP = constants(1, 23)[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[start:end] if data is not None and end > start else np.zeros(0, np.uint8)
    return raw, offsets - start


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have at most ``limit`` bytes together, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        pa.default_memory_pool().release_unused()  # a worker stays, its memory need not


def _bounds(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = kind[low]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    order = np.argsort((-np.minimum(lengths, LONG_WORD + 1)).astype(np.int8), kind="stable")
    first, size = starts[order], lengths[order]
    h = size.astype(np.uint64) * _GOLD
    short_to = np.searchsorted(-size, -np.arange(0, LONG_WORD), "left")  # rows with more than i bytes
    for i in range(LONG_WORD):
        n = int(short_to[i])
        if n == 0:
            break
        h[:n] = (h[:n] ^ _BYTE_HASH[low[first[:n] + i]]) * _STEP
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = np.uint64(xxhash.xxh64_intdigest(low[first[k] : first[k] + size[k]].tobytes()))
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def word_hashes(
    raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray = LOWER
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts after ``fold``, and the offsets of each text's words."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if len(raw) > PIECE and len(offsets) == 2:
        found, at = [], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw):  # on to the end of the word
                stop = np.flatnonzero(~kind[fold[raw[end : end + PIECE]]])
                end += int(stop[0]) if len(stop) else min(PIECE, len(raw) - end)
                if len(stop):
                    break
            low = fold[raw[at:end]]
            found.append(_hash(low, *_bounds(low, np.array([0, end - at]), kind)))
            at = end
        h = np.concatenate(found)
        return h, np.array([0, len(h)], np.int64)
    low = fold[raw]
    starts, ends = _bounds(low, offsets, kind)
    return _hash(low, starts, ends), np.searchsorted(starts, offsets, "left")


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The set of ``k``-word shingles of one text, sorted; a shorter text is one shingle."""
    if len(h) == 0:
        return h
    by = constants(k, 31)
    if len(h) < k:
        return mix(np.array([(h * by[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * by[i]
    return np.unique(mix(total ^ _GOLD))
