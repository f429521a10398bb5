"""Byte-pair encoding and decoding in batched numpy merge rounds.

The words of a batch that were not met before are put into one flat array of symbols.
A round looks up every adjacent pair by binary search over the sorted pair keys of the
vocabulary, takes the lowest rank of each word, and merges its occurrences from left to
right; words without a known pair leave. Results are kept per task in a table of bounded
size, so each frequent word is merged once.

In a long word a round merges every pair whose rank is the lowest among the pairs around it, as far as the longest token
reaches: nothing can take its symbols first, so the result is the same and the rounds do not grow with the word.

The vocabulary file is that of a public tokenizer, read on the executors from a path
parameter (the library is installed on all of them).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kodagraf.llm import text as t

BATCH = 2 << 20
#: Words kept with their result in a task.
KEPT = 200_000
#: Words of more bytes than this are merged by neighbourhoods.
LONG = 1_000
#: The rank of a pair that is not in the vocabulary.
NO_RANK = np.iinfo(np.int32).max
#: Unicode white space.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Below this code point text is in composed form already, unless it holds a combining mark.
SIMPLE = 0x250


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary: normalised text is split by a pattern, each word merged on its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: s for s, i in vocab.items()}
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens.update({i: s for s, i in special.items()})
        self.special = special
        self.special_at = regex.compile("|".join(regex.escape(s) for s in special) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.pattern = regex.compile(pattern)
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        self.last_id = np.array([vocab[c + self.end] for c in symbols], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        key = (left << 20) | right
        _, first = np.unique(key, return_index=True)
        self.keys, self.ranks, self.made = key[first], first, made[first]
        # Neighbourhoods are exact if each token is made by one merge, which follows those that make its parts.
        step = np.full(max(self.tokens) + 1, -1)
        step[made] = np.arange(len(made))
        parts_first = np.maximum(step[left], step[right]) < np.arange(len(made))
        one_each = len(np.unique(made)) == len(made) == len(first)
        self.reach = max(len(s.removesuffix(self.end)) for s in vocab) if one_each and parts_first.all() else None
        from tokenizers import Tokenizer

        self.normalizer = Tokenizer.from_file(path).normalizer

    def normal(self, text: str) -> str:
        """Composed form in lower case; white space stays, as it only parts words."""
        if text.isascii():
            return text.lower()
        if ord(max(text)) < SIMPLE and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """Words in order; a special token is its own word, marked by its place before the split."""
        if "<|" not in text:
            return self.pattern.findall(self.normal(text))
        out: list[str] = []
        at = 0
        for m in self.special_at.finditer(text):
            out += self.pattern.findall(self.normal(text[at : m.start()]))
            out.append("\x00" + m.group())
            at = m.end()
        return out + self.pattern.findall(self.normal(text[at:]))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of many words at once."""
        coded = [w.encode() for w in words]
        long = [i for i, c in enumerate(coded) if len(c) > LONG and self.reach]
        if not long:
            return self._merge_words(coded)
        apart = set(long)
        short = [i for i in range(len(coded)) if i not in apart]
        out: list[list[int]] = [[]] * len(coded)
        for i, ids in zip(long, self._merge_long([coded[i] for i in long])):
            out[i] = ids
        if short:
            for i, ids in zip(short, self._merge_words([coded[i] for i in short])):
                out[i] = ids
        return out

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs and the tokens they make."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK).astype(np.int32), self.made[at]

    def _merge_long(self, coded: list[bytes]) -> list[list[int]]:
        """Rounds over long words that merge the pairs of lowest rank within ``reach`` symbols; only changed pairs are looked up again."""
        ends = np.cumsum([len(c) for c in coded])
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbol = self.byte_id[raw]
        symbol[ends - 1] = self.last_id[raw[ends - 1]]
        last = np.zeros(len(symbol), bool)
        last[ends - 1] = True
        rank, made = self._ranked(symbol, np.append(symbol[1:], 0))
        rank[last] = NO_RANK
        while (known := rank < NO_RANK).any():
            hit = known & (rank == _lowest_around(rank, self.reach))
            # Overlapping pairs of one rank (as in "aaa") merge from the left, and only all together.
            starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            sizes = np.diff(np.append(starts, len(rank)))
            hit &= np.repeat(np.logical_and.reduceat(hit, starts), sizes)
            hit &= (np.arange(len(rank)) - np.repeat(starts, sizes)) % 2 == 0
            chosen = np.flatnonzero(hit)
            symbol[chosen], last[chosen] = made[chosen], last[chosen + 1]
            keep = np.ones(len(symbol), bool)
            keep[chosen + 1] = False
            symbol, last, rank, made = symbol[keep], last[keep], rank[keep], made[keep]
            merged = chosen - np.arange(len(chosen))
            changed = np.unique(np.concatenate([merged, np.maximum(merged - 1, 0)]))
            after = np.minimum(changed + 1, len(symbol) - 1)
            rank[changed], made[changed] = self._ranked(symbol[changed], symbol[after])
            rank[last] = NO_RANK
        cut = np.flatnonzero(last) + 1
        return [part.tolist() for part in np.split(symbol, cut[:-1])]

    def _merge_words(self, coded: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(c) for c in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbol = self.byte_id[raw]
        ends = np.cumsum(sizes)
        symbol[ends - 1] = self.last_id[raw[ends - 1]]
        word = np.repeat(np.arange(len(coded)), sizes)
        done_words, done_symbols = [], []
        while len(symbol):
            inside = word[1:] == word[:-1]
            key = (symbol[:-1] << 20) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = inside & (self.keys[at] == key)
            rank = np.where(known, self.ranks[at], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(np.append(rank, np.iinfo(np.int64).max), starts)
            per = np.repeat(best, np.diff(np.append(starts, len(word))))
            # The last symbol of a word has no pair inside it, so its rank is never the best.
            hit = known & (rank == per[:-1])
            ended = per == np.iinfo(np.int64).max
            if ended.any():
                done_words.append(word[ended])
                done_symbols.append(symbol[ended])
            # In a run of overlapping pairs (as in "aaa") every second one merges, from the left.
            run_start = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            offset = place - np.maximum.accumulate(np.where(run_start, place, 0))
            hit &= offset % 2 == 0
            chosen = np.flatnonzero(hit)
            symbol[chosen] = self.made[at[chosen]]
            keep = ~ended
            keep[chosen + 1] = False
            symbol, word = symbol[keep], word[keep]
        ids = np.concatenate(done_symbols)
        owner = np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(coded) + 1)).tolist()
        ids_list = ids.tolist()
        return [ids_list[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _lowest_around(rank: np.ndarray, reach: int) -> np.ndarray:
    """The least rank from ``reach`` places before to ``reach`` places after each place."""
    width, span = 2 * reach + 1, 1
    edge = np.full(reach, NO_RANK, rank.dtype)
    low = np.concatenate([edge, rank, edge])
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:])


class Encoder:
    """Encodes texts batch by batch and remembers words up to a bound."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.known: dict[str, tuple[str, str, int]] = {}

    def _learn(self, words: list[str]) -> None:
        for w in [w for w in words if w[0] == "\x00" and w[1:] in self.bpe.special]:
            self.known[w] = (str(self.bpe.special[w[1:]]), w[1:], 1)
        words = [w for w in words if w not in self.known]
        if words:
            for w, ids in zip(words, self.bpe.merge(words)):
                self.known[w] = (" ".join(map(str, ids)), " ".join(self.bpe.tokens[i] for i in ids), len(ids))

    def encode(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """(ids joined by a space, decoded text, number of tokens) of each text."""
        split = [self.bpe.words(x) if x else [] for x in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(fresh) > KEPT and self.known:
            self.known.clear()
            fresh = {w for words in split for w in words}
        if fresh:
            self._learn(list(fresh))
        out = []
        for words in split:
            got = [self.known[w] for w in words]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])))
        return out


TOKENS = t.struct(n_tokens="long", ids="string", decoded="string")
DIGESTS = t.struct(n_tokens="long", ids_sha256="string", decoded_sha256="string")


def _mapped(docs: DataFrame, path: str | None, result: T.StructType, digest: bool) -> DataFrame:
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    text = f"_c{columns.index('text')}"
    carried = [f for f in named.schema.fields if not digest or f.name != text]
    schema = T.StructType(carried + result.fields)
    arrow = to_arrow_schema(schema)

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Bpe(path or default_path()))
        for part in t.slices(batches, text, BATCH):
            got = encoder.encode(part.column(part.schema.get_field_index(text)).to_pylist())
            made = [
                [n for _, _, n in got],
                [sha(i) if digest else i for i, _, _ in got],
                [sha(d) if digest else d for _, d, _ in got],
            ]
            own = [part.column(part.schema.get_field_index(f.name)) for f in carried]
            yield pa.RecordBatch.from_arrays(
                [*(c.cast(f.type) for c, f in zip(own, arrow)), *(pa.array(m, f.type) for m, f in zip(made, list(arrow)[len(own) :]))],
                schema=arrow,
            )

    out = named.mapInArrow(run, schema)
    back = [
        F.col(f"_c{i}").alias(c) for i, c in enumerate(columns) if c not in result.names and not (digest and c == "text")
    ]
    return out.select(*back, *result.names)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids (decimal, joined by one space) and the decoded text.

    A null or empty text, or one of white space only, has no tokens; both strings are
    then empty. Rows are independent: repeated rows repeat, an empty table stays empty. A very long text is
    encoded whole by one task; the time grows with its length, also if it is a single word.
    A column that has the name of a result gives way to it.
    """
    return _mapped(docs, path, TOKENS, digest=False)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the joined ids and of the decoded text."""
    return _mapped(docs.select("doc_id", "text"), path, DIGESTS, digest=True)
