"""Ranked search, the prefix trie and repeated passages against plain versions."""

import random

import pytest

from kodagraf.llm import prefix_trie, ranked_search, substring_dedup
from tests.llm import brute
from tests.llm.test_operators import ODD, docs, pairs, with_extras  # noqa: F401  docs is a fixture

ITEMS = [(1, "All rights RESERVED zebra"), (2, None), (3, " . "), (4, "word " * 90), (4, "the ärger of line"), (4, "the ärger of line"), (None, "zebra 42 x")]


@pytest.fixture
def items(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    return bench.select("item_id", "text").unionByName(spark.createDataFrame(ITEMS, "item_id long, text string"))


def ranked(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("tuned", [{}, {"BUCKET": 7, "SEEDS": 5, "BLOCK": 9_000, "COORDINATES": 400, "SLICE": 3_000}])
def test_ranked_search(docs, items, monkeypatch, tuned):  # noqa: F811
    for k, v in tuned.items():
        monkeypatch.setattr(ranked_search, k, v)
    want = brute.ranked(pairs(docs), list(dict.fromkeys(map(tuple, items.collect()))), 9)
    assert ranked(ranked_search.search(with_extras(docs), items, 9)) == sorted(want, key=repr)


def test_ranked_search_ties_and_repeated_rows(spark, make_docs):
    docs = make_docs([(i, "one two three") for i in range(40)] + [(7, "one two three"), (None, "one two three"), (50, "three"), (51, "x")])  # noqa: F811
    items = spark.createDataFrame([(1, "three two"), (2, "none of these")], "item_id long, text string")
    got = ranked_search.search(docs, items, 45)
    assert ranked(got) == sorted(brute.ranked(pairs(docs), [(1, "three two"), (2, "none of these")], 45), key=repr)


def test_ranked_search_of_nothing(make_docs, items):
    some = make_docs({1: "a b"})
    for d, i in ((some.limit(0), items), (make_docs({1: None, 2: " ."}), items), (some, items.limit(0)), (make_docs({1: "unheard"}), items)):
        got = ranked_search.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed, n, deep):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 5, deep])):
            out.append((c, turn, "user" if turn % 2 else "assistant", rng.choice("aab") if turn < 6 else "é" * (turn % 5)))
    return out


AWKWARD = [
    (None, 0, "user", "lost"), (3, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, "assistant", "x" * 50_000),
    (-7, 1, "user", "b"), (-5, 1, "user", "a"), (1 << 40, 5, None, "z"), (8, -1, "user", "a"), (8, None, "user", "a"),
]


@pytest.mark.parametrize(
    "rows,turns", [(conversations(1, 60, 12), None), (conversations(1, 60, 12), 60), (conversations(2, 25, 90), None), (AWKWARD, None), (AWKWARD, 2)]
)
def test_prefix_trie(spark, monkeypatch, rows, turns):
    if turns:  # shared prefixes are peeled by Spark, level by level
        monkeypatch.setattr(prefix_trie, "TURNS", turns)
        monkeypatch.setattr(prefix_trie, "PIECE", 2)
        monkeypatch.setattr(prefix_trie, "TOGETHER", 5)
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS base", "2 AS path", "3 AS depth").repartition(3)
    assert sorted(map(tuple, prefix_trie.nodes(df).collect()), key=repr) == sorted(brute.trie(rows), key=repr)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.nodes(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "a")], CONVERSATIONS)).count() == 0


def texts(seed, n):
    rng = random.Random(seed)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.choice([8, 11, 30]))) for _ in range(6)]
    parts = lambda: [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices("stuvwxyzSTUVWXYZ", k=9)) for _ in range(rng.randrange(8))]
    return {i: "\n ".join(parts()) for i in range(n)}


@pytest.mark.parametrize("tuned", [{}, {"SHARD": 500, "SLICE": 300, "PIECE_WORDS": 37}])
@pytest.mark.parametrize("width", [12, 19, 35])
def test_repeated_passages(spark, make_docs, monkeypatch, tuned, width):
    for k, v in tuned.items():
        monkeypatch.setattr(substring_dedup, k, v)
    some = texts(width, 40) | {90: "word " * 400, 91: "a b " * 60, 92: None, 93: "", 94: " \t", 95: "x " * (width - 1), 96: "tail " + "x " * (width + 3)}
    rows = [*some.items(), (3, some[3]), (None, some[4]), (97, " ".join(f"w{i % 97}" for i in range(5_000)))]
    df = with_extras(make_docs(rows))
    got = substring_dedup.deduplicated(df, width)
    assert got.columns == [c for c in df.columns if c not in ("n_words", "spans")] + ["n_words", "spans"]
    shown = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["text"]) for r in got.collect()), key=repr)
    assert shown == sorted(brute.repeats(rows, width), key=repr)


def test_repeated_passages_of_documents(docs):  # noqa: F811
    want = [(i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.repeats(pairs(docs))]
    assert sorted(map(tuple, substring_dedup.report(with_extras(docs)).collect()), key=repr) == sorted(want, key=repr)


def test_repeated_passages_of_nothing(make_docs):
    assert substring_dedup.report(make_docs({1: ""}).limit(0)).count() == 0
    assert substring_dedup.report(make_docs(dict.fromkeys(ODD))).count() == len(ODD)
