import difflib
import fnmatch
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kodagraf.functions import fuzzy, globs, ids, languages, scoring, text
from kodagraf.functions.fuzzy import nearest_in_block, nearest_names
from kodagraf.functions.skeletons import skeleton_text
from kodagraf.params import BuildConfig, within


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_ids(spark):
    unit_ids = ["src/a/b.py:C.m", "b.py:f", "/x.py:f", "plain", "/a/b.txt"]
    assert column(spark, unit_ids, ids.symbol_name) == ["C.m", "f", "f", "plain", "/a/b.txt"]
    assert column(spark, unit_ids, ids.symbol_name_or_null) == ["C.m", "f", "f", None, None]
    assert column(spark, unit_ids, ids.module_path) == ["src/a", ".", "/", ".", "/a"]
    assert column(spark, unit_ids, ids.map_symbol_name)[3:] == ["plain", "b"]


def test_languages(spark):
    paths = ["a.py", "a.TS", "b.js", "c.go", "d.rs", "E.java", "f.txt", ".py", "dir.py/none", "x.hxx"]
    want = ["python", "typescript", "javascript", "go", "rust", "java", "unknown", "unknown", "unknown", "cpp"]
    assert column(spark, paths, languages.detect_language) == want
    assert column(spark, ["a.zig"], lambda c: languages.detect_language(c, {".zig": "go"})) == ["go"]
    assert len(languages.all_suffixes()) == 21
    assert languages.primary_suffix("python") == ".py" and languages.suffixes_of("nothing") == []
    assert languages.language_table(spark).count() == 21


GLOBS = ["*.py", "a?c", "[!a]bc", "[ab]*", "build", "x.y+z", "**/t", "a[b", "*~", "é*"]
NAMES = ["a.py", "abc", "bbc", "cbc", "build", "x.y+z", "p/q/t", "a[b", "f~", "dir/a.py", "été", "xay+z"]


def test_globs_as_in_fnmatch(spark):
    for pattern in GLOBS:
        want = [fnmatch.fnmatchcase(n, pattern) for n in NAMES]
        assert column(spark, NAMES, lambda c: c.rlike(globs.any_glob([pattern]))) == want, pattern
    df = spark.createDataFrame([(n, g) for g in GLOBS if g != "a[b" for n in NAMES], "n string, g string")
    regex = F.concat(F.lit(r"(?s)\A(?:"), globs.glob_regex_col(F.col("g")), F.lit(r")\z"))
    for n, g, hit in df.select("n", "g", F.rlike("n", regex)).collect():
        assert hit == fnmatch.fnmatchcase(n, g), (n, g)


def test_ignored_paths(spark):
    paths = ["src/a.py", "node_modules/x/y.js", "a/build/z.ts", "lib/t.pyc", "venv", "sites/a"]
    assert column(spark, paths, lambda c: globs.path_ignored(c, globs.DEFAULT_IGNORES)) == [False, True, True, True, True, False]
    assert len(globs.DEFAULT_IGNORES) == 38
    assert column(spark, ["a", "a/b", "x/a/c"], lambda c: globs.config_ignored(c, ["a/**"])) == [False, True, False]


def test_query_symbols(spark):
    got = column(spark, ["refactor `create_user` in UserService", "say 'x1' and \"y_2\" éa b", ""], text.query_symbols)
    assert got == [["create_user", "UserService", "refactor", "in"], ["x1", "y_2"], []]
    assert len(set(text.COMMON_WORDS)) == len(text.COMMON_WORDS) == 165


def test_scores(spark):
    df = spark.createDataFrame([("getuser", "getuser_all")], "q string, n string")
    row = df.select(scoring.prefix_score(F.col("q"), F.col("n")).alias("s")).select(
        scoring.round3(F.col("s")), scoring.match_type(F.col("s"))
    ).first()
    assert tuple(row) == (0.927, "prefix")


def test_nearest_names_equal_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("abcDe_12", k=rng.randint(1, 14))) for _ in range(300)})
    queries = ["abc_1", "De", "cab12", "zzz", "a" * 40, "bDe_2a1"]

    def best(query, k):
        scored = [(difflib.SequenceMatcher(None, n, query).ratio(), n) for n in names]
        return sorted([x for x in scored if x[0] >= 0.3], reverse=True)[:k]

    block = nearest_in_block(pd.DataFrame({"query_id": range(len(queries)), "query": queries}), names, 300, 0.3)
    for i, q in enumerate(queries):
        got = sorted(zip(block[block.query_id == i]["ratio"], block[block.query_id == i]["name"]), reverse=True)
        assert got == best(q, 300)
        assert difflib.get_close_matches(q, names, 300, 0.3) == [n for _, n in got]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    rows = nearest_names(q, n, 5, names_per_block=70, queries_per_block=2).collect()
    for i, query in enumerate(queries):
        assert [r.name for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] == [x for _, x in best(query, 5)]


def test_nearest_names_compare_few_pairs(monkeypatch):
    """Letters in the same order rule out most names that have all letters of a long request."""
    firsts, seconds = "large hot blue old cold red".split(), "ring bolt plate gear box".split()
    names = [f"{a}_{b}_{t}" for a in firsts for b in seconds for t in range(97)]
    queries = pd.DataFrame({"query_id": [0, 1], "query": ["Refactor `hot_gear_17` to call `old_ring_3`", "Refactor `blue_box_5` to call `red_bolt_61`"]})
    seen, whole = [], fuzzy.matched

    def count(letters, lengths, *rest):
        seen.append(len(lengths))
        return whole(letters, lengths, *rest)

    monkeypatch.setattr(fuzzy, "matched", count)
    block = nearest_in_block(queries, names, 20, 0.3)
    assert sum(seen) < 0.3 * len(names) * len(queries)
    for i, query in enumerate(queries["query"]):
        want = sorted(((difflib.SequenceMatcher(None, n, query).ratio(), n) for n in names), reverse=True)[:20]
        assert sorted(zip(block[block.query_id == i]["ratio"], block[block.query_id == i]["name"]), reverse=True) == want
        floor = want[4][0]
        least = nearest_in_block(queries[queries.query_id == i].assign(floor=floor), names, 20, 0.3)
        assert set(least["name"]) == {n for r, n in want if r >= floor}


def test_nearest_names_in_rounds_of_blocks(spark):
    """Later blocks add to the best of the first ones; null names, equal requests and null keys do no harm."""
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abcDe_12", k=rng.randint(1, 14))) for _ in range(400)})
    rows = [(1, "abc_12De"), (2, "a" * 70 + "bc_12"), (None, "De_De_1"), (4, "abc_12De"), (5, "b" * 210)]
    q = spark.createDataFrame(rows, "query_id bigint, query string")
    n = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    got = nearest_names(q, n, 6, cutoff=0.2, names_per_block=12, queries_per_block=2).collect()
    for key, query in rows:
        scored = sorted(((difflib.SequenceMatcher(None, x, query).ratio(), x) for x in names), reverse=True)
        mine = sorted((r for r in got if r.query_id == key), key=lambda r: r.rank)
        assert [r.name for r in mine] == [x for r, x in scored if r >= 0.2][:6]
        assert [r.score for r in mine] == [difflib.SequenceMatcher(None, query.lower(), r.name.lower()).ratio() for r in mine]


PY = '''import os

@cache
def f(a):
    """One line."""
    x = 1
    return x

class A:
    """Doc
    more
    """
    y = 2

    async def g(self):
        return 3

TOP = 1
'''


def test_python_skeleton():
    out = skeleton_text(PY, "python").split("\n")
    assert "    x = 1" not in out and "        return 3" not in out
    for line in ["import os", "@cache", "def f(a):", '    """One line."""', "    ...", "class A:", "    more", "    async def g(self):", "TOP = 1"]:
        assert line in out
    assert '    """One line."""' not in skeleton_text(PY, "python", docs=False)


def test_brace_skeletons():
    ts = "import {a} from 'b'\ninterface I {\n  x: number\n}\nexport function f(a) {\n  if (a) {\n    return 1\n  }\n}\nconst z = 1"
    assert skeleton_text(ts, "typescript") == "import {a} from 'b'\ninterface I {\n  x: number\n}\nexport function f(a) {\n    ...\nconst z = 1"
    go = "package p\ntype S struct {\n\tA int\n}\nfunc (s *S) M(a int) int {\n\treturn a\n}"
    assert skeleton_text(go, "go") == "package p\ntype S struct {\n\tA int\n}\nfunc (s *S) M(a int) int {\n    ...\n}"
    assert skeleton_text("int f() {\n  { x }\n}\nint y;", "cpp") == "int f() {\n    ...\n}\nint y;"


def test_limits():
    with pytest.raises(ValueError):
        within("limit", 0, (1, 100))
    with pytest.raises(ValueError):
        BuildConfig(dependency_depth=4)
    assert re.match(r"\d", str(BuildConfig().max_context_tokens))
