import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kodagraf.operators import context, edges, index, lookup, search
from kodagraf.params import BuildConfig
from kodagraf.plans import requests as front
from kodagraf.sources import config, extract, scan


def unit(name, body="", kind="FUNCTION", path="src/a.py", start=1, end=9, sig=None, doc=None):
    return (f"{path}:{name}", kind, start, end, sig or f"def {name}()", body, doc)


def triples(df):
    return {tuple(r) for r in df.select("source_id", "target_id", "edge_type").collect()}


# Edges in text


def test_calls_need_the_whole_name(make_units):
    units = make_units([unit("src", "x = foo(1); food(2); a.bar (3)"), unit("foo"), unit("bar", start=2), unit("a.bar", start=3), unit("ood", start=4)])
    assert {t.split(":")[1] for s, t, _ in triples(edges.call_edges(units)) if s.endswith(":src")} == {"foo", "bar", "a.bar"}


def test_calls_equal_trying_every_pair(make_units):
    rng = random.Random(4)
    names = ["f", "g", "C.m", "$x", "a$b", "b", "op<T>", "naïve", "m", "x.y.z", "z"]
    bits = ["f(", "g (", "C.m(", "obj.C.m(", "a$b(", "$x(", "q$x(", "op<T>(", "naïve\n(", "x.y.z(", "éf(", "ff(", "f", "m (", "x.y(", ".z("]
    rows = [unit(n, " ".join(rng.choices(bits, k=5)), path=f"p{i % 3}/f.py", start=i) for i, n in enumerate(names)]
    want = set()
    for s in rows:
        for t in rows:
            name = t[0].rsplit(":", 1)[1]
            if s[0] != t[0] and re.search(rf"\b{re.escape(name)}\s*\(", s[5]):
                want.add((s[0], t[0], "CALLS"))
    assert triples(edges.call_edges(make_units(rows))) == want
    own = {e for e in want if e[0].split(":")[0] == e[1].split(":")[0]}
    assert triples(edges.call_edges(make_units(rows), scope="file")) == own


def test_texts_do_not_travel_when_no_name_is_odd(make_units):
    """Then the plan holds no words of texts but those before a bracket."""
    plan = lambda names: edges.call_edges(make_units([unit(n, "f(x)", start=i) for i, n in enumerate(names)]))._jdf.queryExecution().analyzed().toString()
    assert plan(["f", "g"]).count("Generate explode") == 1
    assert plan(["f", "op<T>"]).count("Generate explode") == 2


def test_many_odd_names_meet_in_a_shuffle(make_units, monkeypatch):
    rows = [unit("src", "a<b> (1); c-d(2) e-f"), unit("a<b>", start=2), unit("c-d", start=3), unit("e-f", start=4)]
    want = {("src", "a<b>"), ("src", "c-d")}
    for limit in (100, 1):
        monkeypatch.setattr(edges, "ODD_WORDS", limit)
        got = {(s.rsplit(":", 1)[1], t.rsplit(":", 1)[1]) for s, t, _ in triples(edges.call_edges(make_units(rows)))}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_import_texts_resolve_as_by_trying_every_file(spark, make_units, seed):
    """Paths with long common beginnings, texts of any length, dotted ones at the end."""
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choices("ab/é.", k=k))
    files = sorted({f"{piece(rng.randrange(3))}{'aab/' * rng.randrange(4)}{piece(rng.randrange(1, 12))}" for _ in range(60)} - {""})
    texts = sorted({piece(rng.randrange(1, 7)) for _ in range(150)} | {"", "b.a", "a.b.a", "nowhere"})
    units = make_units([unit("u", path=f) for f in files])
    asked = spark.createDataFrame([(t,) for t in texts], "path string")
    got = {r.path: r.by_path for r in edges.resolve_imports(asked, units).collect()}
    want = {t: next((f"{f}:u" for f in files if t and (t in f or f.endswith("/" + t.replace(".", "/")))), None) for t in texts}
    assert got == want
    plan = edges.resolve_imports(asked, units)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(file_path" not in plan and "Join" in plan  # only equalities: work does not grow with texts times files


def test_implements(make_units):
    body = "class Inner(Base, pkg.Shape): pass\n implements Reader.Sub, Writer\n extends Closer {"
    faces = ["Shape", "Reader", "Writer", "Closer", "Base", "Inner", "Clos"]
    units = make_units([unit("C", body, "CLASS")] + [unit(n, "", "INTERFACE", start=i + 2) for i, n in enumerate(faces)])
    assert {t.split(":")[1] for _, t, _ in triples(edges.implement_edges(units))} == {"Shape", "Reader", "Closer", "Base"}


def test_imports_equal_trying_every_file(make_units):
    body = "import alpha\nfrom pkg.beta import q\nrequire('x/y')\nimport \"li\"\nfrom a.gamma import z\nimport zz\nfrom q.helper import r"
    rows = [unit("main", body, path="m/main.py"), unit("one", path="lib/alpha.py"), unit("two", path="lib/pkg/beta"), unit("three", path="w/x/y.ts"), unit("four", path="aa/gamma.py"), unit("helper", path="zz9/u.py")]
    files = {}
    for r in rows:
        files.setdefault(r[0].split(":")[0], r[0])
    want = set()
    for text in ["alpha", "pkg.beta", "x/y", "li", "a.gamma", "zz", "q.helper", "q", "z", "r"]:
        hit = [files[f] for f in sorted(files) if text in f or f.endswith("/" + text.replace(".", "/"))]
        named = [r[0] for r in sorted(rows) if r[0].endswith(":" + text.split(".")[-1])]
        if hit or named:
            want.add(("m/main.py:main", (hit or named)[0], "IMPORTS"))
    assert triples(edges.import_edges(make_units(rows))) == want
    near = make_units([unit("main", "import a\nfrom x.util import k"), unit("util", start=5), unit("util", path="b/c.py")])
    assert triples(edges.import_edges(near, scope="file")) == {("src/a.py:main", "src/a.py:main", "IMPORTS"), ("src/a.py:main", "src/a.py:util", "IMPORTS")}


def test_all_edges_are_a_set(make_units):
    units = make_units([unit("f", "g()\nimport a"), unit("g", start=5)])
    rows = [tuple(r) for r in edges.build_edges(units).collect()]
    assert len(rows) == len(set(rows)) and ("src/a.py", "src/a.py:f", "DEFINES") in rows and ("src/a.py:f", "src/a.py:g", "CALLS") in rows


# Lookup and search


def test_substring_is_literal_unless_asked(make_units):
    units = make_units([unit("get_user"), unit("getXuser", start=3)])
    assert lookup.search_substring(units, "get_user").count() == 1
    assert lookup.search_substring(units, "get_user", compat_like=True).count() == 2
    assert lookup.search_substring(units, "get", limit=1).first().name == "get_user"
    assert lookup.search_substring(units, "get", file_path="other.py").count() == 0


def test_lookups(spark, make_units):
    units = make_units([unit("Run", path="b.py"), unit("run", path="c.py"), unit("runner", path="a.py")])
    asked = spark.createDataFrame([(1, "run"), (2, "RUN"), (3, "none"), (4, " ")], "query_id int, name string")
    assert {r.query_id: r.id for r in lookup.lookup_exact(units, asked).collect()} == {1: "c.py:run", 2: "b.py:Run"}
    some = spark.createDataFrame([(1, "RUN"), (2, "runn"), (3, "")], "query_id int, prefix string")
    assert sorted((r.query_id, r.id) for r in lookup.lookup_prefix(units, some).collect()) == [(1, "a.py:runner"), (1, "b.py:Run"), (1, "c.py:run"), (2, "a.py:runner")]
    assert [r.id for r in lookup.lookup_pattern(units, "N+er$").collect()] == ["a.py:runner"]
    with pytest.raises(re.error):
        lookup.lookup_pattern(units, "(")


def test_lines(spark, make_units):
    units = make_units([unit("a", start=1, end=10), unit("b", start=20, end=30)])
    asked = spark.createDataFrame([(1, "src/a.py", 15), (2, "src/a.py", 25)], "query_id int, file_path string, line int")
    got = sorted((r.query_id, r.id, r.contains_line) for r in lookup.at_line(units, asked).collect())
    assert got == [(1, "src/a.py:a", False), (1, "src/a.py:b", False), (2, "src/a.py:b", True)]


def test_search_tiers_and_gate(spark, make_units):
    units = make_units([unit("getuser_all"), unit("getuser", start=2), unit("gotuser", start=3), unit("zzz", start=4)])
    asked = spark.createDataFrame([(1, "getuser")], "query_id int, query string")
    rows = {r.name: (r.match_score, r.match_type) for r in search.search(units, asked).collect()}
    assert rows == {"getuser": (1.0, "exact"), "getuser_all": (0.927, "prefix"), "gotuser": (0.857, "prefix")}
    assert {r.name for r in search.search(units, asked, limit=2).collect()} == {"getuser", "getuser_all"}


# Bundles


def small_repo(make_units, make_edges):
    units = make_units([unit("alpha", "beta()", doc="d"), unit("beta", "return 1", start=20, end=21), unit("gamma", "x" * 40, path="lib/b.py")])
    return units, make_edges([("src/a.py:alpha", "src/a.py:beta"), ("src/a.py:alpha", "lib/b.py:gamma"), ("src/a.py:alpha", "gone.py:x"), ("src/a.py:alpha", "src/a.py:alpha")])


def test_bundle(spark, make_units, make_edges):
    units, e = small_repo(make_units, make_edges)
    asked = spark.createDataFrame([(1, "explain `alpha`"), (2, "`nothing_here_qq`")], "query_id int, query string")
    rows = context.build_context(units, e, asked, fuzzy=False)
    assert {(r.section, r.id, r.body) for r in rows.collect()} == {("focal", "src/a.py:alpha", "beta()"), ("dependency", "src/a.py:beta", None), ("dependency", "lib/b.py:gamma", None)}
    head = {r.query_id: r for r in context.bundle_header(asked, rows).collect()}
    chars = len("def alpha()") + len("beta()") + 1 + len("def beta()") + len("def gamma()")
    assert (head[1].n_focal, head[1].n_dependencies, head[1].total_tokens, head[1].root) == (1, 2, chars // 4, "src")
    assert (head[2].n_focal, head[2].total_tokens, head[2].root) == (0, 0, None)
    text = {r.query_id: r.text for r in context.context_text(asked, rows).collect()}
    assert text[1].split("\n")[-4:-3] == ["- `lib/b.py:gamma` (FUNCTION) at lib/b.py:1"] and "Modules: lib, src" in text[1]
    assert text[2] == "# Context for: `nothing_here_qq`\n\n\n---\nTokens: 0 | Focal: 0 | Deps: 0"
    assert context.focal_code(rows).first().code == '# src/a.py:1\ndef alpha()\n"""d"""\nbeta()\n'
    held = context.build_context(units, e, asked, BuildConfig(enforce_budget=True), fuzzy=False)
    assert {r.tier for r in held.collect()} == {"full"}


def test_requests_out_of_bounds(spark):
    asked = spark.createDataFrame([(1, "ok"), (2, ""), (3, "  "), (4, "x" * 1001), (5, None)], "query_id int, query string")
    assert {r.query_id for r in context.valid_requests(asked).collect()} == {1}
    assert {r.query_id for r in context.rejected_requests(asked).collect()} == {2, 3, 4, 5}


def test_fuzzy_resolution_prefers_the_hinted_file(spark, make_units):
    units = make_units([unit("parse_url", path="a.py"), unit("parse_uri", path="b.py")])
    asked = spark.createDataFrame([("parse_ur", "b.py"), ("parse_ur", None), ("PARSE_URL", None)], "name string, file_hint string")
    got = {(r.name, r.file_hint): r.unit_id for r in context.resolve_names(units, asked).collect()}
    assert got == {("parse_ur", "b.py"): "b.py:parse_uri", ("parse_ur", None): "b.py:parse_uri", ("PARSE_URL", None): "a.py:parse_url"}


def test_context_for_file_and_unknown_dependencies(spark, make_units, make_edges):
    units, e = small_repo(make_units, make_edges)
    one = context.context_for_file(units, e, "src/a.py", "missing")
    assert [r.id for r in one.filter("section = 'focal'").collect()] == ["src/a.py:alpha"]
    assert context.context_for_file(units, e, "src/a.py").filter("section = 'focal'").count() == 2
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, name string")
    got = {(r.id, r.unit_kind, r.line) for r in context.expand_dependencies(units, e, asked).collect()}
    assert got == {("src/a.py:beta", "FUNCTION", 20), ("lib/b.py:gamma", "FUNCTION", 1), ("gone.py:x", "unknown", 0)}


def test_request_front(make_units, make_edges):
    ix = front.CodeIndex(*small_repo(make_units, make_edges))
    assert {t["name"] for t in front.list_tools()} == {"search_symbol", "get_symbol_context", "expand_dependencies", "get_repo_map", "build_context"}
    assert front.call(ix, "search_symbol", {"query": "alpha", "limit": 3}).first().unit_id == "src/a.py:alpha"
    assert front.call(ix, "get_symbol_context", {"symbol_name": "alpha"}).count() == 3
    assert front.call(ix, "get_repo_map").count() == 3
    assert '"text":"# Context for: `beta`' in front.call_json(ix, "build_context", {"query": "`beta`"}).first().json
    assert [d.count() for d in front.call_batch(ix, [("expand_dependencies", {"symbol_name": "alpha"})])] == [3]
    for bad in [("nope", {}), ("search_symbol", {"query": ""}), ("expand_dependencies", {"symbol_name": "a", "depth": 4}), ("get_repo_map", {"x": 1})]:
        with pytest.raises(ValueError):
            front.call(ix, *bad)
    ix.invalidate()


# Index


def test_upsert_and_delete(spark, make_units, make_edges):
    units = make_units([unit("f"), unit("g", path="b.py")])
    newer = make_units([unit("f", sig="first"), unit("f", sig="second"), unit("h", path="c.py")])
    got = index.upsert_units(units, newer, F.when(F.col("signature") == "second", 2).otherwise(1))
    assert {r.id: r.signature for r in got.collect()} == {"src/a.py:f": "second", "b.py:g": "def g()", "c.py:h": "def h()"}
    gone = spark.createDataFrame([("b.py",)], "path string")
    assert {r.id for r in index.delete_files(units, gone).collect()} == {"src/a.py:f"}
    e = make_edges([("src/a.py:f", "b.py:g"), ("b.py", "b.py:g", "DEFINES"), ("src/a.py:f", "x")])
    assert {r.target_id for r in index.delete_edges_of_files(e, units, gone).collect()} == {"x"}
    assert index.upsert_edges(e, e).count() == 3
    with pytest.raises(Exception, match="unknown edge type"):
        index.upsert_edges(e, make_edges([("a", "b", "LIKES")])).collect()
    assert index.index_status(units).first().status == "ready"
    empty = index.index_status(units.limit(0)).first()
    assert (empty.status, empty.n_units) == ("empty", 0)


def test_changes_are_applied(spark):
    schema = "path string, content string"
    old = spark.createDataFrame([("a.py", "def f():\n    g()\n\ndef g():\n    pass\n"), ("b.py", "def h():\n    f()\n")], schema)
    units, found = index.build_index(old)
    assert ("b.py:h", "a.py:f", "CALLS") in triples(found)
    actions = spark.createDataFrame([("a.py", "index"), ("b.py", "remove")], "path string, action string")
    new = spark.createDataFrame([("a.py", "def f():\n    k()\n\ndef k():\n    f()\n"), ("b.py", "x")], schema)
    for scope in ("repo", "file"):
        after, edges_after = index.apply_changes(units, found, actions, new, scope)
        assert {r.id for r in after.collect()} == {"a.py:f", "a.py:k"}
        want = {("a.py", "a.py:f", "DEFINES"), ("a.py", "a.py:k", "DEFINES"), ("a.py:f", "a.py:k", "CALLS"), ("a.py:k", "a.py:f", "CALLS")}
        assert triples(edges_after) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_an_update_equals_a_new_build(spark, make_units, seed):
    """Files that go, come and change: names, bases and imports that other files then find elsewhere."""
    rng = random.Random(seed)
    names = ["f", "g", "Big", "K.run", "I", "J", "~odd", "über"]
    paths = ["a/util.py", "a/core.py", "b/util.py", "b/x.py", "c/deep/util.py", "m.py"]

    def units_of(path):
        out = []
        for name in rng.sample(names, rng.randrange(1, 5)):
            kind = "INTERFACE" if name in "IJ" else rng.choice(["CLASS", "FUNCTION"])
            words = [f"{rng.choice(names)} (1)", f"K.{rng.choice(names)}(2)", f"class Q({rng.choice('IJ')}, x.J):", f"extends {rng.choice('IJ')}.z",
                     f"import {rng.choice(['util', 'core', 'f', 'x', 'deep'])}", f"from {rng.choice(['a.util', 'deep.util', '.', 'c', 'zz.g'])} import y"]
            out.append((f"{path}:{name}", kind, rng.randrange(50), 60, "sig", "\n".join(rng.sample(words, 4)), None))
        return out

    before = {p: units_of(p) for p in paths[:5]}
    changed = {p: units_of(p) for p in rng.sample(paths, 3)}
    gone = set(rng.sample(paths, 2)) - set(changed)
    after = {p: u for p, u in (before | changed).items() if p not in gone}
    old, new = (make_units([u for us in x.values() for u in us]) for x in (before, after))
    fresh = make_units([u for us in changed.values() for u in us])
    touched = spark.createDataFrame([(p,) for p in {*changed, *gone}], "path string")
    units, found, refs = index.replace_units(old, edges.build_edges(old), edges.references(old), touched, fresh)
    assert sorted(r.id for r in units.collect()) == sorted(r.id for r in new.collect())
    assert triples(found) == triples(edges.build_edges(new))
    assert sorted(map(tuple, refs.collect())) == sorted(map(tuple, edges.references(new).collect()))
    assert found.count() == len(triples(found))


PY = "import os\n\nclass A(B):\n    '''Doc é.'''\n\n    @prop\n    def m(self):\n        return f(1)\n\ndef f(x):\n    def inner():\n        pass\n    return inner\n"


def kinds(content, path, language):
    return {(r[0].rsplit(":", 1)[1], r[1], r[5], r[6]) for r in extract.file_units(path, content, language)}


def test_extract_python():
    assert kinds(PY, "a.py", "python") == {("A", "CLASS", 3, 8), ("A.m", "METHOD", 7, 8), ("f", "FUNCTION", 10, 13), ("inner", "FUNCTION", 11, 12)}
    rows = {r[0]: r for r in extract.file_units("d\\a.py", PY, "python")}
    cls = rows["d/a.py:A"]
    assert cls[7] == "class A(B):" and cls[9] == "Doc é." and cls[8].startswith("'''Doc")
    assert PY.encode()[cls[3] : cls[4]].decode().startswith("class A")
    assert kinds(PY + "def broken(:\n    x\n", "a.py", "python") >= {("A", "CLASS", 3, 8), ("A.m", "METHOD", 7, 8), ("broken", "FUNCTION", 14, 15)}


def test_extract_braces():
    ts = "export class Foo extends Bar {\n  private x = '}'\n  run(a: number): void {\n    if (a) { go() }\n  }\n}\ninterface I {\n  f(): void\n}\nexport const arrow = (a) => {\n  return a\n}\nasync function load() {\n}\n"
    assert kinds(ts, "a.ts", "typescript") == {("Foo", "CLASS", 1, 6), ("Foo.run", "METHOD", 3, 5), ("I", "INTERFACE", 7, 9), ("arrow", "FUNCTION", 10, 12), ("load", "FUNCTION", 13, 14)}
    go = "package p\n\ntype S struct {\n\tA int\n}\n\nfunc (s *S) M(a int) int {\n\treturn a // }\n}\n\nfunc Main() {\n}\n\ntype R interface {\n\tX()\n}\n"
    assert kinds(go, "a.go", "go") == {("S", "CLASS", 3, 5), ("S.M", "METHOD", 7, 9), ("Main", "FUNCTION", 11, 12), ("R", "INTERFACE", 14, 16)}
    rs = "pub struct P {\n  x: i32,\n}\nimpl P {\n  pub fn get(&self) -> i32 {\n    self.x\n  }\n}\nfn main() {\n}\n"
    assert kinds(rs, "a.rs", "rust") == {("P", "CLASS", 1, 3), ("P.get", "METHOD", 5, 7), ("main", "FUNCTION", 9, 10)}
    java = "public class K {\n  public int size() {\n    return 1;\n  }\n}\n"
    assert kinds(java, "K.java", "java") == {("K", "CLASS", 1, 5), ("K.size", "METHOD", 2, 4)}


def test_constructs(spark):
    files = spark.createDataFrame([("a.py", "python", "@dec\ndef f():\n    global g\n    x += 1\n    y = lambda a: a\n"), ("b.go", "go", "package p\nfunc init() {\n}\ntype S struct {\n")], "path string, language string, content string")
    got = {(r.path, r.construct, r.line, r.text) for r in extract.find_constructs(files).collect()}
    assert {("a.py", "decorator", 1, "dec"), ("a.py", "global", 3, "g"), ("a.py", "augmented_assignment", 4, "x"), ("a.py", "lambda", 5, "lambda a:"), ("b.go", "package", 1, "p"), ("b.go", "init_function", 2, "init"), ("b.go", "struct", 4, "S")} <= got


def test_constructs_over_lines_and_in_strings():
    def hits(text, language, *kinds):
        return [(k, line, x) for k, line, x in extract.constructs_of(text, language) if not kinds or k in kinds]

    py = "from a import (\n    b,  # import no\n    c,\n)\nx = 1; y = 2; z += 3\nf(\n    kw=1,\n)\n\"\"\"\nimport hidden\n\"\"\"\nif x: import os\nimport p, \\\n    q\nd = {\"k\": lambda v: v, \"l\": lambda: 0}\n"
    assert hits(py, "python", "import") == [("import", 1, "from a import (\n    b,  # import no\n    c,\n)"), ("import", 12, "import os"), ("import", 13, "import p, \\\n    q")]
    assert [h[1:] for h in hits(py, "python", "assignment")] == [(5, "x"), (5, "y"), (15, "d")]
    assert hits(py, "python", "augmented_assignment", "lambda") == [("augmented_assignment", 5, "z"), ("lambda", 15, "lambda v:"), ("lambda", 15, "lambda:")]
    go = "type (\n\tA[T any] struct{ x T }\n\tB = int\n)\nconst C = \"import (\"\nvar (\n\td = g(\n\t\t1,\n\t)\n\te int; f int\n)\n"
    assert [h[:2] + (h[2],) for h in hits(go, "go")] == [("type_alias", 2, "A"), ("struct", 2, "A"), ("type_alias", 3, "B"), ("const", 5, "C"), ("var", 7, "d"), ("var", 10, "e"), ("var", 10, "f")]
    ts = "import a from 'x' // import b\nimport('y')\nconst s = `class No ${1}`\nexport {\n  u,\n}\n"
    assert hits(ts, "typescript", "import", "class", "export") == [("import", 1, "import a from 'x'"), ("export", 4, "export {\n  u,\n}")]
    for language in extract.CONSTRUCTS:
        assert extract.constructs_of("", language) == []
        for broken in (")]}", "import (", "const (", "\"\"\"", "type", "((((" * 5_000, "x" * 200_000):
            extract.constructs_of(broken, language)


def test_scan_and_index(spark, tmp_path):
    (tmp_path / "pkg" / "node_modules").mkdir(parents=True)
    for name, text in {"pkg/__init__.py": "def top():\n    helper()\n", "pkg/b.py": "def helper():\n    pass\n", "pkg/node_modules/x.js": "function no() {}", "pkg/empty.py": "", "pkg/gen_1.py": "def gen(): pass", "pkg/note.txt": "hello", ".gitignore": "gen_*\n!gen_1.py\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "pkg/b.py")
    files = scan.scan(spark, str(tmp_path))
    assert {r.relative_path: r.language for r in files.collect()} == {"pkg/__init__.py": "python", "pkg/b.py": "python", "pkg/note.txt": "unknown"}
    stats = scan.scan_stats(files).first()
    assert stats.total_files == 3 and stats.files_by_language == {"python": 2, "unknown": 1}
    units, found = index.build_index(scan.with_content(files))
    assert {r.id.rsplit(":", 1)[1] for r in units.collect()} == {"top", "helper"}
    base = str(tmp_path / "pkg")
    assert (f"{base}/__init__.py:top", f"{base}/b.py:helper", "CALLS") in triples(found)
    assert {r.language for r in scan.languages_present(files).collect()} == {"python"}
    with_hidden = scan.scan(spark, str(tmp_path), ignore=[], respect_gitignore=False)
    assert with_hidden.count() == 6


def test_index_report(spark, tmp_path):
    rows = [("a.py", "def f():\n    g()\n", 1.5e9), ("b.py", "def g():\n    pass\n", 1.6e9), ("bad.py", "def h(): pass", 1.7e9), ("c.txt", "text", 0.0), ("d.py", "", None), ("e.py", None, None)]
    files = spark.createDataFrame(rows, "path string, content string, at double").withColumn("last_modified", F.col("at").cast("timestamp")).drop("at")

    def read(path, content, language):
        if path == "bad.py":
            raise ValueError("no good")
        return extract.file_units(path, content, language)

    done = index.run_index(files, str(tmp_path / "u"), str(tmp_path / "e"), read=read)
    assert (done.n_files, done.n_units, done.n_failed) == (3, 2, 1) and done.seconds > 0
    assert [tuple(r) for r in done.failed.collect()] == [("bad.py", "ValueError: no good")]
    written = spark.read.parquet(str(tmp_path / "u")), spark.read.parquet(str(tmp_path / "e"))
    again = index.build_index(files.filter("path <> 'bad.py'"))
    for a, b in zip(written, again):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)
    assert done.n_edges == written[1].count() > 0
    table = {r.path: (r.last_modified, r.language, r.indexed_at) for r in done.files.collect()}
    assert set(table) == {"a.py", "b.py", "d.py"} and table["a.py"][0] < table["b.py"][0] < table["b.py"][2] and table["d.py"][0] is None
    assert done.files.columns == ["path", "last_modified", "language", "indexed_at"]
    nothing = index.run_index(files.limit(0), str(tmp_path / "u0"), str(tmp_path / "e0"))
    assert (nothing.n_files, nothing.n_units, nothing.n_edges, nothing.n_failed) == (0, 0, 0, 0)


def test_config(tmp_path):
    assert config.load_config(project_root=str(tmp_path)).max_file_size == 1_048_576
    config.save_config(config.IndexConfig(languages=["go"], project_root=str(tmp_path), log_level="debug"))
    loaded = config.load_config(project_root=str(tmp_path))
    assert (loaded.languages, loaded.log_level) == (["go"], "DEBUG")
    for bad in [{"languages": []}, {"languages": ["cobol"]}, {"log_level": "loud"}, {"max_file_size": 1}]:
        with pytest.raises(ValueError):
            config.IndexConfig(**bad)


def test_files_are_read_in_bounded_pieces(spark, monkeypatch):
    """A worker hands on what it read every few rows or characters, however many files a batch has."""
    text = "".join(f"def f{i}():\n    x = {i}\n" for i in range(40))
    files = spark.createDataFrame([(f"a{i}.py", text, "python") for i in range(30)], "path string, content string, language string").coalesce(1)
    want = {(f"a{i}.py", kind, 2 * j + 1) for i in range(30) for j in range(40) for kind in ["function"]}
    for rows, chars in ((7, 10**9), (10**9, 100), (4096, 10**6)):
        monkeypatch.setattr(extract, "ROWS_AT_ONCE", rows)
        monkeypatch.setattr(extract, "CHARS_AT_ONCE", chars)
        found = extract.find_constructs(files)
        assert {tuple(r) for r in found.select("path", "construct", "line").collect() if r.construct == "function"} == want
        assert found.count() == 2 * extract.extract_units(files).count() == 2400
        assert extract.extract_outcomes(files).filter("outcome = 'indexed'").count() == 30
    assert extract.extract_units(files.limit(0)).count() == 0


def test_rows_held_at_a_time(spark, monkeypatch):
    """What one batch of many files gives leaves the worker in pieces of at most so many rows."""
    monkeypatch.setattr(extract, "ROWS_AT_ONCE", 50)
    files = spark.createDataFrame([("a.py", "", "python")], "path string, content string, language string")
    caught = []
    monkeypatch.setattr(type(files.filter("true")), "mapInArrow", lambda self, scan, schema: caught.append(scan) or self)
    extract.find_constructs(files)
    batch = pa.RecordBatch.from_pydict({"path": [f"a{i}.py" for i in range(20)], "content": ["x = 1\n" * 30] * 20, "language": ["python"] * 20})
    out = [b.num_rows for b in caught[0](iter([batch]))]
    assert sum(out) == 600 and max(out) == 50


@pytest.mark.parametrize("scope", ["repo", "file"])
def test_calls_are_made_distinct_where_they_were_joined(spark, make_units, scope):
    units = make_units([
        ("a.py:f", "FUNCTION", 1, 2, "", "g(1) x.g(2) T.m() f() .g()", None),
        ("a.py:f", "FUNCTION", 1, 2, "", "g(1)", None),
        ("a.py:g", "FUNCTION", 3, 4, "", "require('x')", None),
        ("b.py:g", "FUNCTION", 1, 2, "", "", None),
        ("b.py:T.m", "METHOD", 1, 2, "", "T.m()", None),
    ])
    found = edges.call_edges(units, scope)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # words and names, and nothing after their join
    want = {("a.py:f", "a.py:g")} | ({("a.py:f", "b.py:g"), ("a.py:f", "b.py:T.m")} if scope == "repo" else set())
    assert sorted((r.source_id, r.target_id) for r in found.collect()) == sorted(want)


def test_call_words_equal_cutting_every_run(spark):
    """The pieces of a run are found by one search, and give the words that cutting the runs gave."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b1", "_", ".", "$", " ", "(", ")", "\n", "é", "\u0301", "=", "\U0001d4d0"]) for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "a.b$c (x) ..d(", None]], "text string")
    text = F.col("text")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)({edges.RUN})\s*\("), F.lit(1)))
    cut_up = F.array_distinct(F.flatten(F.transform(runs, edges._suffixes)))
    got = rows.select(
        F.array_sort(edges._call_words(text)).alias("words"), F.array_sort(cut_up).alias("want"),
        F.array_sort(edges._call_words(text, plain=True)).alias("plain"), F.array_sort(F.filter(cut_up, lambda w: w.rlike(edges.PLAIN))).alias("want_plain"),
    ).collect()
    assert all(r.words == r.want and r.plain == r.want_plain for r in got) and any(len(r.want or ()) > 3 for r in got)


def test_what_is_kept_is_found_once(spark, make_units, monkeypatch):
    """Changes read the units and the import texts after them from tables: neither is joined with the changed files again for each use."""
    tags = []
    monkeypatch.setattr(edges, "cut", lambda df, tag, cut=edges.cut: tags.append(tag) or cut(df, tag))
    units = make_units([unit(f"f{i}", f"f{(i * 7) % 20}(x)\nimport f{i % 5}", path=f"src/m{i % 6}.py") for i in range(20)])
    touched = spark.createDataFrame([("src/m1.py",), ("src/m2.py",)], "path string")
    fresh = make_units([unit("f1", "f3(y)", path="src/m1.py"), unit("g", "f4(y)", path="src/m1.py")])
    after, changed, refs = index.replace_units(units, edges.build_edges(units), edges.references(units), touched, fresh)
    assert tags.count("import-refs") == tags.count("units-after") == 1
    assert triples(changed) == triples(edges.build_edges(after))
    assert sorted(map(tuple, refs.collect())) == sorted(map(tuple, edges.references(after).select(*refs.columns).collect()))


def test_edges_of_all_types_are_not_shuffled_together(make_units):
    """Each type is a set already; repeated units and texts that name a callee twice give no edge twice."""
    rows = [unit("f", "g(x) a.g(y) import lib\nfrom lib import g"), unit("g", "f(1)\nimport a"), unit("I", kind="INTERFACE"), unit("C", "class C implements I, extends I", kind="CLASS")]
    found = edges.build_edges(make_units([*rows, *rows]))
    listed = [tuple(r) for r in found.collect()]
    assert len(listed) == len(set(listed)) and {r[2] for r in listed} == {"CALLS", "DEFINES", "IMPLEMENTS", "IMPORTS"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")
