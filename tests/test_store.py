import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kodagraf.operators import index, stored
from kodagraf.sources import scan
from kodagraf.sources.store import Conflict, Part, Store, Whole
from kodagraf.streaming import changes
from kodagraf.streaming.listing import ListingSource, listing_changes

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int").repartition(3)


def pairs(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_a_reader_sees_one_version_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.snapshot().number == 0
    first = [(f"k{i % 40}", i) for i in range(200)]
    one = store.commit({"a": Whole(table(spark, first), "k", 8), "b": Whole(table(spark, [("x", 1)]), "k", 8)}, {"n": 1})
    before = store.read("a", one)
    two = store.commit({"a": Part(table(spark, [("k3", -1), ("new", -2)]), table(spark, [("k3", 0), ("k4", 0)]).select("k"))}, {"m": 2})
    want = sorted([(k, v) for k, v in first if k not in ("k3", "k4")] + [("k3", -1), ("new", -2)])
    assert pairs(store.read("a")) == want and pairs(before) == sorted(first) and pairs(store.read("b")) == [("x", 1)]
    assert (two.number, two.note) == (2, {"n": 1, "m": 2})
    moved = [b for b, f in one.tables["a"]["folders"].items() if two.tables["a"]["folders"].get(b) != f]
    assert 0 < len(moved) < len(one.tables["a"]["folders"])  # the other buckets were not written
    assert two.tables["b"] == one.tables["b"]
    store.compact("a")
    assert pairs(store.read("a")) == want
    store.clean(keep=1)
    assert store.numbers() == [3] and pairs(store.read("a")) == want and pairs(store.read("b")) == [("x", 1)]
    assert not (tmp_path / "s" / "data" / one.tables["a"]["folders"]["0"]).exists()


def test_lost_and_competing_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    base = store.commit({"a": Whole(table(spark, [("x", 1)]), "k")})
    store.commit({"a": Whole(table(spark, [("x", 2)]), "k")}, at=base)
    with pytest.raises(Conflict):
        store.commit({"a": Whole(table(spark, [("x", 3)]), "k")}, at=base)
    assert pairs(store.read("a")) == [("x", 2)]
    (tmp_path / "s" / "versions" / "000000000003.json").write_text('{"tables": {"a"')  # a writer lost in its last step
    assert store.snapshot().number == 2
    assert store.commit({"a": Part(table(spark, []), table(spark, [("x", 0)]).select("k"))}).number == 4
    assert pairs(store.read("a")) == [] and store.read("a").columns == ["k", "v"]
    store.clean(keep=1)
    assert store.commit({"a": Whole(table(spark, [("y", 1)]), "k")}).number == 5 and pairs(store.read("a")) == [("y", 1)]


def listed(spark, rows):
    full = [(p, s, T0 + timedelta(seconds=t)) for p, s, t in rows]
    return spark.createDataFrame(full, "path string, size_bytes long, last_modified timestamp")


def seen(df):
    return sorted((r.path, r.change_type, r.dest_path) for r in df.collect())


def test_changes_between_listings(spark):
    before = listed(spark, [("same", 1, 1), ("size", 1, 1), ("time", 1, 1), ("old", 5, 5), ("gone", 6, 6), ("t1", 7, 7), ("t2", 7, 7)])
    after = listed(spark, [("same", 1, 1), ("size", 2, 1), ("time", 1, 2), ("new", 5, 5), ("made", 8, 8), ("t3", 7, 7)])
    got = listing_changes(before, after, F.lit("2024-01-02"))
    assert seen(got) == [
        ("gone", "deleted", None), ("made", "created", None), ("old", "moved", "new"), ("size", "modified", None),
        ("t1", "deleted", None), ("t2", "deleted", None), ("t3", "created", None), ("time", "modified", None),
    ]
    assert seen(listing_changes(before, before, F.lit("2024-01-02"))) == []
    assert {x[1] for x in seen(listing_changes(before.limit(0), after, F.lit("2024-01-02")))} == {"created"}


def test_listing_source_after_lost_polls(spark, tmp_path, monkeypatch):
    source, out = ListingSource(spark, str(tmp_path / "src")), []

    def follow():
        def keep(batch, _):
            out.extend((r.path, r.change_type, r.ts.isoformat()[:10]) for r in batch.collect())

        query = source.changes().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()

    follow()
    source.poll(listed(spark, [("a", 1, 1), ("b", 1, 2)]), T0)
    follow()
    monkeypatch.setattr(ListingSource, "_publish", lambda self: None)  # the second poll is lost after its listing was stored
    source.poll(listed(spark, [("a", 1, 1), ("b", 2, 2)]), T0 + timedelta(days=1))
    monkeypatch.undo()
    (tmp_path / "src" / "listings" / "versions" / "000000000003.json").write_text("{")  # and the third before it was stored
    follow()
    assert len(out) == 2
    source = ListingSource(spark, str(tmp_path / "src"))
    source.poll(listed(spark, [("b", 2, 2)]), T0 + timedelta(days=2))
    follow()
    follow()
    assert sorted(out) == [
        ("a", "created", "2024-01-01"), ("a", "deleted", "2024-01-03"), ("b", "created", "2024-01-01"), ("b", "modified", "2024-01-02"),
    ]


def test_a_watched_tree_keeps_its_index(spark, tmp_path):
    tree = tmp_path / "repo"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "a.py").write_text("def f():\n    return g()\n")
    (tree / "pkg" / "b.py").write_text("def g():\n    return 1\n")
    source, store = ListingSource(spark, str(tmp_path / "src")), Store(spark, str(tmp_path / "index"))
    stored.store_units(store, *(spark.createDataFrame([], s) for s in (index.CODE_UNITS, index.FILES)))

    def read(actions):
        return scan.with_content(scan.scan(spark, str(tree)).join(actions.select("path"), "path", "left_semi"))

    def step():
        source.poll(scan.scan(spark, str(tree)))
        query = stored.start_updating(source.changes(), store, read, str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        units, edges = index.build_index(scan.with_content(scan.scan(spark, str(tree))))
        for name, want in (("units", units), ("edges", edges)):
            assert sorted(map(tuple, store.read(name).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert {r.path for r in store.read("files").collect()} == {r.file_path for r in units.collect()}
        assert store.read("files").filter("last_modified IS NULL OR indexed_at IS NULL").count() == 0

    step()
    (tree / "pkg" / "c.py").write_text("def h():\n    return f()\n")
    shutil.move(tree / "pkg" / "b.py", tree / "pkg" / "d.py")
    (tree / "pkg" / "a.py").unlink()
    step()
    number = store.snapshot().number
    shutil.rmtree(tmp_path / "state" / "commits")  # the last batch is run again
    stored.start_updating(source.changes(), store, read, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert store.snapshot().number == number
