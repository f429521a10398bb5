from datetime import UTC, datetime, timedelta

from kodagraf.schema import CHANGES
from kodagraf.streaming import changes

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def events(spark, rows):
    full = [(p, c, T0 + timedelta(microseconds=us), False, dest) for p, c, us, dest in rows]
    return spark.createDataFrame(full, CHANGES)


def test_a_gap_of_exactly_the_delay_joins(spark):
    df = events(spark, [("a", "modified", 0, None), ("a", "modified", 500_000, None), ("a", "modified", 1_000_001, None)])
    assert sorted(r.n_events for r in changes.debounce(df).collect()) == [1, 2]


def test_created_and_deleted_in_one_burst(spark):
    df = events(spark, [("a", "created", 0, None), ("a", "modified", 1000, None), ("a", "deleted", 2000, None), ("b", "deleted", 0, None)])
    assert {r.path: r.change_type for r in changes.debounce(df).collect()} == {"a": "created", "b": "deleted"}
    assert {r.path: r.change_type for r in changes.debounce(df, final_state=True).collect()} == {"a": "deleted", "b": "deleted"}


def test_routes(spark):
    df = events(spark, [("a", "created", 0, None), ("a", "deleted", 5, None), ("b", "moved", 0, "c"), ("d", "modified", 0, None)])
    assert {r.path: r.action for r in changes.route(df).collect()} == {"a": "remove", "b": "remove", "c": "index", "d": "index"}
    assert "c" not in {r.path for r in changes.route(df, follow_moves=False).collect()}
    kept = changes.watched(df, ["b", "d"])
    assert {r.path for r in kept.collect()} == {"a", "b"}


def test_stream_hands_over_actions_once(spark, tmp_path):
    source = str(tmp_path / "in")
    events(spark, [("a", "created", 0, None), ("b", "deleted", 0, None)]).write.parquet(source)
    seen = []

    def apply(actions, batch_id):
        seen.extend((r.path, r.action) for r in actions.collect())

    for _ in range(2):
        stream = spark.readStream.schema(CHANGES).parquet(source)
        changes.start_indexing(stream, apply, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert sorted(seen) == [("a", "index"), ("b", "remove")]
    assert changes.latest_per_path(events(spark, [("a", "created", 0, None), ("a", "deleted", 1, None)])).first().change_type == "deleted"


def test_appended_bursts_leave_the_state(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    second = 1_000_000
    batches = [
        [(f"p{i}", "created", i * 1000, None) for i in range(20)] + [("p0", "deleted", 200_000, None)],
        [("q", "modified", 60 * second, None)],
        [("p1", "modified", 5 * second, None), ("q", "modified", 60 * second + 400_000, None)],
        [("r", "modified", 200 * second, None)],
    ]
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).parquet(source)
        query = changes.start_debouncing(stream, target, str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert held == [20, 1, 1, 1][i]  # open bursts only, however many went through
        assert changes.late_changes(query) == (1 if i == 2 else 0)
    got = {(r.path, r.change_type, r.n_events) for r in spark.read.parquet(target).collect()}
    assert got == {("p0", "created", 2), *((f"p{i}", "created", 1) for i in range(1, 20)), ("q", "modified", 2)}
