"""Debounced file changes, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kodagraf.functions.globs import event_ignored

GAP = "500 milliseconds"


def watched(changes: DataFrame, ignore: list[str]) -> DataFrame:
    """Changes of files that are not ignored; a move counts unless both of its ends are."""
    kept = ~event_ignored(F.col("path"), ignore)
    if "dest_path" in changes.columns:
        kept = kept | (F.col("dest_path").isNotNull() & ~event_ignored(F.col("dest_path"), ignore))
    return changes.filter(~F.col("is_directory") & kept)


def _burst_sums() -> list[Column]:
    """What a burst is judged by: its last change, creation and deletion, and its size."""
    at = F.struct("ts", "change_type")
    return [
        F.max(at).alias("_last"),
        F.max(F.when(F.col("change_type") == "created", at)).alias("_created"),
        F.max(F.when(F.col("change_type") == "deleted", at)).alias("_deleted"),
        F.count("*").alias("n_events"),
    ]


def _representatives(bursts: DataFrame, final_state: bool) -> DataFrame:
    """The last change of a burst; if it has both a creation and a deletion, the last creation.

    ``final_state`` takes the last change always. Of equal times the change type that
    sorts last is taken, so that the result does not depend on arrival.
    """
    pick = F.col("_last")
    if not final_state:
        pick = F.when(F.col("_deleted").isNotNull() & F.col("_created").isNotNull(), F.col("_created")).otherwise(pick)
    return bursts.withColumn("_p", pick).select("path", F.col("_p.change_type").alias("change_type"), F.col("_p.ts").alias("ts"), "n_events")


def debounce(changes: DataFrame, gap: str = GAP, final_state: bool = False) -> DataFrame:
    """(path, change_type, ts) -> one change per path and burst; bursts are more than ``gap`` apart.

    On a stream (with a watermark) this is a session window. On a batch the changes of a
    path are first summed in cells as long as the gap, which always belong to one burst:
    before the shuffle a path shrinks to a row per cell, however many changes it has.
    """
    if changes.isStreaming:
        windows = changes.groupBy("path", F.session_window("ts", gap).alias("_w")).agg(*_burst_sums())
        return _representatives(windows, final_state)
    width = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {gap})")
    at = F.unix_micros("ts")
    cells = changes.groupBy("path", F.floor(at / width).alias("_cell")).agg(
        *_burst_sums(), F.min(at).alias("_from"), F.max(at).alias("_to")
    )
    order = Window.partitionBy("path").orderBy("_cell")
    apart = F.col("_from") - F.lag("_to").over(order) > width
    marked = cells.withColumn("_new", F.when(apart, 1).otherwise(0))
    numbered = marked.withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bursts = numbered.groupBy("path", "_burst").agg(
        *[F.max(c).alias(c) for c in ("_last", "_created", "_deleted")], F.sum("n_events").alias("n_events")
    )
    return _representatives(bursts, final_state)


def debounce_stream(changes: DataFrame, gap: str = GAP, lateness: str = "10 seconds") -> DataFrame:
    """:func:`debounce` for a stream; changes later than ``lateness`` are dropped by the watermark."""
    return debounce(changes.withWatermark("ts", lateness), gap)


def start_debouncing(
    changes: DataFrame,
    target: str,
    checkpoint: str,
    gap: str = GAP,
    lateness: str = "10 seconds",
    trigger: str = "1 second",
    available_now: bool = False,
) -> StreamingQuery:
    """Append each burst to the Parquet folder ``target`` once, when the watermark has passed its end.

    A burst's state goes with it, so the state holds open bursts only. Bursts younger than ``lateness`` stay open
    until later changes come, of any path. Changes that come too late are dropped and counted by :func:`late_changes`.
    """
    writer = debounce_stream(changes, gap, lateness).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


def late_changes(query: StreamingQuery) -> int:
    """Sessions dropped as too late in the progress that the query still holds; changes of a path that came together are one."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def latest_per_path(changes: DataFrame) -> DataFrame:
    """One row per path, its last change."""
    last = changes.groupBy("path").agg(F.max(F.struct("ts", "change_type")).alias("_l"))
    return last.select("path", F.col("_l.change_type").alias("change_type"), F.col("_l.ts").alias("ts"))


def route(changes: DataFrame, follow_moves: bool = True) -> DataFrame:
    """(path, action): ``index`` for created and modified, ``remove`` for deleted and the old end of a move.

    The new end of a move is indexed, unless ``follow_moves`` is off. Of several actions
    for one path the latest counts.
    """
    action = F.when(F.col("change_type").isin("created", "modified"), "index").otherwise("remove")
    own = changes.select("path", "ts", action.alias("action"))
    if follow_moves and "dest_path" in changes.columns:
        moved = changes.filter((F.col("change_type") == "moved") & F.col("dest_path").isNotNull())
        own = own.unionByName(moved.select(F.col("dest_path").alias("path"), "ts", F.lit("index").alias("action")))
    last = own.groupBy("path").agg(F.max(F.struct("ts", "action")).alias("_l"))
    return last.select("path", F.col("_l.action").alias("action"))


def start_indexing(
    changes: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: str = "1 second",
    available_now: bool = False,
) -> StreamingQuery:
    """Route each micro-batch of changes and hand it to ``apply(actions, batch_id)``.

    A failing batch stops the query and is run again on restart, instead of being lost,
    so ``apply`` has to be idempotent: writing the rows of a file anew is.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        apply(route(batch), batch_id)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()
