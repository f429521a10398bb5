"""A stream of file changes out of successive listings of a tree.

Each listing is a version in a :class:`kodagraf.sources.store.Store`. The changes between two listings follow from the
stored listings alone, so a poll that was lost is finished by the next one with the same rows, and a stream that reads
them keeps its offsets in its own checkpoint.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kodagraf.schema import CHANGES
from kodagraf.sources.store import Store, Whole

LISTED = ["path", "size_bytes", "last_modified"]


def listing_changes(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """Changes, all of time ``at``, between two listings (path, size_bytes, last_modified) of distinct paths.

    A file is modified if its size or time differs. A path that is gone and a new one make a move if they alone have
    their size and time, which a rename keeps; where several have the same, they are deletions and creations.
    """
    old, new = (d.select("path", F.struct("size_bytes", "last_modified").alias(s)) for d, s in ((before, "_old"), (after, "_new")))
    both = old.join(new, "path", "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    own = F.coalesce("_old", "_new")
    one_sided = both.filter("_old IS NULL OR _new IS NULL")
    gone = F.col("_new").isNull()
    # Counts and a least path per (size, time) combine before the shuffle, however many files share them.
    pairs = (
        one_sided.groupBy(own.alias("_same"))
        .agg(
            F.count_if(gone).alias("_gone"),
            F.count_if(~gone).alias("_come"),
            F.min(F.when(gone, F.col("path"))).alias("path"),
            F.min(F.when(~gone, F.col("path"))).alias("dest_path"),
        )
        .filter("_gone = 1 AND _come = 1")
        .select("path", "dest_path")
    )
    ends = pairs.select(F.explode(F.array("path", "dest_path")).alias("path"))
    kind = F.when(gone, "deleted").when(F.col("_old").isNull(), "created").otherwise("modified")
    rest = both.join(ends, "path", "left_anti").select("path", kind.alias("change_type"), F.lit(None).cast("string").alias("dest_path"))
    rows = rest.unionByName(pairs.withColumn("change_type", F.lit("moved")))
    return rows.select("path", "change_type", at.cast("timestamp").alias("ts"), F.lit(False).alias("is_directory"), "dest_path")


class ListingSource:
    """Listings and their changes below ``root``, a folder that all executors share; one poll runs at a time.

    The changes of a poll become visible by the rename of a folder, so ``root`` needs a file system that renames at
    once, as streaming checkpoints do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, f"{self.root}/listings")

    def _published(self) -> int:
        done = [int(name) for name, _ in self.store.entries(f"{self.root}/changes")]
        return max(done, default=0)

    def _publish(self) -> None:
        published, last = self._published(), None
        for n in self.store.finished():
            last, previous = n, last
            if n <= published:
                continue
            at = self.store.snapshot(n)
            after = self.store.read("files", at)
            before = self.store.read("files", self.store.snapshot(previous)) if previous else after.limit(0)
            staged = f"{self.root}/staged/{uuid.uuid4().hex}"
            listing_changes(before, after, F.lit(at.note["listed_at"])).write.parquet(staged)
            fs, source = self.store.hadoop_path(staged)
            _, target = self.store.hadoop_path(f"{self.root}/changes/{n:012d}")
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise RuntimeError(f"changes of listing {n} could not be published")

    def poll(self, files: DataFrame, at: datetime | None = None) -> int:
        """Store a listing, publish what has changed since the one before, and return its number.

        The first listing creates every file. A listing whose poll was lost before its changes were published has them published first.
        """
        self._publish()
        note = {"listed_at": (at or datetime.now(UTC)).astimezone(UTC).isoformat()}
        made = self.store.commit({"files": Whole(files.select(*LISTED), "path")}, note)
        self._publish()
        self.store.clean()
        return made.number

    def changes(self, files_per_batch: int | None = None) -> DataFrame:
        """The published changes as a stream."""
        fs, path = self.store.hadoop_path(f"{self.root}/changes")
        fs.mkdirs(path)
        reader = self.spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true")
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(f"{self.root}/changes")
