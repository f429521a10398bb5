"""Keys that hold a large share of all rows, found exactly and without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key has more than one row in ``SHARE``, so there are fewer than ``SHARE`` of them.
SHARE = 10_000
LEAST = 2_000
BUCKETS = 1 << 16


def hot_keys(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """The keys with more than ``max(n_rows / SHARE, LEAST)`` rows: below ``SHARE`` rows whatever the input.

    First rows are counted by a 16-bit hash of the key, which combines before the
    shuffle; keys are counted only in the buckets that reach the bound.
    """
    bound = max(n_rows // SHARE, LEAST)
    named = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"))
    heavy = named.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > bound).select("_bucket")
    return (
        named.join(F.broadcast(heavy), "_bucket", "left_semi")
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > bound)
        .select(*keys)
    )
