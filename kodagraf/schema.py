"""Table schemas and enumerations of the code index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_KINDS = ("FUNCTION", "CLASS", "METHOD", "INTERFACE", "MODULE", "VARIABLE")
EDGE_TYPES = ("CALLS", "IMPORTS", "DEFINES", "IMPLEMENTS")
CHANGE_TYPES = ("created", "modified", "deleted", "moved")

CODE_UNITS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("unit_kind", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("start_byte", T.LongType(), False),
        T.StructField("end_byte", T.LongType(), False),
        T.StructField("start_line", T.LongType(), False),
        T.StructField("end_line", T.LongType(), False),
        T.StructField("signature", T.StringType(), False),
        T.StructField("body", T.StringType(), False),
        T.StructField("docstring", T.StringType(), True),
        T.StructField("language", T.StringType(), False),
    ]
)
DEPENDENCIES = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("edge_type", T.StringType(), False),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("last_modified", T.TimestampType(), True),
        T.StructField("language", T.StringType(), False),
        T.StructField("indexed_at", T.TimestampType(), True),
    ]
)
CHANGES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("change_type", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("is_directory", T.BooleanType(), False),
        T.StructField("dest_path", T.StringType(), True),
    ]
)

UNIT_COLS = CODE_UNITS.fieldNames()
EDGE_COLS = DEPENDENCIES.fieldNames()
# Everything but the wide text, for operators that never read it.
SLIM_COLS = ["id", "unit_kind", "file_path", "start_line", "end_line", "signature"]


def checked(col: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value itself, or a loud failure when it is outside the enumeration."""
    return F.when(col.isin(*allowed), col).otherwise(
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(col, F.lit("NULL"))))
    )
