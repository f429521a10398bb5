"""Units without their bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kodagraf.functions import tokens
from kodagraf.functions.skeletons import HOLE, signatures_only


def skeletons(units: DataFrame, keep_docstring: bool = True, preserve_docstrings: bool = True) -> DataFrame:
    doc = F.col("docstring") if keep_docstring and preserve_docstrings else F.lit(None).cast("string")
    return units.select("id", "unit_kind", "signature", "file_path", "start_line", "end_line", doc.alias("docstring"))


def file_skeletons(units: DataFrame) -> DataFrame:
    """(file_path, text): the skeletons of a file in line order. A file is limited in size by the scan."""
    doc = F.when(F.length("docstring") > 0, F.concat(F.lit('    """'), "docstring", F.lit('"""')))
    text = F.concat_ws("\n", F.col("signature"), doc, F.lit(HOLE), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("start_line", "id", text.alias("text"))))
    return units.groupBy("file_path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def source_skeletons(files: DataFrame, preserve_docstrings: bool = True) -> DataFrame:
    """(path, language, content) -> the content reduced to declarations."""
    text = signatures_only(F.col("content"), F.col("language"), preserve_docstrings)
    return files.select("path", "language", text.alias("skeleton"))


def token_table(units: DataFrame) -> DataFrame:
    """(id, tokens, skeleton_tokens, quoted_tokens, ratio)."""
    full, skel = tokens.unit_tokens(), tokens.skeleton_tokens()
    return units.select(
        "id",
        full.alias("tokens"),
        skel.alias("skeleton_tokens"),
        tokens.quoted_skeleton_tokens().alias("quoted_tokens"),
        tokens.compression_ratio(full, skel).alias("ratio"),
    )
