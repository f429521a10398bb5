"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kodagraf.llm import (
    bpe,
    decontam,
    jaccard_join,
    langid,
    license_scan,
    line_dedup,
    prefix_trie,
    quality,
    ranked_search,
    sharding,
    substring_dedup,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.report(_table(spark, sf, "documents"))


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf, "documents"))


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.report(_table(spark, sf, "documents"))


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.report(_table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.report(_table(spark, sf, "documents"))


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.report(_table(spark, sf, "documents"))


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(_table(spark, sf, "documents"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.report(_table(spark, sf, "pages"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.report(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.report(_table(spark, sf, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_line_dedup,
        op3_decontamination,
        op4_jaccard_join,
        op5_license_scan,
        op6_sharding,
        op7_bpe,
        op8_quality_rules,
        op9_url_filter,
        op10_toxicity,
        op11_ranked_search,
        op12_prefix_trie,
        op13_substring_dedup,
        pipeline,
    )
}

#: Queries without SQL, and why.
WITHOUT_SQL: dict[str, str] = {
    "op1_language_id": "learned centroids",
    "op3_decontamination": "tested against a plain version",
    "op4_jaccard_join": "too slow in SQL on whole tables; tested against a plain version",
    "op5_license_scan": "labels of near places",
    "op6_sharding": "hashes that SQL does not have",
    "op7_bpe": "tested against the library",
    "op10_toxicity": "learned weights",
    "pipeline": "holds op4 and op7",
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_url_filter": url_filter.SQL,
    "op11_ranked_search": ranked_search.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
