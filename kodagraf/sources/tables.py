"""Two code repositories derived row by row from the driver tables.

``parts``: one unit per ``part`` row, dependency edges from ``lineitem``.
``ledger``: units with bodies from ``orders``, ``customer`` and ``nation``, whose
edges have to be found in the body text.
Files hold at most 32 units and the number of files and modules grows with the
tables, so no group keyed by a file is unbounded.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodagraf.runtime import cut

_EDGE_CUTS: dict[tuple[str, str, str], DataFrame] = {}

PART_UNITS = """
WITH p AS (
  SELECT p_partkey AS k, p_size, p_type, p_brand, p_name, p_retailprice,
         element_at(array('FUNCTION', 'CLASS', 'METHOD', 'INTERFACE'), int(p_size % 4) + 1) AS unit_kind,
         element_at(array('.py', '.ts', '.go', '.js', '.rs', '.java'), int((p_partkey div 32) % 6) + 1) AS ext,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         concat('_', p_partkey % 97) AS tail
  FROM {part}
), n AS (
  SELECT *, concat('src/p', k div 128, '/m', k div 32, ext) AS file_path,
         CASE unit_kind
           WHEN 'FUNCTION' THEN concat(w1, '_', w2, tail)
           WHEN 'CLASS' THEN concat(initcap(w1), initcap(w2), tail)
           WHEN 'METHOD' THEN concat(initcap(w1), '.', w2, tail)
           ELSE concat('I', initcap(w1), initcap(w2), tail) END AS name
  FROM p
), s AS (
  SELECT *,
         CASE WHEN ext = '.py' AND unit_kind IN ('FUNCTION', 'METHOD')
                THEN concat('def ', substring_index(name, '.', -1), '(size: int) -> int:')
              WHEN ext = '.py' THEN concat('class ', name, ':')
              ELSE concat(CASE WHEN p_size % 2 = 1 THEN 'export ' ELSE '' END, lower(unit_kind), ' ', name, '()') END
           AS signature,
         concat('    size = ', p_size, '\\n', repeat(concat('    # ', p_name, '\\n'), int(p_size % 7)),
                '    return "', p_type, '/', p_brand, '"') AS body
  FROM n
)
SELECT k, p_brand AS brand, p_retailprice AS price, name,
       concat(file_path, ':', name) AS id, unit_kind, file_path,
       (k % 32) * 4096 AS start_byte,
       (k % 32) * 4096 + length(signature) + length(body) AS end_byte,
       1 + (k % 32) * 60 AS start_line, 1 + (k % 32) * 60 + p_size AS end_line,
       signature, body,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(p_name, ' of ', p_brand) END AS docstring,
       element_at(map('.py', 'python', '.ts', 'typescript', '.go', 'go', '.js', 'javascript',
                      '.rs', 'rust', '.java', 'java'), ext) AS language
FROM s
"""

LEDGER_UNITS = """
SELECT concat('lib/nations.py:INation_', n_nationkey) AS id, 'INTERFACE' AS unit_kind, 'lib/nations.py' AS file_path,
       concat('INation_', n_nationkey) AS name, bigint(1 + n_nationkey * 4) AS start_line, bigint(3 + n_nationkey * 4) AS end_line,
       concat('class INation_', n_nationkey, ':') AS signature, '    pass' AS body
FROM {nation}
UNION ALL
SELECT concat('lib/c', c_custkey div 64, '/m', c_custkey div 16, '.ts:Cust_', c_custkey), 'CLASS',
       concat('lib/c', c_custkey div 64, '/m', c_custkey div 16, '.ts'),
       concat('Cust_', c_custkey), 1 + (c_custkey % 16) * 5, 4 + (c_custkey % 16) * 5,
       concat('export class Cust_', c_custkey),
       concat('{{ class Inner extends Base implements INation_', c_nationkey, ' {{ home = new INation_', c_nationkey, '() }} }}')
FROM {customer}
UNION ALL
SELECT concat('app/a', o_orderkey div 512, '/f', o_orderkey div 32, '.py:order_', o_orderkey), 'FUNCTION',
       concat('app/a', o_orderkey div 512, '/f', o_orderkey div 32, '.py'),
       concat('order_', o_orderkey), 1 + (o_orderkey % 32) * 9, 7 + (o_orderkey % 32) * 9,
       concat('def order_', o_orderkey, '(row):'),
       concat('from lib import m', o_custkey div 16, '\\n    row = Cust_', o_custkey, '(row)\\n    prev = ledger.order_',
              o_orderkey div 2, ' (row)\\n    preorder_', o_orderkey, '(x)\\n    helper = require("c', o_custkey div 64,
              '/m', o_custkey div 16, '")\\n    return prev')
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt out to all cores when it has fewer files than there are cores.

    Only for work that is heavy per row, such as reading text. A table of many files
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


@dataclass(frozen=True)
class Repo:
    """The two big tables of one repository."""

    units: DataFrame
    edges: DataFrame


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_UNITS, part=table(spark, sf_dir, "part"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges source part -> another part, one type per line number; a set."""
    parts = part_units(spark, sf_dir).select("k", "id")
    n_parts = table(spark, sf_dir, "part").agg(F.count("*")).scalar()
    pairs = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("s"),
            F.pmod(F.expr("l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 31"), n_parts).alias("t"),
            F.expr("element_at(array('CALLS','IMPORTS','DEFINES','IMPLEMENTS'), int(l_linenumber % 4) + 1)").alias("edge_type"),
        )
        .filter("s <> t")
        .distinct()
    )
    return (
        pairs.join(parts.select(F.col("k").alias("s"), F.col("id").alias("source_id")), "s")
        .join(parts.select(F.col("k").alias("t"), F.col("id").alias("target_id")), "t")
        .select("source_id", "target_id", "edge_type")
    )


def ledger_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "customer")}
    tables["orders"] = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return ledger_rows(spark, **tables)


def ledger_rows(spark: SparkSession, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    units = spark.sql(LEDGER_UNITS, nation=nation, customer=customer, orders=orders)
    return units.select(
        "id", "unit_kind", "file_path", "name",
        F.lit(0).cast("bigint").alias("start_byte"),
        (F.length("signature") + F.length("body")).cast("bigint").alias("end_byte"),
        "start_line", "end_line", "signature", "body",
        F.lit(None).cast("string").alias("docstring"),
        F.when(F.endswith("file_path", F.lit(".ts")), "typescript").otherwise("python").alias("language"),
    )


def stored_edges(spark: SparkSession, sf_dir: str, kind: str, build) -> DataFrame:
    """The edge table of a repository, written once per session as an index would be."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _EDGE_CUTS:
        _EDGE_CUTS[key] = cut(build(), f"edges-{kind}")
    return _EDGE_CUTS[key]


def parts_repo(spark: SparkSession, sf_dir: str) -> Repo:
    return Repo(part_units(spark, sf_dir), stored_edges(spark, sf_dir, "parts", lambda: part_edges(spark, sf_dir)))


def fresh_name() -> str:
    return uuid.uuid4().hex


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    """``events`` read as file changes: one path per user."""
    kinds = "map('signup','created','view','modified','click','modified','error','deleted','purchase','moved')"
    return events.select(
        F.concat(F.lit("src/user_"), "user_id", F.lit(".py")).alias("path"),
        F.coalesce(F.element_at(F.expr(kinds), F.col("event_type")), F.lit("modified")).alias("change_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(False).alias("is_directory"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("src/moved_"), "user_id", F.lit(".py"))).alias("dest_path"),
        "event_id",
    )
