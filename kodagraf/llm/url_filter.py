"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

Each URL is expanded into the suffixes of its host at label bounds, joined with the
prefixes of its path at the lengths that rules have. Expressions meet the rules on the
first four bytes of their digest; the full digest is then compared, and the longest
rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kodagraf.llm.line_dedup import LOWER, UPPER

#: (host, path, verdict). The fixed rules of the report.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT = "allow"
#: Rules up to this number are broadcast; more are joined by shuffle, each dealt to ``SPLITS`` tasks.
BROADCAST_RULES = 200_000
SPLITS = 16


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rule_host, rule_path, rule_verdict as a table; any DataFrame with these columns will do."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def parts(pages: DataFrame) -> DataFrame:
    """host and path of each url; both empty without ``://``."""
    start = F.locate("://", F.col("url"))
    rest = F.when(start > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    bare = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(bare, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)
    return pages.withColumn("_bare", bare).withColumns({"host": host, "path": path}).drop("_bare")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url).

    A rule fits its host and all subdomains when the path starts with its path. The rule
    with the longest ``host + path`` wins, then the longest host; of rules given twice,
    a block wins. Urls that no rule fits, null ones among them, have no rule and the
    default verdict. Repeated rows are returned each; an empty table gives none.
    """
    rule = F.concat("rule_host", "rule_path")
    hashed = (
        rules.filter("rule_host IS NOT NULL AND rule_path IS NOT NULL")
        .withColumn("digest", F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256))
        .groupBy("digest")
        .agg(
            F.max(
                F.struct(
                    F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), rule.alias("rule")
                )
            ).alias("r")
        )
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    # Path lengths that occur in rules: at most as many as a url has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect() if r[0] is not None)
    url = parts(pages.select("page_id", "url"))
    label = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label) - i + 1), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n),
    )
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\x00", h, p))))
    # One leading entry stands for the row itself, so rows without expressions stay and repeated ones are counted.
    listed = F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(expressions))
    rows = url.select("page_id", "url", F.explode(listed).alias("expression"))
    rows = rows.withColumn("digest", F.sha2(F.col("expression"), 256)).withColumn("prefix", F.substring("digest", 1, 8))
    full = rules.count()
    theirs = hashed.select("prefix", F.col("digest").alias("full"), "r")
    if full <= BROADCAST_RULES:
        met = rows.join(F.broadcast(theirs), "prefix", "left")
    else:
        theirs = theirs.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        split = F.pmod(F.xxhash64("page_id", "url"), F.lit(SPLITS)).cast("int")
        met = rows.withColumn("split", split).join(theirs, ["prefix", "split"], "left")
    sure = F.when(F.col("digest") == F.col("full"), F.col("r"))
    # A prefix may meet several rules: the row's own entry has no digest and is met by none.
    best = met.groupBy("page_id", "url").agg(F.max(sure).alias("r"), F.count_if(F.col("expression").isNull()).alias("copies"))
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return parts(each).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.lit(default)).alias("verdict")
    )


def report(pages: DataFrame) -> DataFrame:
    return judged(pages, rule_table(pages.sparkSession, RULES))


_CASES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {_CASES}),
a AS (SELECT row_number() OVER () AS k, page_id,
             CASE WHEN strpos(url, '://') > 0
                  THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS bare FROM pages),
u AS (SELECT k, page_id, translate(regexp_extract(bare, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN strpos(bare, '/') > 0 THEN substr(bare, strpos(bare, '/')) ELSE '' END AS path FROM a),
r AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
      FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM u LEFT JOIN r USING (k)
"""
