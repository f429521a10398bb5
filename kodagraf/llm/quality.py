"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame operations only.

The sketch of a measure is a histogram of values cut to their leading ``KEPT_BITS`` bits:
exact below 2**KEPT_BITS, within 1/32 above, merged by adding counts. It is built for
each language and source by one combining aggregate, merged up to languages and to all,
and gives the quartiles from which the fences of each group follow. Groups of few
documents take the fences of their language, or of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.runtime import cut

KEPT_BITS = 6
MIN_GROUP = 50
#: Fences stand ``REACH`` quartile distances outside the quartiles, and the slack of the measure beyond.
REACH = 4
#: Measure -> (slack, whether there is a lower fence). All are whole numbers.
MEASURES = {"symbol_rate": (100, False), "word_length": (150, True), "dup_rate": (300, False)}
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: str) -> Column:
    """Words covered by 8-word windows that occur twice or more in the array column ``words``."""
    return F.expr(
        f"""CASE WHEN size({words}) <= {WINDOW} THEN 0L ELSE
          transform(array(transform({words}, w -> xxhash64(w))), hs ->
            transform(array(transform(sequence(1, size(hs) - {WINDOW - 1}), i -> xxhash64(slice(hs, i, {WINDOW})))), wh ->
              CASE WHEN size(array_distinct(wh)) = size(wh) THEN 0L ELSE
                transform(array(array_sort(transform(wh, (h, i) -> struct(h, i)))), s ->
                  aggregate(
                    array_sort(filter(transform(s, (x, j) ->
                      CASE WHEN x.h = get(s, j - 1).h OR x.h = get(s, j + 1).h THEN x.i END), x -> x IS NOT NULL)),
                    named_struct('last', -{WINDOW}, 'n', 0L),
                    (acc, x) -> named_struct('last', x, 'n', acc.n + least({WINDOW}, x - acc.last)),
                    acc -> acc.n))[0]
              END)[0])[0]
          END"""
    )


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (those with a word)."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(body, F.lit(SPACES))
    words = F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = docs.withColumns({"_words": words, "_lines": lines})
    counted = split.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_repeat_words": repeat_words("_words"),
        }
    )
    return counted.drop("_words", "_lines")


BASE_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def _measures() -> dict[str, Column]:
    return {
        "symbol_rate": F.expr("n_symbols * 1000 div n_words"),
        "word_length": F.expr("word_chars * 100 div n_words"),
        "dup_rate": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1L)"),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): the histogram sketch of each group over documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in _measures().items()])
    rows = measured.filter(f"NOT {BASE_FAILED}").select("lang", "source", F.explode(each).alias("m"))
    drop = f"greatest(length(bin(m.v)) - {KEPT_BITS}, 0)"
    value = F.expr(f"shiftleft(shiftright(m.v, {drop}), {drop})").alias("value")
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), value).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: its documents, and low_/high_ of each measure."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns(
        {"upto": F.sum("n").over(group.orderBy("value")), "all": F.sum("n").over(group)}
    )
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.max("all").alias("docs"),
        F.min(F.when(F.expr("4 * upto >= all"), F.col("value"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * all"), F.col("value"))).alias("q3"),
    )
    columns = [F.max("docs").alias("docs")]
    for name, (slack, both) in MEASURES.items():
        here = F.col("measure") == name
        columns.append(F.max(F.when(here, F.expr(f"q3 + {REACH} * (q3 - q1) + {slack}"))).alias(f"high_{name}"))
        low = F.expr(f"q1 - {REACH} * (q3 - q1) - {slack}") if both else F.lit(-1).cast("bigint")
        columns.append(F.max(F.when(here, low)).alias(f"low_{name}"))
    return quartiles.groupBy(*keys).agg(*columns)


def thresholds(sketches: DataFrame) -> DataFrame:
    """The fences in force for each (lang, source): its own, else its language's, else those of all."""
    names = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    own = fences(sketches, ["lang", "source"])
    of_lang = fences(merged(sketches, ["lang"]), ["lang"])
    of_all = fences(merged(sketches.withColumn("whole", F.lit(1)), ["whole"]), ["whole"]).first()  # one row
    lang = of_lang.select(F.col("lang").alias("l_lang"), *[F.col(c).alias(f"l_{c}") for c in ["docs", *names]])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    chosen = [
        F.when(F.col("docs") >= MIN_GROUP, F.col(c))
        .when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{c}"))
        .otherwise(F.lit(of_all[c] if of_all else None).cast("bigint"))
        .alias(c)
        for c in names
    ]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "docs", *chosen)


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept. measured: a written table with lang, source and the metrics."""
    table = cut(thresholds(cut(sketch(measured), "quality-sketch")), "quality-fences")
    # Groups with more than one document in 10,000 are fewer than 10,000: only they are broadcast.
    bound = max(measured.count() // 10_000, 1)
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    large, small = table.filter(F.col("docs") > bound), table.filter(F.col("docs") <= bound)
    of_large = measured.join(F.broadcast(large), same)
    others = measured.join(F.broadcast(large), same, "left_anti").join(small, same, "left")
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & value.between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    out = of_large.unionByName(others).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True))))


def report(docs: DataFrame) -> DataFrame:
    """The metrics and verdict of each document.

    A null or empty text has no words and fails the base rules. Missing languages or
    sources form groups of their own. Repeated rows are judged and returned each. An
    empty table gives no rows.
    """
    measured = cut(metrics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-metrics")
    return judged(measured).select("doc_id", *METRICS, "base_failed", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    columns = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    named = named.withColumns({"lang": F.col(at["lang"]), "source": F.col(at["source"])})
    measured = cut(metrics(named, at["text"]), "quality-metrics")
    return judged(measured).filter("kept").select(*[F.col(n).alias(c) for c, n in at.items()])


#: Blank characters of the contract, for DuckDB.
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_fences(keys: str, source: str) -> str:
    columns = ", ".join(
        f"max(CASE WHEN measure = '{m}' THEN q3 + {REACH} * (q3 - q1) + {slack} END) AS high_{m}, "
        f"max(CASE WHEN measure = '{m}' THEN {f'q1 - {REACH} * (q3 - q1) - {slack}' if both else '-1'} END) AS low_{m}"
        for m, (slack, both) in MEASURES.items()
    )
    return f"""(SELECT {keys}, max(total) AS docs, {columns} FROM (
      SELECT {keys}, measure, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN value END) AS q1,
             min(CASE WHEN 4 * upto >= 3 * total THEN value END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY value) AS upto,
                   sum(n) OVER (PARTITION BY {keys}, measure) AS total
            FROM (SELECT {keys}, measure, value, sum(n) AS n FROM {source} GROUP BY ALL))
      GROUP BY {keys}, measure) GROUP BY {keys})"""


def _sql_pick(name: str) -> str:
    return f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{name} WHEN l.docs >= {MIN_GROUP} THEN l.{name} ELSE a.{name} END"


def sql(documents: str = "documents") -> str:
    """The same in SQL for DuckDB, with metrics in a CTE named m and the verdicts in v."""
    inside = " AND ".join(
        f"coalesce(v_{m} BETWEEN {_sql_pick(f'low_{m}')} AND {_sql_pick(f'high_{m}')}, TRUE)" for m in MEASURES
    )
    return f"""
w AS (SELECT doc_id, u.pos AS pos, ws[u.pos] AS word FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
        FROM {documents}) d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS pos) u),
g AS (SELECT doc_id, pos, CASE WHEN count(*) OVER r = 8 THEN string_agg(word, ' ') OVER r END AS gram FROM w
      WINDOW r AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
f AS (SELECT doc_id, pos, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g),
c AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM f),
rw AS (SELECT doc_id, count(*) AS n_words, sum(hit)::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM {documents}),
m AS (SELECT d.doc_id, d.lang, d.source, coalesce(rw.n_words, 0) AS n_words,
             length(translate(coalesce(d.text, ''), {_BLANK}, ''))::BIGINT AS word_chars,
             (length(coalesce(d.text, '')) - length(translate(coalesce(d.text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(rw.n_repeat_words, 0) AS n_repeat_words
      FROM {documents} d JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, {BASE_FAILED} AS base_failed,
             n_symbols * 1000 // nullif(n_words, 0) AS v_symbol_rate, word_chars * 100 // nullif(n_words, 0) AS v_word_length,
             n_dup_lines * 1000 // greatest(n_lines, 1) AS v_dup_rate FROM m),
x AS (SELECT lang, source, 1 AS whole, measure, CAST(value AS BIGINT) AS raw FROM (
        SELECT lang, source, v_symbol_rate AS symbol_rate, v_word_length AS word_length, v_dup_rate AS dup_rate
        FROM b WHERE NOT base_failed) UNPIVOT (value FOR measure IN (symbol_rate, word_length, dup_rate))),
s AS (SELECT lang, source, whole, measure, (raw >> k) << k AS value, count(*) AS n
      FROM (SELECT *, greatest(length(bin(raw)) - {KEPT_BITS}, 0) AS k FROM x) GROUP BY ALL),
v AS (SELECT b.*, NOT b.base_failed AND ({inside}) AS kept
      FROM b LEFT JOIN {_sql_fences('lang, source', 's')} o ON b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source
             LEFT JOIN {_sql_fences('lang', 's')} l ON b.lang IS NOT DISTINCT FROM l.lang
             LEFT JOIN {_sql_fences('whole', 's')} a ON a.whole = 1)"""


SQL = f"WITH {sql()}\nSELECT doc_id, {', '.join(METRICS)}, base_failed, kept FROM v"
