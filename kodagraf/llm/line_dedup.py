"""Line deduplication over all documents, in DataFrame operations only.

Line hashes are range-partitioned with a secondary sort by document and position, so a
key's first occurrence is streamed before the others. The result is not text but, for
each document that loses lines, the 64-bit words of its keep bitmap that are not all
ones; the text is cut by whoever holds it.

Keys of a large share of all lines are found exactly beforehand (see ``skew``) and take
another way: aggregates that combine before the shuffle, and joins with these few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.llm.skew import hot_keys
from kodagraf.runtime import cut

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 20
LEAST_DOCS = 3
#: Stands for a missing doc_id, below every other.
NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    """The text cut at line feeds; null counts as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(h1, h2, doc, content, pos) of each line whose key is long enough."""
    # The whole text is read here, once a document: beside an explode it would be hashed again for each line.
    cut_up = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("content"), lines_of(F.col("text")).alias("lines")
    )
    lines = cut_up.select("doc", "content", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc", "content", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= least_length).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "content", "pos"
    )


def _streamed(rows: DataFrame) -> DataFrame:
    """Lines to drop among keys of bounded size: after the key's first document, if it has three."""
    by_key = Window.partitionBy("h1", "h2")
    by_place = by_key.orderBy(F.desc("doc"))
    dealt = rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    streamed = dealt.select(
        "h1", "h2", "doc", "content", "pos", F.dense_rank().over(by_place).alias("nth"), F.min("doc").over(by_key).alias("least")
    )
    # The second document drops its lines only if a third follows.
    return streamed.filter((F.col("nth") >= LEAST_DOCS) | ((F.col("nth") == 2) & (F.col("doc") > F.col("least"))))


def _combined(rows: DataFrame) -> DataFrame:
    """The same for hot keys, of which there are few: every step combines before its shuffle."""
    ends = cut(rows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "lines-hot-ends")
    within = rows.join(F.broadcast(ends), ["h1", "h2"])
    between = (F.col("doc") > F.col("low")) & (F.col("doc") < F.col("high"))
    third = cut(within.groupBy("h1", "h2").agg(F.max(between).alias("third")).filter("third"), "lines-hot-thirds")
    return within.join(F.broadcast(third), ["h1", "h2"]).filter(F.col("doc") < F.col("high"))


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc, content, gaps, n_dropped) of the documents that lose lines.

    ``doc`` is the doc_id (``NO_ID`` for null), ``content`` the xxhash64 of the text, so that
    rows which repeat a doc_id with other texts keep bitmaps of their own. ``gaps`` holds
    (word, bits): bit b of word w is set when line 64 * w + b goes; words without gaps
    are left out.
    """
    rows = cut(occurrences(docs, least_length), "lines")
    hot = cut(hot_keys(rows, ["h1", "h2"], rows.count()), "lines-hot")
    cold = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    heavy = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    place = ["doc", "content", "pos"]
    dropped = _streamed(cold).select(*place).unionByName(_combined(heavy).select(*place))
    word = F.floor(F.col("pos") / 64).cast("int")
    words = dropped.groupBy("doc", "content", word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc", "content").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("gaps"), F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped")
    )


def _with_bitmaps(docs: DataFrame, least_length: int) -> DataFrame:
    """Columns _c0, _c1 ... of ``docs``, gaps and n_dropped (null where nothing goes)."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    doc, text = f"_c{columns.index('doc_id')}", f"_c{columns.index('text')}"
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), least_length)
    keyed = named.withColumns({"doc": F.coalesce(F.col(doc), F.lit(NO_ID)), "content": F.xxhash64(text)})
    return keyed.join(bitmaps, ["doc", "content"], "left")


def kept_text(text: str) -> Column:
    """The lines of column ``text`` that column ``gaps`` leaves, joined by line feeds."""
    return F.expr(
        f"""CASE WHEN gaps IS NULL THEN coalesce({text}, '') ELSE
              array_join(transform(array(split(coalesce({text}, ''), '\\n', -1)), lines ->
                transform(
                  array_except(sequence(0, size(lines) - 1),
                    flatten(transform(gaps, g -> transform(
                      filter(sequence(0, 63), b -> getbit(g.bits, b) = 1), b -> g.word * 64 + b)))),
                  i -> lines[i]))[0], '\\n') END"""
    )


def deduplicated(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` without lines that at least three documents hold, except in the largest doc_id.

    Columns as before; n_chars, where there is one, follows the text. A null text stays
    null and a text that loses all lines becomes empty. Rows that repeat a doc_id count as
    one document for the number of holders, and all of them keep its lines. A missing
    doc_id counts as the smallest. An empty table stays empty.
    """
    columns = docs.columns
    found = _with_bitmaps(docs, least_length)
    text = f"_c{columns.index('text')}"
    out = []
    for i, c in enumerate(columns):
        if c == "text":
            out.append(F.when(F.col("gaps").isNull(), F.col(text)).otherwise(kept_text(text)).alias(c))
        elif c == "n_chars":
            new = F.length(kept_text(text)).cast(docs.schema[c].dataType)
            out.append(F.when(F.col("gaps").isNull(), F.col(f"_c{i}")).otherwise(new).alias(c))
        else:
            out.append(F.col(f"_c{i}").alias(c))
    return found.select(*out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    found = _with_bitmaps(docs.select("doc_id", "text"), LEAST_LENGTH)
    return found.select(
        F.col("_c0").alias("doc_id"),
        F.size(lines_of(F.col("_c1"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept_text("_c1"), 256).alias("kept_sha256"),
    )


SQL = """
WITH l AS (SELECT doc_id, u.pos AS pos, lines[u.pos] AS line,
                  translate(trim(lines[u.pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
                LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS pos) u),
k AS (SELECT key, max(doc_id) AS last_id FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, k.last_id IS NOT NULL AND l.doc_id <> k.last_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
