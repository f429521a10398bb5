"""Dependency edges found in the text of units.

Each finder cuts the body into name candidates, hash-joins the distinct candidates
with the names of units, and keeps the regular expression of the definition as a
residual test: equal to testing every pair, without the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions.ids import parent_dir, symbol_name_or_null
from kodagraf.runtime import cut, grown
from kodagraf.schema import EDGE_COLS

RUN = r"[\w.$]+"
# The texts that name an import.
IMPORT_PATTERNS = [
    r"import\s+(\w+)",
    r"from\s+(\S+)\s+import",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"import\s+['\"]([^'\"]+)['\"]",
]


def _runs(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1)))


def _pieces(run: Column) -> Column:
    """A run of name characters split at its word boundaries."""
    return F.regexp_extract_all(run, F.lit(r"(?U)(\w+|[.$])"), F.lit(1))


def _suffixes(run: Column) -> Column:
    p = _pieces(run)
    parts = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ""))
    return F.when(run.rlike("[.$]"), parts).otherwise(F.array(run))


def _prefixes(run: Column) -> Column:
    p = _pieces(run)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), ""))


def _literal(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def call_regex(name: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), _literal(name), F.lit(r"\s*\("))


def _targets(units: DataFrame) -> DataFrame:
    return units.select(
        F.col("id").alias("target_id"), F.col("file_path").alias("target_file"), symbol_name_or_null(F.col("id")).alias("name")
    ).filter(F.length("name") > 0)


def _edges(df: DataFrame, kind: str) -> DataFrame:
    return df.select("source_id", "target_id", F.lit(kind).alias("edge_type"))


#: Names that a run of name characters before a bracket can be.
PLAIN = r"(?U)^\w[\w.$]*$"


def _call_words(text: Column, plain: bool = False) -> Column:
    """The runs of name characters before a bracket, from each of their pieces on; if ``plain`` only those that match :data:`PLAIN`.

    One search that looks ahead from where a piece starts: a run without a bracket is not tried again from each of its characters.
    """
    start = r"\b(?=\w)"
    return _runs(text, rf"{start if plain else rf'(?:{start}|(?=[.$]))'}(?=({RUN}+)\s*+\()")


#: The first words of so many odd names are sent to all tasks; more of them meet the words of texts in a shuffle.
ODD_WORDS = 100_000


def _odd_calls(src: DataFrame, odd: DataFrame) -> DataFrame | None:
    """Calls of names with other characters, from (source_id, source_file, text): by their first word, then tested.

    None when there are no such names, as most often. Words travel without the texts, which come back for the test.
    """
    odd = odd.withColumn("word", F.regexp_extract("name", r"(?U)(\w+)", 1)).filter(F.length("word") > 0)
    firsts = odd.select("word").distinct()
    n_words = firsts.limit(ODD_WORDS + 1).count()
    if not n_words:
        return None
    words = src.select(F.col("source_id").alias("_id"), F.explode(F.array_distinct(_runs(F.col("text"), r"(\w+)"))).alias("word"))
    words = words.join(F.broadcast(firsts), "word") if n_words <= ODD_WORDS else words
    near = words.join(grown(odd), "word").drop("word").distinct()
    back = near.join(grown(src), F.col("_id").eqNullSafe(F.col("source_id"))).drop("_id")
    return back.filter(F.rlike(F.col("text"), call_regex(F.col("name"))))


def call_edges(units: DataFrame, scope: str = "repo", text: str = "body") -> DataFrame:
    """CALLS: the text of a unit has ``name(`` for the full name of another unit.

    ``scope="file"`` looks for callees in the same file only. Names with
    other characters than ``\\w.$``, or that do not start with a word, are found by their
    first word and then tested.
    """
    src = units.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.col(text).alias("text"))
    targets = _targets(units)
    plain = F.col("name").rlike(PLAIN)
    # What does not look like a plain name, as most suffixes, need not travel; nor need files that are not compared.
    words = src.withColumn("name", F.explode(_call_words(F.col("text"), plain=True)))
    if scope == "file":
        words, targets_by = words.select("source_id", "name", F.col("source_file").alias("file")), [F.col("target_file").alias("file")]
    else:
        words, targets_by = words.select("source_id", "name"), []
    found = words.join(grown(targets.filter(plain).select("name", "target_id", *targets_by)), [c for c in words.columns if c != "source_id"])
    both = found.filter("source_id <> target_id")

    odd = _odd_calls(src, targets.filter(~plain))
    if odd is None:
        # By all columns: they lie with their name after the join, and equal rows are dropped there.
        return _edges(both.distinct(), "CALLS")
    odd = odd.filter("source_id <> target_id")
    if scope == "file":
        odd = odd.filter("source_file = target_file")
    return _edges(both, "CALLS").unionByName(_edges(odd, "CALLS")).distinct()


def define_edges(units: DataFrame) -> DataFrame:
    """DEFINES: a file and each of its units."""
    return units.select(F.col("file_path").alias("source_id"), F.col("id").alias("target_id"), F.lit("DEFINES").alias("edge_type"))


def _base_words(text: Column) -> Column:
    after = F.flatten(F.transform(_runs(text, rf"(?:implements|extends)\s+({RUN})"), _prefixes))
    bases = F.array_join(_runs(text, r"class\s+\w+\s*\(([^)]*)"), "\n")
    inside = F.flatten(F.transform(_runs(bases, rf"({RUN})"), lambda r: F.flatten(F.transform(_suffixes(r), _prefixes))))
    return F.array_distinct(F.concat(after, inside))


def base_regex(name: Column) -> Column:
    name = _literal(name)
    return F.concat(
        F.lit(r"(?U)(?:class\s+\w+\s*\([^)]*\b"), name, F.lit(r"\b|(?:implements|extends)\s+"), name, F.lit(r"\b)")
    )


def implement_edges(units: DataFrame, scope: str = "repo", text: str = "body") -> DataFrame:
    """IMPLEMENTS: a class text names an interface as base, after ``implements`` or after ``extends``."""
    src = units.filter(F.col("unit_kind").isin("CLASS", "METHOD")).select(
        F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.col(text).alias("text")
    )
    words = src.withColumn("name", F.explode(_base_words(F.col("text"))))
    targets = _targets(units.filter(F.col("unit_kind") == "INTERFACE"))
    found = words.join(targets, "name").filter(F.rlike(F.col("text"), base_regex(F.col("name"))))
    if scope == "file":
        found = found.filter("source_file = target_file")
    return _edges(found, "IMPLEMENTS").distinct()


def _import_words(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[_runs(text, p) for p in IMPORT_PATTERNS])))


def import_texts(units: DataFrame, text: str = "body") -> DataFrame:
    """(source_id, source_file, path): what the text of a unit imports."""
    return units.select(
        F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.explode(_import_words(F.col(text))).alias("path")
    )


def import_edges(units: DataFrame, scope: str = "repo", text: str = "body") -> DataFrame:
    """IMPORTS: the import text resolved to the first unit of a file, or to a unit by name."""
    texts = import_texts(units, text)
    if scope == "file":
        own = units.groupBy("file_path").agg(F.min(F.struct("start_line", "id")).alias("_u"))
        own = own.select(F.col("file_path").alias("source_file"), F.col("_u.id").alias("first_id"))
        by_path = (
            texts.join(own, "source_file")
            .filter(_path_hit(F.col("source_file"), F.col("path")))
            .select("source_id", "source_file", "path", F.col("first_id").alias("by_path"))
        )
        named = _named_targets(units, ["target_file", "last"]).withColumnRenamed("target_file", "source_file")
        joined = texts.join(by_path, ["source_id", "source_file", "path"], "left").withColumn("last", _last(F.col("path")))
        joined = joined.join(named, ["source_file", "last"], "left")
    else:
        resolved = resolve_imports(texts.select("path").distinct(), units)
        joined = texts.join(resolved, "path")
    target = F.coalesce("by_path", "by_name")
    return _edges(joined.withColumn("target_id", target).filter("target_id IS NOT NULL"), "IMPORTS").distinct()


def _last(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def _path_hit(file: Column, path: Column) -> Column:
    return F.contains(file, path) | F.endswith(file, F.concat(F.lit("/"), F.replace(path, F.lit("."), F.lit("/"))))


def _named_targets(units: DataFrame, keys: list[str]) -> DataFrame:
    u = units.select(
        F.col("file_path").alias("target_file"), symbol_name_or_null(F.col("id")).alias("last"), "start_line", "id"
    ).filter("last IS NOT NULL")
    best = u.groupBy(*keys).agg(F.min(F.struct("target_file", "start_line", "id")).alias("_u"))
    return best.select(*keys, F.col("_u.id").alias("by_name"))


def resolve_imports(paths: DataFrame, units: DataFrame) -> DataFrame:
    """(path, by_path, by_name) for distinct import texts over the whole repository.

    A file qualifies when its path contains the text, or ends with it read as a
    dotted path. For both, the text is a piece of the path, and of the files with a piece the first
    is wanted: so pieces of the lengths that texts have are reduced to their first file and
    meet the texts by equality. A piece inside what a path shares with one before it belongs to that one, and is left out.
    """
    paths = cut(paths.select("path"), "import-texts")
    firsts = units.groupBy("file_path").agg(F.min(F.struct("start_line", "id")).alias("_u"))
    files = firsts.select("file_path", F.col("_u.id").alias("unit_id"))
    pieces = _first_files(files.select("file_path"), paths.agg(F.collect_set(F.length("path"))).scalar())

    whole = F.struct(F.lit(False).alias("tail"), F.col("path").alias("piece"))
    dotted = F.struct(F.lit(True).alias("tail"), F.concat(F.lit("/"), F.replace(F.col("path"), F.lit("."), F.lit("/"))).alias("piece"))
    needles = paths.filter(F.length("path") > 0).select("path", F.explode(F.array(whole, dotted)).alias("_n"))
    hits = (
        needles.select("path", "_n.*")
        .join(grown(pieces), ["tail", "piece"])
        .groupBy("path")
        .agg(F.min("file_path").alias("file_path"))
        .join(grown(files), "file_path")
        .select("path", F.col("unit_id").alias("by_path"))
    )
    named = _named_targets(units, ["last"])
    return (
        paths.join(grown(hits), "path", "left")
        .withColumn("last", _last(F.col("path")))
        .join(grown(named), "last", "left")
        .select("path", "by_path", "by_name")
    )


#: Paths that are equal up to their last so many characters are compared with the one before them.
_NEAR = 8


def _first_files(files: DataFrame, lengths: Column) -> DataFrame:
    """(tail, piece, file_path): the first file that has a piece of one of the lengths, or ends with a piece from a slash on.

    Pieces with ``tail`` have no dot, as they stand for texts whose dots were replaced.
    """
    path = F.col("file_path")
    near = Window.partitionBy(F.substring(path, F.lit(1), F.length(path) - _NEAR)).orderBy("file_path")
    before = F.coalesce(F.lag("file_path").over(near), F.lit(""))
    shared = F.filter(_upto(F.length(path)), lambda i: F.startswith(F.col("_before"), F.substring(path, F.lit(1), i)))
    seen = files.withColumn("_before", before).withColumn("_shared", F.size(shared)).withColumn("_lengths", lengths)

    ends = F.filter(_upto(F.length(path)), lambda end: end > F.col("_shared"))
    inside = F.flatten(
        F.transform(ends, lambda end: F.transform(F.filter("_lengths", lambda n: (n > 0) & (n <= end)), lambda n: F.substring(path, end - n + 1, n)))
    )
    from_slash = F.transform(_upto(F.length(path)), lambda i: F.substring(path, i, F.length(path)))
    tails = F.filter(from_slash, lambda t: F.startswith(t, F.lit("/")) & ~F.contains(t, F.lit(".")))

    def tagged(pieces: Column, tail: bool) -> Column:
        return F.transform(F.array_distinct(pieces), lambda p: F.struct(F.lit(tail).alias("tail"), p.alias("piece")))

    listed = seen.select("file_path", F.explode(F.concat(tagged(inside, False), tagged(tails, True))).alias("_p"))
    return listed.select("file_path", "_p.*").groupBy("tail", "piece").agg(F.min("file_path").alias("file_path"))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def resolve_reference(units: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, name, context_file) -> the unit of that name, one in the same directory first."""
    u = _targets(units).withColumn("dir", parent_dir(F.col("target_file")))
    first = F.min(F.struct("target_file", "target_id"))
    near = u.groupBy("name", "dir").agg(first.alias("_near"))
    anywhere = near.groupBy("name").agg(F.min("_near").alias("_any"))
    return (
        references.withColumn("dir", parent_dir(F.col("context_file")))
        .join(anywhere, "name")
        .join(near, ["name", "dir"], "left")
        .withColumn("target_id", F.coalesce("_near.target_id", "_any.target_id"))
        .drop("dir", "_near", "_any")
    )


def edges_from_dependencies(units: DataFrame) -> DataFrame:
    """CALLS edges from an explicit ``dependencies`` array."""
    return units.select(F.col("id").alias("source_id"), F.explode("dependencies").alias("target_id"), F.lit("CALLS").alias("edge_type"))


def build_edges(units: DataFrame, scope: str = "repo", text: str = "body") -> DataFrame:
    """All edges of a set of files, as a set."""
    parts = [define_edges(units).distinct(), call_edges(units, scope, text), import_edges(units, scope, text), implement_edges(units, scope, text)]
    out = reduce(DataFrame.unionByName, parts)
    # Each part is a set of its own type; only with files compared can one hold a call twice, of ids that are in two files.
    return out.dropDuplicates(EDGE_COLS) if scope == "file" else out


# The inverted list of an index, and edges from it


def references(units: DataFrame, text: str = "body") -> DataFrame:
    """(source_id, source_file, kind, word): what the text of each unit may call, import or have as base, read once.

    Kept beside the units, it stands for their bodies: with the names of units it gives all edges
    but calls of odd names (see :data:`PLAIN`).
    """

    def tagged(kind: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))

    body = F.col(text)
    bases = F.when(F.col("unit_kind").isin("CLASS", "METHOD"), F.filter(_base_words(body), lambda w: F.rlike(body, base_regex(w))))
    none = F.array().cast("array<string>")
    all_words = F.concat(
        tagged("call", _call_words(body)), tagged("import", _import_words(body)), tagged("base", F.coalesce(bases, none))
    )
    listed = units.filter(body.isNotNull()).select(
        F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.explode(all_words).alias("_w")
    )
    return listed.select("source_id", "source_file", "_w.kind", "_w.word")


def _named_by(refs: DataFrame, units: DataFrame) -> DataFrame:
    """CALLS and IMPLEMENTS of plain names between some references and some units."""
    targets = _targets(units).withColumnRenamed("name", "word")
    targets = grown(targets.filter(F.col("word").rlike(PLAIN)))
    calls = refs.filter("kind = 'call'").join(targets, "word").filter("source_id <> target_id")
    interfaces = _targets(units.filter(F.col("unit_kind") == "INTERFACE")).withColumnRenamed("name", "word")
    bases = refs.filter("kind = 'base'").join(interfaces, "word")
    return _edges(calls, "CALLS").unionByName(_edges(bases, "IMPLEMENTS"))


def changed_edges(
    kept_edges: DataFrame, kept_units: DataFrame, kept_refs: DataFrame, gone: DataFrame, fresh: DataFrame, fresh_refs: DataFrame
) -> DataFrame:
    """All edges after the units ``gone`` were replaced by ``fresh``; ``kept_edges`` touch neither.

    What is new has a new unit at one end: new words meet all names, and all words the new names. Only
    imports can change between kept units, as the first file or unit that fits is taken: the sources of
    texts that fit a file or name which came or went are resolved again. Bodies of kept
    units are read only if a new name has odd characters.
    """
    meta = ["id", "file_path", "unit_kind", "start_line"]
    units = cut(kept_units.select(*meta).unionByName(fresh.select(*meta)), "units-after")  # names and files are sought in it several times
    out = [kept_edges, define_edges(fresh), _named_by(fresh_refs, units), _named_by(kept_refs, fresh)]

    def sources(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_file"), F.col("body").alias("text"))

    odd = ~F.col("name").rlike(PLAIN)
    anew = _odd_calls(sources(fresh), _targets(units).filter(odd))
    if anew is not None:
        out.append(_edges(anew.filter("source_id <> target_id"), "CALLS"))
    older = _odd_calls(sources(kept_units), _targets(fresh).filter(odd))
    if older is not None:
        out.append(_edges(older, "CALLS"))

    texts = kept_refs.unionByName(fresh_refs).filter("kind = 'import'").select("source_id", F.col("word").alias("path"))
    texts = cut(texts, "import-refs")
    moved = gone.select(*meta).unionByName(fresh.select(*meta))
    unsettled = resolve_imports(texts.select("path").distinct(), moved).filter("by_path IS NOT NULL OR by_name IS NOT NULL")
    again = texts.join(unsettled.select("path"), "path", "left_semi").select("source_id")
    again = cut(again.unionByName(fresh_refs.select("source_id")).distinct(), "imports-again")
    theirs = texts.join(again, "source_id", "left_semi")
    resolved = theirs.join(resolve_imports(theirs.select("path").distinct(), units), "path")
    found = resolved.withColumn("target_id", F.coalesce("by_path", "by_name")).filter("target_id IS NOT NULL")
    settled = kept_edges.join(again.withColumn("edge_type", F.lit("IMPORTS")), ["source_id", "edge_type"], "left_anti")
    out[0] = settled.select(*EDGE_COLS)
    out.append(_edges(found, "IMPORTS"))
    return reduce(DataFrame.unionByName, [part.select(*EDGE_COLS) for part in out]).dropDuplicates(EDGE_COLS)
