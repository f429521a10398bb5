"""Context bundles: from a request in words to the code that answers it.

A bundle is kept in long form, a row per unit and section, because the
dependencies of a hub have no bound. The one-row form is made from a bundle whose
dependencies were cut to a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.functions import tokens
from kodagraf.functions.text import query_symbols
from kodagraf.operators import budget, graph
from kodagraf.operators.lookup import lookup_exact, units_of_file
from kodagraf.operators.search import search
from kodagraf.params import BUILD_QUERY_CHARS, BuildConfig
from kodagraf.runtime import cut

FOCAL_LIMIT = 10


def valid_requests(queries: DataFrame) -> DataFrame:
    low, high = BUILD_QUERY_CHARS
    return queries.filter(F.length("query").between(low, high) & (F.length(F.trim("query")) > 0))


def rejected_requests(queries: DataFrame) -> DataFrame:
    low, high = BUILD_QUERY_CHARS
    bad = ~(F.length("query").between(low, high) & (F.length(F.trim("query")) > 0))
    return queries.filter(F.coalesce(bad, F.lit(True))).withColumn(
        "error", F.lit(f"query must have {low} to {high} characters and not be blank")
    )


def request_terms(queries: DataFrame) -> DataFrame:
    """(query_id, position, term): candidate symbol names of each request."""
    return queries.select("query_id", F.posexplode(query_symbols(F.col("query"))).alias("position", "term"))


def resolve_names(units: DataFrame, names: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(name[, file_hint]) -> (name[, file_hint], unit_id): the exact unit, else the best of five search hits.

    A hit in the hinted file is better than any other.
    """
    hinted = "file_hint" in names.columns
    keys = ["name", "file_hint"] if hinted else ["name"]
    wanted = names.select(*keys).distinct()
    exact = lookup_exact(units, wanted.select("name").distinct()).select("name", F.col("id").alias("exact_id"))
    if not fuzzy:
        return wanted.join(exact, "name").withColumnRenamed("exact_id", "unit_id")
    wanted = cut(wanted, "wanted")
    exact = cut(lookup_exact(units, wanted.select("name").distinct()).select("name", F.col("id").alias("exact_id")), "exact")
    missing = wanted.join(exact, "name", "left_anti").select("name").distinct()
    hits = search(units, missing.select(F.col("name").alias("query_id"), F.col("name").alias("query")), 5)
    hits = hits.select(F.col("query_id").alias("name"), "rank", "file_path", "id")
    other = wanted.join(hits, "name")
    far = (F.col("file_path") != F.col("file_hint")) if hinted else F.lit(True)
    hint_keys = [F.coalesce(F.col("file_hint"), F.lit("")).alias("_hint")] if hinted else []
    best = other.groupBy("name", *hint_keys).agg(F.min(F.struct(F.coalesce(far, F.lit(True)).alias("far"), "rank", "id")).alias("_b"))
    best = best.select("name", *(["_hint"] if hinted else []), F.col("_b.id").alias("near_id"))
    joined = wanted.join(exact, "name", "left")
    if hinted:
        joined = joined.withColumn("_hint", F.coalesce("file_hint", F.lit(""))).join(best, ["name", "_hint"], "left").drop("_hint")
    else:
        joined = joined.join(best, "name", "left")
    return joined.select(*keys, F.coalesce("exact_id", "near_id").alias("unit_id")).filter("unit_id IS NOT NULL")


def resolve_requests(units: DataFrame, queries: DataFrame, limit: int = FOCAL_LIMIT, fuzzy: bool = True) -> DataFrame:
    """(query_id, unit_id, position): units named in the request, then units found by the request as a whole.

    Terms are resolved once however many requests share them.
    """
    asked = cut(valid_requests(queries), "asked") if fuzzy else valid_requests(queries)
    terms = request_terms(asked)
    resolved = resolve_names(units, terms.select(F.col("term").alias("name")), fuzzy)
    named = terms.join(resolved, F.col("term") == F.col("name")).select("query_id", "unit_id", F.lit(0).alias("stage"), "position")
    whole = search(units, asked.select("query_id", "query"), 2 * limit, fuzzy)
    found = whole.select("query_id", F.col("id").alias("unit_id"), F.lit(1).alias("stage"), F.col("rank").alias("position"))
    first = named.unionByName(found).groupBy("query_id", "unit_id").agg(F.min(F.struct("stage", "position")).alias("_at"))
    order = Window.partitionBy("query_id").orderBy("_at", "unit_id")
    ranked = first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return ranked.select("query_id", "unit_id", "position")


def found_by_name(units: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, unit_id) for those ids that no unit has: the first unit of the same name, as in an exact lookup."""
    missing = ids.select("id").distinct().join(units.select("id"), "id", "left_anti")
    missing = cut(missing.withColumn("name", F.substring_index("id", ":", -1)), "missing")
    named = lookup_exact(units, missing.select("name").distinct()).select("name", F.col("id").alias("unit_id"))
    return missing.join(named, "name").select("id", "unit_id")


def dependency_units(units: DataFrame, edges: DataFrame, focal: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """(query_id, <unit columns>, depth, near) of the dependencies that are not focal themselves.

    ``near`` marks a dependency in the file of a focal unit. An id without a unit stands for
    the first unit of its name, and gives no row if there is none.
    """
    reached = graph.bfs(edges, focal.select("query_id", F.col("unit_id").alias("start_id")), config.dependency_depth)
    ids = cut(reached.select("query_id", F.col("node_id").alias("id"), "depth"), "dependencies")
    moved = found_by_name(units, ids)
    if not moved.isEmpty():
        by_name = ids.join(moved, "id").groupBy("query_id", F.col("unit_id").alias("id")).agg(F.min("depth").alias("depth"))
        ids = ids.unionByName(by_name.join(ids, ["query_id", "id"], "left_anti"))
    ids = ids.join(focal.select("query_id", F.col("unit_id").alias("id")), ["query_id", "id"], "left_anti")
    found = ids.join(units, "id")
    if not config.prioritize_same_file:
        return found.withColumn("near", F.lit(False))
    files = focal.join(units.select(F.col("id").alias("unit_id"), "file_path"), "unit_id").select("query_id", "file_path")
    return found.join(files.distinct().withColumn("near", F.lit(True)), ["query_id", "file_path"], "left").withColumn(
        "near", F.coalesce("near", F.lit(False))
    )


def bundle(
    units: DataFrame, edges: DataFrame, focal: DataFrame, config: BuildConfig = BuildConfig()
) -> DataFrame:
    """Long form: (query_id, section, position, id, unit_kind, file_path, lines, signature, body, docstring, depth, tier).

    ``section`` is ``focal`` or ``dependency``. Dependencies carry no body unless
    ``skeletonize_dependencies`` is off; their order is (near first, file, line, id) and
    left to the reader, since ranking a hub's dependencies would put them in one task.
    """
    text = ["signature", "body", "docstring"]
    cols = ["id", "unit_kind", "file_path", "start_line", "end_line", *text]
    head = focal.join(units.select(*cols).withColumnRenamed("id", "unit_id"), "unit_id").select(
        "query_id", F.lit("focal").alias("section"), "position", F.col("unit_id").alias("id"), *cols[1:],
        F.lit(0).alias("depth"), F.lit(False).alias("near"), F.lit("full").alias("tier"),
    )
    deps = dependency_units(units.select(*cols), edges, focal, config)
    body = F.lit(None).cast("string") if config.skeletonize_dependencies else F.col("body")
    deps = deps.withColumn("position", F.lit(None).cast("int")).withColumn("section", F.lit("dependency"))
    if config.enforce_budget:
        deps = deps.withColumn("_t", tokens.unit_tokens())
        weighed = head.select("query_id", F.col("id").alias("item_id"), tokens.unit_tokens().alias("tokens"), F.lit(True).alias("is_focal"))
        weighed = weighed.unionByName(deps.select("query_id", F.col("id").alias("item_id"), F.col("_t").alias("tokens"), F.lit(False).alias("is_focal")))
        tiers = budget.allocate(weighed, config.max_context_tokens).filter("NOT is_focal AND tier <> 'pruned'")
        deps = deps.join(tiers.select("query_id", F.col("item_id").alias("id"), "tier"), ["query_id", "id"])
        body = F.when(F.col("tier") == "full", F.col("body"))
    else:
        deps = deps.withColumn("tier", F.lit("skeleton"))
    deps = deps.withColumn("body", body).select(*head.columns)
    return head.unionByName(deps)


def bundle_header(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per request, also for those that found nothing: counts, tokens and where the code lies.

    ``root`` is the first path segment of the first focal unit.
    """
    focal = F.col("section") == "focal"
    chars = F.length("signature") + F.coalesce(F.length("body"), F.lit(0)) + F.coalesce(F.length("docstring"), F.lit(0))
    segment = F.when(F.contains("file_path", F.lit("/")), F.substring_index("file_path", "/", 1))
    first = F.min(F.when(focal, F.struct("position", F.coalesce(segment, F.lit("")).alias("root"))))
    sums = rows.groupBy("query_id").agg(
        F.count(F.when(focal, 1)).alias("n_focal"),
        F.count(F.when(~focal, 1)).alias("n_dependencies"),
        F.sum(chars).alias("_chars"),
        first.alias("_first"),
    )
    zero = F.lit(0)
    return (
        queries.select("query_id", "query")
        .join(sums, "query_id", "left")
        .select(
            "query_id",
            "query",
            F.coalesce("n_focal", zero).alias("n_focal"),
            F.coalesce("n_dependencies", zero).alias("n_dependencies"),
            F.floor(F.coalesce("_chars", zero) * 0.25).cast("bigint").alias("total_tokens"),
            F.col("_first.root").alias("root"),
        )
    )


def bundle_files(rows: DataFrame) -> DataFrame:
    """(query_id, file_path, module): the repository map of a bundle, a row per file; ``module`` is the first path segment."""
    module = F.when(F.contains("file_path", F.lit("/")), F.substring_index("file_path", "/", 1))
    return rows.select("query_id", "file_path").distinct().withColumn("module", module)


def context_lines(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The rendered context in pieces: (query_id, part, sort_key, text); reading them in order gives the text."""
    rows = cut(rows, "bundle")  # read by each of the parts below
    header = cut(bundle_header(queries, rows), "bundle")
    span = F.concat("start_line", F.lit("-"), "end_line")
    focal = rows.filter("section = 'focal'").select(
        "query_id", F.lit(3).alias("part"), F.format_string("%010d", "position").alias("sort_key"),
        F.concat_ws("\n", F.concat(F.lit("### "), "id"), F.concat(F.lit("File: "), "file_path", F.lit(":"), span),
                    F.lit("```"), "signature", "body", F.lit("```"), F.lit("")).alias("text"),
    )
    deps = rows.filter("section = 'dependency'").select(
        "query_id", F.lit(5).alias("part"), _dependency_key().alias("sort_key"),
        F.concat(F.lit("- `"), "id", F.lit("` ("), "unit_kind", F.lit(") at "), "file_path", F.lit(":"), "start_line").alias("text"),
    )

    def piece(part: int, text: Column, when: Column = F.lit(True)) -> DataFrame:
        return header.filter(when).select("query_id", F.lit(part).alias("part"), F.lit("").alias("sort_key"), text.alias("text"))

    some = F.col("n_focal") > 0
    counts = F.concat(F.lit("\n---\nTokens: "), "total_tokens", F.lit(" | Focal: "), "n_focal", F.lit(" | Deps: "), "n_dependencies")
    modules = bundle_modules(rows)
    pieces = [
        piece(0, F.concat(F.lit("# Context for: "), "query", F.lit("\n"))),
        piece(1, F.concat(F.lit("## Repository Structure\nRoot: "), F.coalesce("root", F.lit(""))), some),
        modules.select("query_id", F.lit(2).alias("part"), F.lit("").alias("sort_key"), F.concat(F.lit("Modules: "), "modules").alias("text")),
        piece(2, F.lit(""), some).withColumn("sort_key", F.lit("~")),
        piece(3, F.concat(F.lit("## Focal Units ("), "n_focal", F.lit(")\n")), some),
        focal,
        piece(4, F.concat(F.lit("## Dependencies ("), "n_dependencies", F.lit(")\n")), F.col("n_dependencies") > 0),
        deps,
        piece(6, counts),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def bundle_modules(rows: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, modules): the first ``limit`` first path segments, joined."""
    named = bundle_files(rows).filter("module IS NOT NULL").select("query_id", "module").distinct()
    order = Window.partitionBy("query_id").orderBy("module")
    few = named.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit)
    return few.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("module")), ", ").alias("modules"))


def _dependency_key() -> Column:
    return F.concat(F.when(F.col("near"), "0").otherwise("1"), "file_path", F.lit("\0"), F.format_string("%012d", "start_line"), "id")


def context_text(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, text): the context as one text. For bundles built with ``enforce_budget``, whose size that bounds."""
    lines = context_lines(queries, rows).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "sort_key", "text"))).alias("_lines")
    )
    return lines.select("query_id", F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("text"))


def focal_code(rows: DataFrame) -> DataFrame:
    """(query_id, code): the focal units as code; a request has at most ten."""
    doc = F.when(F.length("docstring") > 0, F.concat(F.lit('"""'), "docstring", F.lit('"""')))
    code = F.concat_ws("\n", F.concat(F.lit("# "), "file_path", F.lit(":"), "start_line"), "signature", doc, "body", F.lit(""))
    listed = rows.filter("section = 'focal'").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", code.alias("code")))).alias("_c")
    )
    return listed.select("query_id", F.array_join(F.transform("_c", lambda x: x["code"]), "\n").alias("code"))


def build_context(
    units: DataFrame, edges: DataFrame, queries: DataFrame, config: BuildConfig = BuildConfig(), fuzzy: bool = True
) -> DataFrame:
    """The bundle rows of every request (query_id, query)."""
    return bundle(units, edges, cut(resolve_requests(units, queries, fuzzy=fuzzy), "focal"), config)


def context_for_symbols(
    units: DataFrame, edges: DataFrame, requests: DataFrame, config: BuildConfig = BuildConfig(), fuzzy: bool = True
) -> DataFrame:
    """(query_id, name) -> bundles around one symbol each."""
    resolved = resolve_names(units, requests.select("name"), fuzzy)
    focal = requests.join(resolved, "name").select("query_id", "unit_id", F.lit(1).alias("position"))
    return bundle(units, edges, cut(focal, "focal"), config)


def context_for_file(
    units: DataFrame, edges: DataFrame, file_path: str, focal_symbol: str | None = None, config: BuildConfig = BuildConfig()
) -> DataFrame:
    """Bundle around a file: the named symbol in it, or else its first unit; without a name, all its units."""
    own = units_of_file(units, file_path)
    if focal_symbol is not None:
        hit = F.lower(F.substring_index("id", ":", -1)) == focal_symbol.lower()
        own = own.orderBy(~hit, "start_line", "id").limit(1)
    at = F.row_number().over(Window.orderBy("start_line", "id"))  # the units of one file
    focal = own.select(F.lit(file_path).alias("query_id"), F.col("id").alias("unit_id"), at.alias("position"))
    return bundle(units, edges, focal, config)


def expand_dependencies(units: DataFrame, edges: DataFrame, requests: DataFrame, depth: int = 1) -> DataFrame:
    """(query_id, name) -> every dependency within ``depth``.

    An id that no unit has shows the first unit of its name; without one, kind and file are ``unknown`` and the line is 0.
    """
    starts = lookup_exact(units, requests).select("query_id", F.col("id").alias("start_id"))
    reached = cut(graph.dependencies(edges, starts, depth).withColumnRenamed("node_id", "id"), "dependencies")
    moved = found_by_name(units, reached)
    about = units.select(F.col("id").alias("unit_id"), "unit_kind", "file_path", "start_line")
    info = reached.join(moved, "id", "left").withColumn("unit_id", F.coalesce("unit_id", "id")).join(about, "unit_id", "left")
    return info.select(
        "query_id",
        "id",
        F.substring_index("id", ":", -1).alias("symbol_name"),
        F.coalesce("unit_kind", F.lit("unknown")).alias("unit_kind"),
        F.coalesce("file_path", F.lit("unknown")).alias("file_path"),
        F.coalesce("start_line", F.lit(0)).alias("line"),
        "depth",
    )


def symbol_context(units: DataFrame, edges: DataFrame, requests: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(query_id, name) -> the symbol (relation ``self``) and its direct dependencies (relation ``calls``)."""
    resolved = resolve_names(units, requests.select("name"), fuzzy)
    own = requests.join(resolved, "name").select("query_id", "unit_id")
    uses = graph.dependencies(edges, own.withColumnRenamed("unit_id", "start_id"), 1)
    rows = own.select("query_id", F.col("unit_id").alias("id"), F.lit("self").alias("relation")).unionByName(
        uses.select("query_id", F.col("node_id").alias("id"), F.lit("calls").alias("relation"))
    )
    return rows.join(units.select("id", "unit_kind", "file_path", "start_line", "signature"), "id")
