"""DuckDB counterparts of the derived tables in :mod:`kodagraf.sources.tables`."""

PARTS = """
p AS (
  SELECT p_partkey AS k, p_size, p_type, p_brand, p_name, p_retailprice,
         ['FUNCTION', 'CLASS', 'METHOD', 'INTERFACE'][p_size % 4 + 1] AS unit_kind,
         ['.py', '.ts', '.go', '.js', '.rs', '.java'][(p_partkey // 32) % 6 + 1] AS ext,
         ['python', 'typescript', 'go', 'javascript', 'rust', 'java'][(p_partkey // 32) % 6 + 1] AS language,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, '_' || (p_partkey % 97) AS tail
  FROM part
), pc AS (
  SELECT *, upper(w1[1]) || w1[2:] AS c1, upper(w2[1]) || w2[2:] AS c2 FROM p
), pn AS (
  SELECT *, 'src/p' || (k // 128) || '/m' || (k // 32) || ext AS file_path,
         CASE unit_kind WHEN 'FUNCTION' THEN w1 || '_' || w2 || tail WHEN 'CLASS' THEN c1 || c2 || tail
              WHEN 'METHOD' THEN c1 || '.' || w2 || tail ELSE 'I' || c1 || c2 || tail END AS name
  FROM pc
), ps AS (
  SELECT *,
         CASE WHEN ext = '.py' AND unit_kind IN ('FUNCTION', 'METHOD') THEN 'def ' || split_part(name, '.', -1) || '(size: int) -> int:'
              WHEN ext = '.py' THEN 'class ' || name || ':'
              ELSE CASE WHEN p_size % 2 = 1 THEN 'export ' ELSE '' END || lower(unit_kind) || ' ' || name || '()' END AS signature,
         '    size = ' || p_size || chr(10) || repeat('    # ' || p_name || chr(10), CAST(p_size % 7 AS INT))
           || '    return "' || p_type || '/' || p_brand || '"' AS body
  FROM pn
), units AS (
  SELECT k, p_brand AS brand, p_retailprice AS price, name, w1, w2, p_size, file_path || ':' || name AS id, unit_kind, file_path,
         CAST((k % 32) * 4096 AS BIGINT) AS start_byte,
         CAST((k % 32) * 4096 + length(signature) + length(body) AS BIGINT) AS end_byte,
         CAST(1 + (k % 32) * 60 AS BIGINT) AS start_line, CAST(1 + (k % 32) * 60 + p_size AS BIGINT) AS end_line,
         signature, body, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name || ' of ' || p_brand END AS docstring, language,
         regexp_replace(file_path, '/[^/]*$', '') AS module
  FROM ps
)"""

EDGES = """
e0 AS (
  SELECT DISTINCT l_partkey AS s,
         (l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 31) % (SELECT count(*) FROM part) AS t,
         ['CALLS', 'IMPORTS', 'DEFINES', 'IMPLEMENTS'][l_linenumber % 4 + 1] AS edge_type
  FROM lineitem
), edges AS (
  SELECT a.id AS source_id, b.id AS target_id, edge_type
  FROM e0 JOIN units a ON a.k = s JOIN units b ON b.k = t WHERE s <> t
), hop AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges)"""

TOP = """
top AS (
  SELECT brand AS query_id, id, name, file_path, k FROM units QUALIFY row_number() OVER (PARTITION BY brand ORDER BY price DESC, k DESC) = 1
), low AS (
  SELECT brand AS query_id, id, name, file_path, k FROM units QUALIFY row_number() OVER (PARTITION BY brand ORDER BY price, k) = 1
)"""

LEDGER = """
l0 AS (
  SELECT 'lib/nations.py' AS file_path, 'INation_' || n_nationkey AS name, 'INTERFACE' AS unit_kind, 1 + n_nationkey * 4 AS start_line,
         CAST(NULL AS BIGINT) AS okey, CAST(NULL AS BIGINT) AS ckey, CAST(n_nationkey AS BIGINT) AS nkey FROM nation
  UNION ALL
  SELECT 'lib/c' || (c_custkey // 64) || '/m' || (c_custkey // 16) || '.ts', 'Cust_' || c_custkey, 'CLASS', 1 + (c_custkey % 16) * 5,
         NULL, c_custkey, c_nationkey FROM customer
  UNION ALL
  SELECT 'app/a' || (o_orderkey // 512) || '/f' || (o_orderkey // 32) || '.py', 'order_' || o_orderkey, 'FUNCTION', 1 + (o_orderkey % 32) * 9,
         o_orderkey, o_custkey, NULL FROM orders
), lunits AS (
  SELECT *, file_path || ':' || name AS id, regexp_replace(file_path, '/[^/]*$', '') AS module FROM l0
), calls AS (
  SELECT o.id AS source_id, c.id AS target_id FROM lunits o JOIN lunits c ON c.unit_kind = 'CLASS' AND c.ckey = o.ckey WHERE o.unit_kind = 'FUNCTION'
  UNION
  SELECT o.id, q.id FROM lunits o JOIN lunits q ON q.okey = o.okey // 2 WHERE o.okey > 0
  UNION
  SELECT c.id, n.id FROM lunits c JOIN lunits n ON n.unit_kind = 'INTERFACE' AND n.nkey = c.nkey WHERE c.unit_kind = 'CLASS'
), lmod AS (
  SELECT DISTINCT a.module AS source_id, b.module AS target_id FROM calls JOIN lunits a ON a.id = calls.source_id JOIN lunits b ON b.id = calls.target_id
  WHERE a.module <> b.module
)"""

REQUESTS = """
req AS (
  SELECT 's' || s_suppkey AS query_id, 'Refactor `' || a.name || '` to call `' || b.name || '`' AS query, a.name AS name_a, b.name AS name_b
  FROM supplier JOIN units a ON a.k = s_suppkey JOIN units b ON b.k = s_suppkey + 1
)"""

DOCS = """
docs AS (
  SELECT source AS query_id, doc_id AS item_id, n_chars // 4 AS tokens, lang,
         doc_id = min(doc_id) OVER (PARTITION BY source) AS is_focal,
         CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS hop,
         CAST(100.0 / (n_chars + 1) + CASE WHEN lang = 'fr' THEN 10 ELSE 0 END AS DOUBLE) AS priority
  FROM documents
)"""

DOC_FILES = """
doc_files AS (
  SELECT doc_id, n_chars AS size_bytes,
         source || '/' || CASE lang WHEN 'fr' THEN 'vendor' WHEN 'es' THEN 'build-' || (doc_id // 100) ELSE 'd' || (doc_id // 100) END
           || '/t' || doc_id || CASE WHEN lang = 'de' THEN '.pyc' WHEN n_chars > 3000 THEN '.PY' WHEN n_chars > 1000 THEN '.tsx' ELSE '' END AS relative_path
  FROM documents
)"""


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ",".join(views)


def rank_rounds(n: int, hop: str = "hop", damping: float = 0.85) -> str:
    """PageRank by ``n`` chained views over distinct (src, dst)."""
    out = [
        f"nodes AS (SELECT src AS id FROM {hop} UNION SELECT dst FROM {hop})",
        f"deg AS (SELECT src, count(*) AS deg FROM {hop} GROUP BY src)",
        "n AS (SELECT count(*) AS n FROM nodes)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM nodes, n)",
    ]
    for i in range(1, n + 1):
        out.append(
            f"r{i} AS MATERIALIZED (SELECT nodes.id, (1 - {damping}::DOUBLE) / n + {damping}::DOUBLE * coalesce(g.part, 0) AS score "
            f"FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(r.score / deg.deg) AS part FROM {hop} JOIN deg USING (src) "
            f"JOIN r{i - 1} r ON r.id = src GROUP BY dst) g ON g.dst = nodes.id)"
        )
    return ", ".join(out) + f", ranks AS (SELECT * FROM r{n})"


IMPORTANCE = """
users AS (SELECT target_id AS id, count(*) AS n_users FROM edges GROUP BY ALL),
scores AS (
  SELECT ranks.id,
         CASE WHEN u.id IS NULL THEN ranks.score ELSE
           ranks.score * CASE WHEN n_users > 10 THEN 1.5::DOUBLE WHEN n_users > 5 THEN 1.3::DOUBLE WHEN n_users > 0 THEN 1.1::DOUBLE ELSE 1 END
           * CASE WHEN length(u.docstring) > 0 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN u.unit_kind = 'CLASS' THEN 1.2::DOUBLE ELSE 1 END END AS score
  FROM ranks LEFT JOIN units u USING (id) LEFT JOIN users USING (id)
), entries AS (
  SELECT units.id, module, name AS symbol_name, unit_kind, file_path, start_line, coalesce(scores.score, 0) AS score,
         CASE WHEN file_path LIKE '%.py' THEN name[1] <> '_' WHEN regexp_matches(file_path, '\\.(ts|tsx|js|jsx)$') THEN contains(signature, 'export')
              WHEN file_path LIKE '%.go' THEN regexp_matches(name, '^[A-Z]') ELSE true END AS is_exported
  FROM units LEFT JOIN scores USING (id)
), mods AS (
  SELECT module, avg(score) AS importance, count(*) AS symbol_count, split_part(module, '/', -1) AS module_name FROM entries GROUP BY module
)"""


def similar(pairs: str, p: str) -> str:
    """View ``{p}ratio`` (a, b, ratio): twice the letters in matching blocks over all letters, for distinct pairs (a, b).

    The longest common block is found first (of several the one that starts first in a, then in b), then the
    same is done left and right of it. Right for b below 200 letters, above which the matcher drops frequent ones.
    """
    block = (
        "list_max(list_transform(range(1, length({a}) + 1), lambda x: "
        "{{'k': len(list_filter(range(1, length({a}) - x + 2), lambda y: contains({b}, substr({a}, x, y)))), 'i': -x}}))"
    )
    return f"""{p}pair AS MATERIALIZED (SELECT row_number() OVER () AS pid, a, b FROM {pairs} WHERE a <> '' AND b <> ''),
{p}cut AS (
  SELECT pid, a AS sa, b AS sb, {block.format(a="a", b="b")} AS m FROM {p}pair
  UNION ALL
  SELECT pid, sa, sb, {block.format(a="sa", b="sb")} FROM (
    SELECT pid, unnest([left(sa, -m.i - 1), substr(sa, m.k - m.i)]) AS sa, unnest([left(sb, j - 1), substr(sb, j + m.k)]) AS sb
    FROM (SELECT *, instr(sb, substr(sa, -m.i, m.k)) AS j FROM {p}cut WHERE m.k > 0)) WHERE sa <> '' AND sb <> ''
), {p}ratio AS MATERIALIZED (SELECT a, b, 2.0::DOUBLE * r.n / (length(a) + length(b)) AS ratio FROM {p}pair JOIN (SELECT pid, sum(m.k) AS n FROM {p}cut GROUP BY pid) r USING (pid))"""


def search(asked: str, limit: int, p: str = "") -> str:
    """View ``{p}best`` (query_id, query, name, score, tier, rank) for requests (query_id, query): equal names, prefixes, similar names."""
    return f"""{p}q AS MATERIALIZED (SELECT query_id, query, lower(query) AS lq FROM {asked} WHERE length(query) > 0),
{p}names AS MATERIALIZED (SELECT DISTINCT name, lower(name) AS ln FROM units),
{p}hits AS MATERIALIZED (SELECT query_id, query, name, CASE WHEN ln = lq THEN 1.0::DOUBLE ELSE least(0.8::DOUBLE + 0.2::DOUBLE * length(query) / length(name), 0.99::DOUBLE) END AS score,
         CASE WHEN ln = lq THEN 0 ELSE 1 END AS tier, 0 AS pos FROM {p}q JOIN {p}names ON starts_with(ln, lq)),
{p}short AS MATERIALIZED (SELECT query_id, query FROM {p}q LEFT JOIN (SELECT query_id, count(*) AS n FROM {p}hits GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < {limit}),
{p}grid AS (SELECT DISTINCT name AS a, query AS b FROM {p}short JOIN {p}names ON 2.0 * least(length(query), length(name)) >= 0.3 * (length(query) + length(name))),
{similar(p + "grid", p + "x")},
{p}close AS MATERIALIZED (SELECT query_id, query, a AS name, row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, a DESC) AS pos FROM {p}short JOIN {p}xratio ON b = query
  WHERE ratio >= 0.3 QUALIFY pos <= {2 * limit}),
{p}lows AS (SELECT DISTINCT lower(query) AS a, lower(name) AS b FROM {p}close),
{similar(p + "lows", p + "y")},
{p}every AS (SELECT * FROM {p}hits UNION ALL
  SELECT query_id, query, name, ratio, 2, pos FROM {p}close JOIN {p}yratio ON a = lower(query) AND b = lower(name) WHERE ratio >= 0.3 AND NOT starts_with(lower(name), lower(query))),
{p}best AS (SELECT query_id, query, name, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier, pos, name) AS rank FROM {p}every QUALIFY rank <= {limit})"""


def resolved(terms: str, asked: str, limit: int = 10) -> str:
    """View ``focal`` (query_id, unit_id, position) for terms (query_id, term, position) and whole requests (query_id, query)."""
    return f"""wanted AS MATERIALIZED (SELECT DISTINCT term FROM {terms}),
exact AS MATERIALIZED (SELECT term, id FROM wanted JOIN units ON lower(name) = lower(term)
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY name <> term, file_path, start_line, id) = 1),
missing AS (SELECT term AS query_id, term AS query FROM wanted ANTI JOIN exact USING (term)),
{search("missing", 5, "t")}, {search(asked, 2 * limit, "w")},
first_unit AS MATERIALIZED (SELECT name, id FROM units QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, id) = 1),
near AS (SELECT query_id AS term, id FROM tbest JOIN first_unit USING (name) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, id) = 1),
points AS (SELECT query_id, id AS unit_id, 0 AS stage, position AS pos FROM {terms} JOIN (SELECT * FROM exact UNION ALL SELECT * FROM near) USING (term)
  UNION ALL SELECT query_id, id, 1, rank FROM wbest JOIN first_unit USING (name)),
placed AS (SELECT query_id, unit_id, min((stage, pos)) AS place FROM points GROUP BY ALL),
focal AS MATERIALIZED (SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY place, unit_id) AS position FROM placed QUALIFY position <= {limit})"""
