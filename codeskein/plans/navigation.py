"""Queries of symbol search, positions, references and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions.text import glob_regex, is_test
from codeskein.operators import navigation as nav
from codeskein.operators.resolve import STAGES, resolve_symbols
from codeskein.relations import EDGES_SQL, RAW_SQL, SYM_SQL, TYPE_KINDS, Relations, certain


def busiest(rel: Relations) -> int:
    """The workspace symbol with most references; a single number."""
    row = rel.references.join(rel.symbols.select(F.col("seq").alias("to_node")), "to_node", "left_semi").groupBy("to_node").count().orderBy(F.desc("count"), "to_node").first()
    return row["to_node"] if row else -1


BUSIEST_SQL = "busiest AS (SELECT to_node AS node FROM raw WHERE to_node IN (SELECT seq FROM sym) GROUP BY to_node ORDER BY count(*) DESC, to_node LIMIT 1)"
_SURE = "coalesce(confidence, 0) <> 2"
_SPANS = f"""{SYM_SQL}, {RAW_SQL},
    spans AS (
      SELECT DISTINCT file, node, CAST(code_line AS BIGINT) AS "start",
             CAST(code_line + length(regexp_replace(code, '[^\n]', '', 'g')) + CASE WHEN code LIKE '%\n' THEN 0 ELSE 1 END AS BIGINT) AS stop
      FROM context_items JOIN sym ON node = seq WHERE code IS NOT NULL AND code_line IS NOT NULL),
    at_line AS (SELECT edge_id, to_node, confidence, CAST(first_line AS BIGINT) AS line, file FROM raw JOIN sym ON from_node = seq WHERE first_line IS NOT NULL)"""


def edge_kind_counts(rel: Relations) -> DataFrame:
    return rel.edges.groupBy("edge_kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("edge_count").alias("occurrences"), F.count(F.when(~certain(F.col("confidence")), 1)).alias("name_only"))


def symbol_info(rel: Relations) -> DataFrame:
    """Relation counts of every symbol."""
    def of(kind: str, name: str):
        return F.count(F.when(F.col("edge_kind") == kind, 1)).alias(name)

    counts = rel.edges.groupBy(F.col("to_node").alias("seq")).agg(of("Inherits", "derived"), of("Implements", "implementers"), of("Overrides", "overridden_by"), of("ImplementsMember", "implemented_by"), F.count(F.lit(1)).alias("incoming"))
    zero = ("derived", "implementers", "overridden_by", "implemented_by", "incoming")
    return rel.symbols.select("seq", "id", "kind").join(counts, "seq", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def type_members(rel: Relations) -> DataFrame:
    owner = rel.symbols.select(F.col("id").alias("container_id"), F.col("name").alias("type_name"))
    return rel.symbols.join(owner, "container_id").select("container_id", "type_name", "id", "kind", F.lower("accessibility").alias("accessibility"))


def reference_counts(rel: Relations) -> DataFrame:
    """Per project: references by grade, to library members and unresolved ones."""
    refs = nav.with_caller(rel, rel.references.where("to_node IS NOT NULL"))
    refs = refs.join(rel.symbols.select(F.col("seq").alias("to_node"), F.lit(True).alias("inside")), "to_node", "left").join(rel.externals.select(F.col("node").alias("to_node"), F.lit(True).alias("outside")), "to_node", "left")
    grade = F.coalesce("confidence", F.lit(0))
    inside, outside = F.coalesce("inside", F.lit(False)), F.coalesce("outside", F.lit(False))
    counts = refs.groupBy(F.coalesce("caller_project", F.lit("(workspace)")).alias("project")).agg(
        *[F.count(F.when(inside & (grade == g), 1)).alias(n) for g, n in enumerate(("exact", "inferred", "name_only"))],
        F.count(F.when(outside & ~inside, 1)).alias("external"),
        F.count(F.when(~outside & ~inside, 1)).alias("unresolved"),
    )
    bound = F.col("exact") + F.col("inferred") + F.col("name_only")
    return counts.withColumn("name_only_share", F.when(bound > 0, F.bround(F.col("name_only") / bound, 4)).otherwise(0.0))


def tests_of_paths(rel: Relations) -> DataFrame:
    return rel.newest_sources.select("path", is_test(F.col("path")).alias("is_test"))


def glob_match(rel: Relations) -> DataFrame:
    return rel.newest_sources.where(F.col("path").rlike(glob_regex("repos/**/*er.cs"))).select("path")


def asked_symbols(rel: Relations) -> DataFrame:
    """Strings of every form: ids, ids without parameters, names, names with their containers, places of references."""
    s = rel.symbols
    owner = s.select(F.col("id").alias("container_id"), F.col("name").alias("container"))
    forms = F.array("id", F.regexp_extract("id", r"^([^(]*)\(", 1), "name", F.upper("name"), F.concat("container", F.lit("."), "name"), F.concat("namespace", F.lit("::"), "name"))
    named = s.join(owner, "container_id", "left").select(F.explode(forms).alias("query"))
    places = nav.reference_positions(rel).select(F.concat("file", F.lit(":"), "line").alias("query"))
    return named.unionByName(places).unionByName(rel.externals.select(F.col("name").alias("query")))


_CHAIN_SQL = """lower('/' || array_to_string(list_concat(CASE WHEN o.name IS NULL THEN [] ELSE [o.name] END,
    list_reverse(list_filter(regexp_split_to_array(coalesce(s.namespace, ''), '\\.|::'), lambda x: x <> ''))), '/') || '/')"""
_RESOLVE_SQL = f"""WITH {_SPANS},
    ext AS (SELECT * FROM external_members QUALIFY row_number() OVER (PARTITION BY node ORDER BY id) = 1),
    forms AS (SELECT unnest([s.id, regexp_extract(s.id, '^([^(]*)\\(', 1), s.name, upper(s.name), o.name || '.' || s.name, s.namespace || '::' || s.name]) AS query FROM sym s LEFT JOIN sym o ON o.id = s.container_id
      UNION ALL SELECT file || ':' || line FROM at_line UNION ALL SELECT name FROM ext),
    q AS (SELECT DISTINCT trim(query) AS query FROM forms WHERE trim(query) <> ''),
    place AS (SELECT query, regexp_extract(query, '^(.+\\.[A-Za-z]+):(\\d+)$', 1) AS file, CAST(regexp_extract(query, '^(.+\\.[A-Za-z]+):(\\d+)$', 2) AS BIGINT) AS line FROM q WHERE regexp_matches(query, '^(.+\\.[A-Za-z]+):(\\d+)$')),
    chained AS (SELECT s.seq AS node, lower(s.name) AS name, {_CHAIN_SQL} AS chain FROM sym s LEFT JOIN sym o ON o.id = s.container_id),
    names AS (SELECT query, list_filter(regexp_split_to_array(lower(query), '\\.|::'), lambda x: x <> '') AS s FROM q),
    named AS (SELECT query, s[-1] AS name, '/' || array_to_string(list_transform(list_reverse(s[1:-2]), lambda x: regexp_escape(x)), '/(?:.*/)?') || '/' AS pattern, len(s) AS n FROM names WHERE len(s) > 0),
    whole AS (SELECT query, node FROM named JOIN chained USING (name) WHERE n = 1 OR regexp_matches(chain, pattern)),
    hits AS (
      SELECT query, node, 0 AS n FROM place JOIN spans ON spans.file = place.file AND "start" = line QUALIFY row_number() OVER (PARTITION BY query ORDER BY stop, node) = 1
      UNION ALL SELECT query, to_node, 1 FROM (SELECT query, to_node, row_number() OVER (PARTITION BY query ORDER BY coalesce(confidence, 0), edge_id) AS r FROM place JOIN at_line ON at_line.file = place.file AND at_line.line = place.line WHERE to_node IS NOT NULL) WHERE r = 1
      UNION ALL SELECT query, node, 2 FROM (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY "start" DESC, node) AS r FROM place JOIN spans ON spans.file = place.file AND "start" <= line AND line < stop) WHERE r = 1
      UNION ALL SELECT query, seq, 3 FROM q JOIN sym ON id = query
      UNION ALL SELECT query, seq, 4 FROM q JOIN sym ON contains(id, '~') AND regexp_replace(id, '~.*$', '') = query
      UNION ALL SELECT DISTINCT query, seq, 5 FROM q JOIN (SELECT seq, unnest(list_filter(list_transform(range(1, len(id) + 1), lambda i: CASE WHEN substring(id, i, 1) IN ('(', '~', '`') THEN substring(id, 1, i - 1) END), lambda x: x IS NOT NULL)) AS head FROM sym) ON head = query
      UNION ALL SELECT query, seq, 6 FROM q JOIN sym ON contains(id, '(') AND regexp_extract(id, '^([^(]*)\\(', 1) || '(' || regexp_replace(regexp_extract(id, '\\((.*)\\)', 1), '[\\w`.:]*[.:]([\\w`])', '\\1', 'g') || ')' = query
      UNION ALL SELECT query, node, 7 FROM whole
      UNION ALL SELECT query, node, 8 FROM (SELECT * FROM named WHERE query NOT IN (SELECT query FROM whole)) x JOIN chained ON contains(chained.name, x.name) WHERE n = 1 OR regexp_matches(chain, pattern)
      UNION ALL SELECT query, node, 9 FROM q JOIN ext ON ext.id = query UNION ALL SELECT query, node, 9 FROM q JOIN ext ON ext.name = query),
    best AS (SELECT DISTINCT * FROM hits QUALIFY n = min(n) OVER (PARTITION BY query)),
    kinds AS (SELECT best.*, kind, id, container_id FROM best LEFT JOIN sym ON seq = node),
    kept AS (SELECT k.*, coalesce(k.id, ext.id) AS any_id FROM kinds k LEFT JOIN ext USING (node) WHERE NOT (coalesce(k.kind, '') = 'Constructor' AND EXISTS (
      SELECT 1 FROM kinds t WHERE t.query = k.query AND t.id = k.container_id AND t.kind IN {TYPE_KINDS})))
    SELECT query, {list(STAGES)}[n + 1] AS stage, count(*) AS candidates, arg_min(node, (any_id, node)) AS node FROM kept GROUP BY query, n"""

_FIND = "id, kind, name, project, file"

_CALLS: dict[str, tuple] = {
    "resolve_symbols": (lambda r: resolve_symbols(r, asked_symbols(r)), _RESOLVE_SQL),
    "edges": (lambda r: r.edges, f"WITH {EDGES_SQL} SELECT * FROM edges"),
    "edge_kind_counts": (
        edge_kind_counts,
        f"WITH {EDGES_SQL} SELECT edge_kind, count(*) AS edges, CAST(sum(edge_count) AS BIGINT) AS occurrences, count(*) FILTER (WHERE NOT ({_SURE})) AS name_only FROM edges GROUP BY edge_kind",
    ),
    "derived_types": (
        lambda r: r.edges.where("edge_kind = 'Inherits'").select(F.col("to_node").alias("base"), F.col("from_node").alias("derived")).distinct(),
        f"WITH {EDGES_SQL} SELECT DISTINCT to_node AS base, from_node AS derived FROM edges WHERE edge_kind = 'Inherits'",
    ),
    "find_symbol_substring": (
        lambda r: nav.find_symbol(r, "chart"),
        f"WITH {SYM_SQL} SELECT {_FIND} FROM sym WHERE contains(lower(name), 'chart') ORDER BY (name = 'chart') DESC, (lower(name) = 'chart') DESC, length(name), id LIMIT 51",
    ),
    "find_symbol_exact": (
        lambda r: nav.find_symbol(r, "ringloader", exact=True),
        f"WITH {SYM_SQL} SELECT {_FIND} FROM sym WHERE lower(name) = 'ringloader' ORDER BY (name = 'ringloader') DESC, length(name), id LIMIT 51",
    ),
    "find_symbol_wildcard": (
        lambda r: nav.find_symbol(r, "*Load?r", kind="class"),
        f"WITH {SYM_SQL} SELECT {_FIND} FROM sym WHERE regexp_matches(name, '(?i)^.*load.r$') AND lower(kind) = 'class' ORDER BY (name = '*Load?r') DESC, (lower(name) = '*load?r') DESC, length(name), id LIMIT 51",
    ),
    "find_symbol_dotted": (
        lambda r: nav.find_symbol(r, "Vemetupe::P*", limit=200),
        f"""WITH {SYM_SQL}, chained AS (
              SELECT s.*, '/' || array_to_string(list_concat(CASE WHEN o.name IS NULL THEN [] ELSE [o.name] END,
                list_reverse(list_filter(regexp_split_to_array(coalesce(s.namespace, ''), '\\.|::'), lambda x: x <> ''))), '/') || '/' AS chain
              FROM sym s LEFT JOIN sym o ON o.id = s.container_id)
            SELECT {_FIND} FROM chained WHERE regexp_matches(name, '(?i)^p.*$') AND regexp_matches(chain, '(?i)/vemetupe/') ORDER BY length(name), id LIMIT 201""",
    ),
    "symbol_info": (
        symbol_info,
        f"""WITH {EDGES_SQL}, c AS (
              SELECT to_node, count(*) FILTER (WHERE edge_kind = 'Inherits') AS derived, count(*) FILTER (WHERE edge_kind = 'Implements') AS implementers,
                     count(*) FILTER (WHERE edge_kind = 'Overrides') AS overridden_by, count(*) FILTER (WHERE edge_kind = 'ImplementsMember') AS implemented_by, count(*) AS incoming
              FROM edges GROUP BY to_node)
            SELECT seq, id, kind, coalesce(derived, 0) AS derived, coalesce(implementers, 0) AS implementers, coalesce(overridden_by, 0) AS overridden_by,
                   coalesce(implemented_by, 0) AS implemented_by, coalesce(incoming, 0) AS incoming FROM sym LEFT JOIN c ON to_node = seq""",
    ),
    "type_members": (
        type_members,
        f"WITH {SYM_SQL} SELECT m.container_id, o.name AS type_name, m.id, m.kind, lower(m.accessibility) AS accessibility FROM sym m JOIN sym o ON o.id = m.container_id",
    ),
    "declaration_at": (
        nav.enclosing_declarations,
        f"""WITH {_SPANS} SELECT edge_id, node FROM at_line JOIN spans ON at_line.file = spans.file AND "start" <= line AND line < stop
            QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY "start" DESC, node) = 1""",
    ),
    "reference_at": (
        nav.reference_at_declaration,
        f"""WITH {_SPANS} SELECT spans.file, node, "start", edge_id, CAST(coalesce(confidence, 0) AS INTEGER) AS confidence
            FROM spans JOIN at_line ON at_line.file = spans.file AND line = "start"
            QUALIFY row_number() OVER (PARTITION BY spans.file, node, "start" ORDER BY coalesce(confidence, 0), edge_id) = 1""",
    ),
    "file_outline": (
        nav.file_outline,
        f"""WITH {_SPANS}, s AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY file, node ORDER BY "start", stop) = 1)
            SELECT a.file, a.node, a."start", count(b.node) AS depth FROM s a LEFT JOIN s b ON a.file = b.file AND b.stop > a."start"
             AND (b."start" < a."start" OR (b."start" = a."start" AND b.node < a.node)) GROUP BY ALL""",
    ),
    "find_references": (
        nav.references_by_target,
        f"""WITH {SYM_SQL}, {RAW_SQL} SELECT to_node, count(*) FILTER (WHERE {_SURE}) AS reference_count, count(*) FILTER (WHERE NOT ({_SURE})) AS name_only,
              count(DISTINCT CASE WHEN {_SURE} THEN file END) AS files, CAST(coalesce(sum(edge_count) FILTER (WHERE {_SURE}), 0) AS BIGINT) AS occurrences
            FROM raw LEFT JOIN sym ON seq = from_node WHERE to_node IN (SELECT seq FROM sym) GROUP BY to_node""",
    ),
    "references_by_file": (
        lambda r: nav.references_by_file(r, busiest(r)).select("file", "reference_count", F.size("lines").alias("line_count"), "is_test"),
        f"""WITH {SYM_SQL}, {RAW_SQL}, {BUSIEST_SQL} SELECT file, count(*) AS reference_count, CAST(count(first_line) AS INTEGER) AS line_count,
              regexp_matches(coalesce(file, ''), '(?i)(?:^|[\\\\/])[^\\\\/]*Tests?(?:[\\\\/.]|$)') AS is_test
            FROM raw LEFT JOIN sym ON seq = from_node WHERE to_node = (SELECT node FROM busiest) AND {_SURE} GROUP BY file""",
    ),
    "references_page": (
        lambda r: nav.references_page(r, busiest(r), limit=7, offset=3),
        f"""WITH {SYM_SQL}, {RAW_SQL}, {BUSIEST_SQL} SELECT edge_id, id AS caller, file, first_line FROM raw LEFT JOIN sym ON seq = from_node
            WHERE to_node = (SELECT node FROM busiest) AND {_SURE} ORDER BY file NULLS FIRST, first_line NULLS FIRST, edge_id LIMIT 7 OFFSET 3""",
    ),
    "find_callers": (
        nav.callers,
        f"""WITH {SYM_SQL}, {RAW_SQL} SELECT to_node, CAST(coalesce(sum(edge_count) FILTER (WHERE {_SURE}), 0) AS BIGINT) AS call_sites,
              count(DISTINCT CASE WHEN {_SURE} THEN coalesce(from_node, -1) END) AS distinct_callers,
              count(DISTINCT CASE WHEN {_SURE} AND regexp_matches(coalesce(file, ''), '(?i)(?:^|[\\\\/])[^\\\\/]*Tests?(?:[\\\\/.]|$)') THEN from_node END) AS test_callers,
              CAST(coalesce(sum(edge_count) FILTER (WHERE NOT ({_SURE})), 0) AS BIGINT) AS name_only_sites
            FROM raw LEFT JOIN sym ON seq = from_node WHERE to_node IN (SELECT seq FROM sym WHERE kind IN ('Method', 'Constructor', 'Destructor', 'Operator', 'Function', 'Macro')) GROUP BY to_node""",
    ),
    "find_callees": (
        nav.callees,
        f"""WITH {SYM_SQL}, {RAW_SQL}, g AS (
              SELECT from_node, to_node, CAST(sum(edge_count) AS BIGINT) AS sites, min(first_line) AS first_line, CAST(min(coalesce(confidence, 0)) AS INTEGER) AS confidence
              FROM raw WHERE to_node IS NOT NULL AND {_SURE} GROUP BY ALL),
            n AS (SELECT g.*, s.id AS inside_id, e.id AS outside_id, CASE WHEN s.id IS NOT NULL THEN 'workspace' WHEN e.id IS NOT NULL THEN 'external' ELSE 'unresolved' END AS place
                  FROM g LEFT JOIN sym s ON s.seq = to_node LEFT JOIN external_members e ON e.node = to_node)
            SELECT from_node, to_node, coalesce(inside_id, outside_id) AS target, place, sites, first_line, confidence FROM n WHERE NOT (place = 'external' AND regexp_matches(outside_id, '^[TF]:'))""",
    ),
    "reference_counts": (
        reference_counts,
        f"""WITH {SYM_SQL}, {RAW_SQL}, c AS (
              SELECT coalesce(f.project, '(workspace)') AS project,
                count(*) FILTER (WHERE t.seq IS NOT NULL AND coalesce(confidence, 0) = 0) AS exact, count(*) FILTER (WHERE t.seq IS NOT NULL AND confidence = 1) AS inferred,
                count(*) FILTER (WHERE t.seq IS NOT NULL AND confidence = 2) AS name_only, count(*) FILTER (WHERE t.seq IS NULL AND e.node IS NOT NULL) AS external,
                count(*) FILTER (WHERE t.seq IS NULL AND e.node IS NULL) AS unresolved
              FROM raw LEFT JOIN sym f ON f.seq = from_node LEFT JOIN sym t ON t.seq = to_node LEFT JOIN external_members e ON e.node = to_node WHERE to_node IS NOT NULL GROUP BY 1)
            SELECT *, CASE WHEN exact + inferred + name_only > 0 THEN round_even(name_only / (exact + inferred + name_only), 4) ELSE 0.0 END AS name_only_share FROM c""",
    ),
    "test_paths": (
        tests_of_paths,
        "SELECT DISTINCT path, regexp_matches(path, '(?i)(?:^|[\\\\/])[^\\\\/]*Tests?(?:[\\\\/.]|$)') AS is_test FROM source_documents WHERE path IS NOT NULL",
    ),
    "glob_match": (glob_match, "SELECT DISTINCT path FROM source_documents WHERE regexp_matches(path, '(?i)^repos/(?:[^/]+/)*[^/]*er\\.cs$')"),
}

QUERIES = {name: (lambda spark, folder, f=f: f(Relations(spark, folder))) for name, (f, _) in _CALLS.items()}
SQL = {name: sql for name, (_, sql) in _CALLS.items()}
