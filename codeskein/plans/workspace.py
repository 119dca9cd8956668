"""Queries of workspace status, diagnostics, projects, files and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.functions.paths import base_name, common_directories, framework_family, framework_major, framework_symbols, slashed
from codeskein.operators import incremental as inc
from codeskein.operators.closure import closure
from codeskein.plans.graph import steps_sql
from codeskein.relations import NEWEST_SQL, RAW_SQL, SYM_SQL, Relations
from codeskein.session import materialize

CUTOFF = "2025-06-01 00:00:00"


def projects(rel: Relations) -> DataFrame:
    return rel.table("projects").dropDuplicates(["name"])


def status(rel: Relations) -> DataFrame:
    """Counters of the whole workspace, one row; each is an aggregate of its own table."""
    parts = [
        projects(rel).agg(F.count(F.lit(1)).alias("projects")),
        rel.newest_sources.agg(F.count(F.lit(1)).alias("documents"), F.count("failure").alias("failures")),
        rel.symbols.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files")),
        rel.references.agg(F.count(F.lit(1)).alias("reference_count")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(F.broadcast(p))
    return whole


def problems(rel: Relations) -> DataFrame:
    """Failures and syntax errors of the newest state of every file."""
    s = rel.newest_sources
    failures = s.where("failure IS NOT NULL").select("path", "project", F.lit("Load").alias("stage"), F.col("failure").alias("message"))
    errors = s.select("path", "project", F.explode("errors").alias("e")).select("path", "project", F.lit("Syntax").alias("stage"), F.col("e.message").alias("message"))
    return failures.unionByName(errors)


def diagnostics_by_project(rel: Relations) -> DataFrame:
    by = problems(rel).groupBy(F.coalesce("project", F.lit("(workspace)")).alias("project"))
    return by.agg(F.count(F.lit(1)).alias("problems"), F.count(F.when(F.col("stage") == "Syntax", 1)).alias("syntax"), F.countDistinct("path").alias("files"))


def diagnostics_for_suffix(rel: Relations) -> DataFrame:
    return problems(rel).where(F.lower("path").endswith(".cs")).groupBy("message").agg(F.count(F.lit(1)).alias("problems"))


def project_reports(rel: Relations) -> DataFrame:
    """Every project with its documents and references to other projects; none count as 0."""
    docs = rel.newest_sources.groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("documents"), F.count("failure").alias("failures"))
    return projects(rel).select("name", F.size("project_references").alias("project_references")).join(docs, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "failures")})


def newest_reports(rel: Relations) -> DataFrame:
    reports = rel.table("load_reports").where("project IS NOT NULL")
    newest = reports.groupBy("project").agg(F.max_by(F.struct("report_id", "snapshot_kind", "document_count", "files_with_parse_errors"), F.struct("loaded_at", "report_id")).alias("x"), F.countDistinct("report_id").alias("loads"))
    return newest.select("project", "loads", "x.*")


def project_links(rel: Relations) -> DataFrame:
    return projects(rel).select(slashed(F.col("path")).alias("src"), F.explode("project_references").alias("dst")).select("src", slashed(F.col("dst")).alias("dst")).distinct()


def project_closure(rel: Relations) -> DataFrame:
    """Projects reached by references from the one with most; unknown ones are listed elsewhere."""
    links = project_links(rel)
    known = projects(rel).select(slashed(F.col("path")).alias("dst"))
    first = links.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    seeds = rel.spark.createDataFrame([(first["src"] if first else "",)], "node string")
    return closure(seeds, links.join(known, "dst", "left_semi"))


def missing_projects(rel: Relations) -> DataFrame:
    return project_links(rel).join(projects(rel).select(slashed(F.col("path")).alias("dst")), "dst", "left_anti").select("src", "dst")


def listed_sources(rel: Relations) -> DataFrame:
    return projects(rel).select(F.col("path").alias("project_path"), "name", F.explode("sources").alias("file")).select("project_path", "name", slashed(F.col("file")).alias("file")).distinct()


def file_owners(rel: Relations) -> DataFrame:
    """The first project, by path, that lists a file."""
    return listed_sources(rel).groupBy("file").agg(F.min_by("name", "project_path").alias("project"))


def unlisted_files(rel: Relations) -> DataFrame:
    return rel.newest_sources.select("path").join(listed_sources(rel).select(F.col("file").alias("path")).distinct(), "path", "left_anti")


def hash_agreement(rel: Relations) -> DataFrame:
    """Files whose recorded hash is that of their text, by language."""
    texts = rel.table("documents").select("doc_id", F.upper(F.sha2(F.col("text").cast("binary"), 256)).alias("text_hash"))
    met = rel.newest_sources.where("doc_id IS NOT NULL").join(texts, "doc_id")
    return met.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("hash") == F.col("text_hash"), 1)).alias("agreeing"))


def frameworks(rel: Relations) -> DataFrame:
    t = F.col("target_framework")
    return projects(rel).select("name", framework_family(t).alias("family"), framework_major(t).alias("major"), F.array_join(framework_symbols(t), ";").alias("symbols"))


def best_frameworks(rel: Relations) -> DataFrame:
    """For every project the best of all target frameworks in use that is compatible: of its family, none newer."""
    t = F.col("target_framework")
    own = projects(rel).select("name", framework_family(t).alias("family"), framework_major(t).alias("major")).where("family IS NOT NULL")
    offered = projects(rel).select(t.alias("folder"), framework_family(t).alias("family"), framework_major(t).alias("offered")).where("family IS NOT NULL").distinct()
    fits = own.join(offered, "family").where("offered <= major")
    order = Window.partitionBy("name").orderBy(F.desc("offered"), F.desc("folder"))
    return fits.withColumn("n", F.row_number().over(order)).where("n = 1").select("name", "folder")


def common_options(rel: Relations) -> DataFrame:
    counts = projects(rel).groupBy("repo", "language", "language_version").agg(F.count(F.lit(1)).alias("projects"))
    order = Window.partitionBy("repo", "language").orderBy(F.desc("projects"), "language_version")
    return counts.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def project_keys(rel: Relations) -> DataFrame:
    """A hash of each project's sorted sources, which tells whether its set of files changed."""
    return listed_sources(rel).groupBy("name").agg(F.upper(F.sha2(F.array_join(F.array_sort(F.collect_set("file")), "\n"), 256)).alias("key"))


def includes(rel: Relations) -> DataFrame:
    """Quoted includes of C++ files and the file meant: of all files of that name the one whose path shares most
    directories with the including file; ties go to the lower path."""
    docs = rel.table("documents").where(F.lower(F.trim("source")) == "repo").where(F.col("path").rlike(r"\.(?:h|hpp|cc|cpp)$"))
    found = docs.select("path", F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*"([^"\n]+)"'), F.lit(1))).alias("include")).distinct()
    found = found.withColumn("name", F.lower(base_name(F.col("include"))))
    files = rel.newest_sources.select(F.col("path").alias("target"), F.lower(base_name(F.col("path"))).alias("name"))
    met = found.join(files, "name").withColumn("shared", common_directories(F.col("path"), F.col("target")))
    return met.groupBy("path", "include").agg(F.max_by("target", F.struct("shared", F.lit(0))).alias("any"), F.max("shared").alias("shared"), F.min_by("target", F.struct(-F.col("shared"), F.col("target"))).alias("target")).drop("any")


def include_closure(rel: Relations) -> DataFrame:
    """Files reached by quoted includes from the file that includes most, with the number of steps."""
    links = materialize(includes(rel).select(F.col("path").alias("src"), F.col("target").alias("dst")))
    first = links.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return closure(rel.spark.createDataFrame([(first["src"] if first else "",)], "node string"), links)


def unique_names(rel: Relations) -> DataFrame:
    """File names that stand for exactly one path."""
    return rel.newest_sources.groupBy(base_name(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1").select("name", "path")


def simplified_ids(rel: Relations) -> DataFrame:
    """Ids with the parameter types' namespaces left out."""
    inside = F.regexp_extract("id", r"\(([^()]*)\)", 1)
    return rel.symbols.where(F.col("id").contains("(")).select("seq", F.regexp_replace(inside, r"[\w`.:]*[.:](?=[\w`])", "").alias("parameters"))


def token_estimates(rel: Relations) -> DataFrame:
    items = rel.table("context_items").dropDuplicates(["item_id"])
    return items.groupBy("request_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.floor((80 + F.coalesce(F.length("code"), F.lit(0))) / 4)).cast("long").alias("tokens"), F.max(F.coalesce("token_budget", F.lit(4000))).alias("budget"))


def budget_fill(rel: Relations) -> DataFrame:
    """Greedy choice of each request's items in order of distance: an item is taken if it still fits, else skipped and
    the scan goes on; the fold keeps the taken total of a request in one array pass."""
    items = rel.table("context_items").where("request_id IS NOT NULL").dropDuplicates(["item_id"])
    size = F.floor((80 + F.coalesce(F.length("code"), F.lit(0))) / 4).cast("long")
    lists = items.groupBy("request_id").agg(F.max(F.coalesce("token_budget", F.lit(4000))).cast("long").alias("budget"), F.array_sort(F.collect_list(F.struct("distance", "item_id", size.alias("size")))).alias("items"))
    taken = F.aggregate("items", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")), lambda a, x: F.when(a["used"] + x["size"] <= F.col("budget"), F.struct((a["used"] + x["size"]).alias("used"), (a["n"] + 1).alias("n"))).otherwise(a))
    return lists.select("request_id", "budget", F.size("items").alias("items"), taken.alias("t")).select("request_id", "budget", "items", F.col("t.used").alias("used"), F.col("t.n").alias("taken"))


def states(rel: Relations) -> tuple[DataFrame, DataFrame]:
    """Files as known at a point of time, and as known last; files without a text are gone."""
    s = rel.table("source_documents").where(F.col("path").isNotNull())
    newest = lambda rows: rows.groupBy("path").agg(F.max_by(F.struct("hash", "project", "doc_id"), F.struct("loaded_at", "doc_id")).alias("x")).select("path", "x.*")
    before = newest(s.where(F.col("loaded_at") < F.lit(CUTOFF).cast("timestamp_ntz")))
    return before.select("path", "hash", "project"), newest(s).where("doc_id IS NOT NULL").select("path", "hash", "project")


def edited(rel: Relations) -> tuple[DataFrame, DataFrame]:
    """Declaration prints before and after a fixed edit: some signatures differ, some symbols are gone."""
    s = rel.symbols
    after = s.where(F.col("seq") % 19 != 0).withColumn("signature", F.when(F.col("seq") % 17 == 0, F.concat("signature", F.lit(" ?"))).otherwise(F.col("signature")))
    return inc.prints(s), inc.prints(after)


_P = "p AS (SELECT * FROM projects QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1)"
_SLASH = "regexp_replace(replace({0}, '\\', '/'), '^(?:\\./)+', '')"
_LISTED = f"listed AS (SELECT DISTINCT project_path, name, {_SLASH.format('file')} AS file FROM (SELECT path AS project_path, name, unnest(sources) AS file FROM p))"
_LINKS = f"links AS (SELECT DISTINCT {_SLASH.format('path')} AS src, {_SLASH.format('dst')} AS dst FROM (SELECT path, unnest(project_references) AS dst FROM p))"
_FAMILY = "CASE WHEN regexp_matches(target_framework, '(?i)^netstandard\\d') THEN 'standard' WHEN regexp_matches(target_framework, '(?i)^(netcoreapp\\d|net([5-9]|\\d\\d)\\.\\d)') THEN 'core' WHEN regexp_matches(target_framework, '(?i)^net[1-4]\\d{1,2}') THEN 'framework' END"
_MAJOR = f"TRY_CAST(CASE WHEN {_FAMILY} = 'framework' THEN left(regexp_extract(target_framework, '(?i)^(?:netstandard|netcoreapp|net)(\\d+)', 1), 1) ELSE regexp_extract(target_framework, '(?i)^(?:netstandard|netcoreapp|net)(\\d+)', 1) END AS INTEGER)"
_PROBLEMS = "problems AS (SELECT path, project, 'Load' AS stage, failure AS message FROM newest WHERE failure IS NOT NULL UNION ALL SELECT path, project, 'Syntax', e.message FROM (SELECT path, project, unnest(errors) AS e FROM newest))"
_STATES = f"""b AS (SELECT path, hash, project FROM source_documents WHERE path IS NOT NULL AND loaded_at < TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC, doc_id DESC NULLS LAST) = 1),
    a AS (SELECT path, hash, project FROM (SELECT * FROM source_documents WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC, doc_id DESC NULLS LAST) = 1) WHERE doc_id IS NOT NULL)"""
_DETAILS = "kind || '|' || {sig} || '|' || coalesce(return_type, '') || '|' || lower(accessibility) || '|' || array_to_string(modifiers, ' ')"
_PRINTS = f"""{SYM_SQL},
    before AS (SELECT file, id, name, kind, {_DETAILS.format(sig='signature')} AS details FROM sym),
    after AS (SELECT file, id, name, kind, {_DETAILS.format(sig="CASE WHEN seq % 17 = 0 THEN signature || ' ?' ELSE signature END")} AS details FROM sym WHERE seq % 19 <> 0),
    diff AS (SELECT *, 'before' AS side FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after) UNION ALL SELECT *, 'after' FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before))"""

_INCLUDES = """i AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?m)^[ \\t]*#[ \\t]*include[ \\t]*"([^"\\n]+)"', 1)) AS include FROM documents WHERE lower(trim(source)) = 'repo' AND regexp_matches(path, '\\.(?:h|hpp|cc|cpp)$')),
    m AS (SELECT i.path, include, n.path AS target, string_split(i.path, '/')[1:-2] AS x, string_split(n.path, '/')[1:-2] AS y FROM i JOIN newest n ON lower(regexp_extract(include, '([^/\\\\]*)$', 1)) = lower(regexp_extract(n.path, '([^/\\\\]*)$', 1))),
    s AS (SELECT path, include, target, CAST(len(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[1:k] = y[1:k])) AS INTEGER) AS shared FROM m),
    resolved AS (SELECT path, include, target, shared FROM s QUALIFY row_number() OVER (PARTITION BY path, include ORDER BY shared DESC, target) = 1)"""

_CALLS: dict[str, tuple] = {
    "workspace_status": (
        status,
        f"""WITH {SYM_SQL}, {RAW_SQL}, {NEWEST_SQL}, {_P} SELECT (SELECT count(*) FROM p) AS projects, (SELECT count(*) FROM newest) AS documents, (SELECT count(failure) FROM newest) AS failures,
            (SELECT count(*) FROM sym) AS symbols, (SELECT count(DISTINCT file) FROM sym) AS files, (SELECT count(*) FROM raw) AS reference_count""",
    ),
    "diagnostics_by_project": (
        diagnostics_by_project,
        f"WITH {NEWEST_SQL}, {_PROBLEMS} SELECT coalesce(project, '(workspace)') AS project, count(*) AS problems, count(*) FILTER (WHERE stage = 'Syntax') AS syntax, count(DISTINCT path) AS files FROM problems GROUP BY 1",
    ),
    "diagnostics_for_suffix": (diagnostics_for_suffix, f"WITH {NEWEST_SQL}, {_PROBLEMS} SELECT message, count(*) AS problems FROM problems WHERE lower(path) LIKE '%.cs' GROUP BY message"),
    "project_reports": (
        project_reports,
        f"""WITH {NEWEST_SQL}, {_P}, d AS (SELECT project, count(*) AS documents, count(failure) AS failures FROM newest GROUP BY project)
            SELECT name, CAST(len(project_references) AS INTEGER) AS project_references, coalesce(documents, 0) AS documents, coalesce(failures, 0) AS failures FROM p LEFT JOIN d ON d.project = name""",
    ),
    "newest_reports": (
        newest_reports,
        """SELECT project, loads, report_id, snapshot_kind, document_count, files_with_parse_errors FROM (SELECT *, count(DISTINCT report_id) OVER (PARTITION BY project) AS loads FROM load_reports WHERE project IS NOT NULL)
           QUALIFY row_number() OVER (PARTITION BY project ORDER BY loaded_at DESC, report_id DESC, snapshot_kind DESC) = 1""",
    ),
    "project_closure": (
        project_closure,
        f"""WITH RECURSIVE {_P}, {_LINKS}, known AS (SELECT {_SLASH.format('path')} AS path FROM p), ok AS (SELECT * FROM links WHERE dst IN (SELECT path FROM known)),
            {steps_sql('w', "SELECT (SELECT src FROM links GROUP BY src ORDER BY count(*) DESC, src LIMIT 1) AS node, 0 AS depth", 'SELECT * FROM ok')}
            SELECT node, CAST(depth AS INTEGER) AS depth FROM w""",
    ),
    "missing_projects": (missing_projects, f"WITH {_P}, {_LINKS} SELECT src, dst FROM links WHERE dst NOT IN (SELECT {_SLASH.format('path')} FROM p)"),
    "file_owners": (file_owners, f"WITH {_P}, {_LISTED} SELECT file, name AS project FROM listed QUALIFY row_number() OVER (PARTITION BY file ORDER BY project_path, name) = 1"),
    "unlisted_files": (unlisted_files, f"WITH {NEWEST_SQL}, {_P}, {_LISTED} SELECT path FROM newest WHERE path NOT IN (SELECT file FROM listed)"),
    "hash_agreement": (
        hash_agreement,
        f"WITH {NEWEST_SQL} SELECT n.language, count(*) AS files, count(*) FILTER (WHERE hash = upper(sha256(text))) AS agreeing FROM newest n JOIN documents d ON d.doc_id = n.doc_id GROUP BY n.language",
    ),
    "framework_symbols": (
        frameworks,
        f"""WITH {_P}, f AS (SELECT name, {_FAMILY} AS family, {_MAJOR} AS major FROM p)
            SELECT name, family, major, CASE WHEN family = 'core' AND major >= 5 THEN 'NET;NET' || major || '_0;' || array_to_string(list_transform(range(5, major + 1), lambda k: 'NET' || k || '_0_OR_GREATER'), ';') ELSE '' END AS symbols FROM f""",
    ),
    "best_framework": (
        best_frameworks,
        f"""WITH {_P}, f AS (SELECT name, target_framework AS folder, {_FAMILY} AS family, {_MAJOR} AS major FROM p), o AS (SELECT DISTINCT folder, family, major FROM f WHERE family IS NOT NULL)
            SELECT name, o.folder FROM f JOIN o ON o.family = f.family AND o.major <= f.major QUALIFY row_number() OVER (PARTITION BY name ORDER BY o.major DESC, o.folder DESC) = 1""",
    ),
    "common_options": (
        common_options,
        f"WITH {_P}, c AS (SELECT repo, language, language_version, count(*) AS projects FROM p GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, language ORDER BY projects DESC, language_version) = 1",
    ),
    "project_keys": (project_keys, f"WITH {_P}, {_LISTED} SELECT name, upper(sha256(array_to_string(list_sort(list(DISTINCT file)), chr(10)))) AS key FROM listed GROUP BY name"),
    "include_resolution": (includes, f"WITH {NEWEST_SQL}, {_INCLUDES} SELECT * FROM resolved"),
    "include_closure": (
        include_closure,
        f"""WITH RECURSIVE {NEWEST_SQL}, {_INCLUDES}, links AS (SELECT DISTINCT path AS src, target AS dst FROM resolved),
            {steps_sql('w', "SELECT coalesce((SELECT src FROM (SELECT path AS src FROM resolved) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), '') AS node, 0 AS depth", 'SELECT * FROM links')}
            SELECT node, CAST(depth AS INTEGER) AS depth FROM w""",
    ),
    "unique_file_names": (unique_names, f"WITH {NEWEST_SQL} SELECT regexp_extract(path, '([^/\\\\]*)$', 1) AS name, min(path) AS path FROM newest GROUP BY 1 HAVING count(*) = 1"),
    "simplify_parameters": (
        simplified_ids,
        f"WITH {SYM_SQL} SELECT seq, regexp_replace(regexp_extract(id, '\\(([^()]*)\\)', 1), '[\\w`.:]*[.:]([\\w`])', '\\1', 'g') AS parameters FROM sym WHERE contains(id, '(')",
    ),
    "token_estimates": (
        token_estimates,
        """WITH i AS (SELECT * FROM context_items QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY served_at) = 1)
           SELECT request_id, count(*) AS items, CAST(sum((80 + coalesce(length(code), 0)) // 4) AS BIGINT) AS tokens, max(coalesce(token_budget, 4000)) AS budget FROM i GROUP BY request_id""",
    ),
    "budget_fill": (
        budget_fill,
        """WITH RECURSIVE i AS (SELECT * FROM context_items WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY served_at) = 1),
            o AS (SELECT request_id, (80 + coalesce(length(code), 0)) // 4 AS size, max(coalesce(token_budget, 4000)) OVER (PARTITION BY request_id) AS budget,
                  row_number() OVER (PARTITION BY request_id ORDER BY distance NULLS FIRST, item_id NULLS FIRST) AS n FROM i),
            f(request_id, n, used, taken) AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM o
              UNION ALL SELECT o.request_id, o.n, CASE WHEN used + size <= budget THEN used + size ELSE used END, CASE WHEN used + size <= budget THEN taken + 1 ELSE taken END FROM f JOIN o ON o.request_id = f.request_id AND o.n = f.n + 1)
            SELECT request_id, CAST((SELECT max(budget) FROM o WHERE o.request_id = f.request_id) AS BIGINT) AS budget, CAST(n AS INTEGER) AS items, used, taken FROM f
            QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC) = 1""",
    ),
    "changed_documents": (
        lambda r: inc.document_changes(*states(r)),
        f"""WITH {_STATES} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed'
            WHEN a.hash IS NOT DISTINCT FROM b.hash AND a.project IS NOT DISTINCT FROM b.project THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path""",
    ),
    "removed_documents": (
        lambda r: inc.document_changes(*states(r)).where("change = 'removed'").select("path"),
        f"WITH {_STATES} SELECT path FROM b WHERE path NOT IN (SELECT path FROM a)",
    ),
    "snapshot_diff": (lambda r: inc.differing_prints(*edited(r)).groupBy("side", "kind").agg(F.count(F.lit(1)).alias("prints")), f"WITH {_PRINTS} SELECT side, kind, count(*) AS prints FROM diff GROUP BY ALL"),
    "changed_names": (lambda r: inc.changed_names(*edited(r)), f"WITH {_PRINTS} SELECT DISTINCT name FROM diff"),
    "rebind_all": (
        lambda r: inc.rebinds_everything(*edited(r)),
        f"WITH {_PRINTS} SELECT count(*) > 0 AS rebind_all FROM (SELECT id FROM diff WHERE kind IN ('Class', 'Struct', 'Interface', 'Enum', 'Namespace') GROUP BY id HAVING count(DISTINCT side) > 1 UNION ALL SELECT id FROM diff WHERE kind IN ('Operator', 'Destructor', 'Macro', 'Extension'))",
    ),
    "rebind_set": (
        lambda r: inc.files_to_bind(r, inc.changed_names(*edited(r))),
        f"""WITH {_PRINTS}, {RAW_SQL}, {NEWEST_SQL}, w AS (SELECT DISTINCT newest.path, unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]*')) AS name FROM newest JOIN documents USING (doc_id))
            SELECT path AS file FROM w WHERE name IN (SELECT name FROM diff) UNION SELECT f.file FROM raw JOIN sym f ON f.seq = from_node JOIN sym t ON t.seq = to_node WHERE t.name IN (SELECT name FROM diff)""",
    ),
    "debounced_batches": (
        lambda r: inc.debounced(r.table("source_documents").where("project IS NOT NULL"), "project", "loaded_at", "10 days"),
        """WITH o AS (SELECT project, loaded_at, CASE WHEN loaded_at - lag(loaded_at) OVER (PARTITION BY project ORDER BY loaded_at) <= INTERVAL 10 DAY THEN 0 ELSE 1 END AS starts FROM source_documents WHERE project IS NOT NULL AND loaded_at IS NOT NULL),
           s AS (SELECT *, sum(starts) OVER (PARTITION BY project ORDER BY loaded_at ROWS UNBOUNDED PRECEDING) AS n FROM o)
           SELECT project, count(*) AS events, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM s GROUP BY project, n""",
    ),
}

QUERIES = {name: (lambda spark, folder, f=f: f(Relations(spark, folder))) for name, (f, _) in _CALLS.items()}
SQL = {name: sql for name, (_, sql) in _CALLS.items() if sql}
