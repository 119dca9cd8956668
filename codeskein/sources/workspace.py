"""A folder of projects turned into the tables that the queries read."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.lang.declarations import extract_declarations, name_references
from codeskein.operators.hierarchy import implementation_links, override_links
from codeskein.operators.navigation import innermost_spans
from codeskein.operators.order import numbered
from codeskein.relations import EXACT, INFERRED, NAME_ONLY, is_callable, is_type
from codeskein.session import materialize
from codeskein.sources.files import read_sources
from codeskein.sources.projects import read_workspace

FIRST_NODE = 1000
MODIFIERS = ("static", "virtual", "abstract", "override", "sealed", "async", "readonly", "const", "partial", "extern", "inline", "constexpr")
_PARAMETER = r"^(.*\S) (\w+)(?: = (.*))?$"
# Columns of the tables that a load leaves empty.
EMPTY = {
    "external_members": "node long, id string, assembly string, kind string, name string",
    "caller_totals": "symbol_node long, total_call_sites int, distinct_callers int, name_only_call_sites int, reported_at timestamp",
    "search_hits": "hit_id long, query string, node long, score double, terms array<string>, searched_at timestamp",
}


def _parameters(signature: Column) -> Column:
    """name, type, modifier and default of each parameter of a signature whose tokens are parted by blanks."""
    each = F.filter(F.split(F.regexp_extract(signature, r"\( (.*) \)", 1), " , "), lambda x: F.trim(x) != "")
    word = F.lit(r"^(?:(ref|out|in|params|this) )?(.*)$")

    def one(p: Column) -> Column:
        kind, default = F.regexp_extract(p, _PARAMETER, 1), F.regexp_extract(p, _PARAMETER, 3)
        bare = F.when(kind == "", p).otherwise(kind)
        modifier, name = F.regexp_extract_all(bare, word, F.lit(1))[0], F.regexp_extract(p, _PARAMETER, 2)
        plain = F.regexp_replace(F.regexp_replace(bare, r"^(?:ref|out|in|params|this) ", ""), " ", "")
        return F.struct(name.alias("name"), plain.alias("type"), F.nullif(modifier, F.lit("")).alias("modifier"), F.nullif(default, F.lit("")).alias("default_value"))

    return F.transform(each, one)


def _symbols(declared: DataFrame) -> DataFrame:
    """The table of symbols: a declaration that comes in several parts is one symbol, of its first file."""
    kinds = F.concat(F.lit("("), F.array_join(F.transform("parameters", lambda p: p["type"]), ","), F.lit(")"))
    with_parts = declared.withColumn("parameters", F.when(is_callable(F.col("kind")), _parameters(F.col("signature"))))
    with_parts = with_parts.withColumn("id", F.when(F.size("parameters") > 0, F.concat("id", kinds)).otherwise(F.col("id")))
    modifiers = F.filter(F.split("signature", " "), lambda w: w.isin(*MODIFIERS))
    first = with_parts.withColumn("modifiers", modifiers).groupBy("id").agg(F.min_by(F.struct(*[c for c in with_parts.columns if c != "id"], "modifiers"), F.struct("path", "line")).alias("x"), F.array_distinct(F.flatten(F.collect_list("base_types"))).alias("bases"))
    return numbered(first.select("id", "x.*", "bases"), "id").withColumn("seq", F.col("position") + FIRST_NODE).drop("position", "total", "base_types")


def _hierarchy(symbols: DataFrame) -> DataFrame:
    """Edges of bases, members and what they override: from_node, to_node, edge_kind, confidence, first_line.

    A base is the type of its name in the same name space, else the only one of that name; a base that is declared as an
    interface, or else is named as one by convention, is implemented and not inherited from.
    """
    types = symbols.where(is_type(F.col("kind")))
    wanted = types.select(F.col("seq").alias("from_node"), F.col("namespace").alias("own"), F.explode("bases").alias("name"), F.col("line").alias("first_line"), "language")
    met = wanted.join(types.select(F.col("seq").alias("to_node"), "name", "namespace", "language", F.col("kind").alias("to_kind")), ["name", "language"]).where("from_node <> to_node")
    near = F.coalesce(F.col("own") == F.col("namespace"), F.lit(False))
    by_base = Window.partitionBy("from_node", "name")
    met = met.withColumn("near", near).withColumn("any_near", F.max("near").over(by_base)).withColumn("n", F.count(F.lit(1)).over(by_base)).where("near OR (NOT any_near AND n = 1)")
    face = (F.col("to_kind") == "Interface") | ((F.col("to_kind") != "Class") & F.col("name").rlike(r"^I\p{Lu}"))
    bases = materialize(met.select("from_node", "to_node", F.when(face, "Implements").otherwise("Inherits").alias("edge_kind"), F.lit(EXACT).alias("confidence"), "first_line").distinct())
    owner = symbols.select(F.col("id").alias("container_id"), F.col("seq").alias("from_node"))
    inside = symbols.join(owner, "container_id").select("from_node", F.col("seq").alias("to_node"), F.lit("Contains").alias("edge_kind"), F.lit(EXACT).alias("confidence"), F.col("line").alias("first_line"))

    def along(kind: str) -> DataFrame:
        return bases.where(F.col("edge_kind") == kind).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))

    number = symbols.select("id", "seq", "line")
    over = override_links(symbols, along("Inherits")).select(F.col("member_id").alias("id"), "base_member_id", F.lit("Overrides").alias("edge_kind"))
    done = implementation_links(symbols, along("Inherits"), along("Implements")).select(F.col("member_id").alias("id"), F.col("interface_member_id").alias("base_member_id"), F.lit("ImplementsMember").alias("edge_kind"))
    members = over.unionByName(done).join(number, "id").join(number.select(F.col("id").alias("base_member_id"), F.col("seq").alias("to_node")), "base_member_id")
    return bases.unionByName(inside).unionByName(members.select(F.col("seq").alias("from_node"), "to_node", "edge_kind", F.lit(EXACT).alias("confidence"), F.col("line").alias("first_line")).distinct())


def _references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of names used inside declarations, from the innermost declaration around the use to what has the name."""
    uses = name_references(files, symbols)
    spans = symbols.select(F.col("path").alias("file"), F.col("seq").alias("node"), F.col("line").cast("long").alias("start"), (F.col("stop_line") + 1).cast("long").alias("end"))
    at = uses.select(F.col("path").alias("file"), F.col("line").cast("long").alias("line"), "name", "target", "candidates")
    target = symbols.select(F.col("id").alias("target"), F.col("seq").alias("to_node"), "kind", F.col("line").alias("own_line"), F.col("path").alias("own_file"))
    met = at.join(innermost_spans(at, spans), ["file", "line"]).join(target, "target")
    met = met.where(~((F.col("own_file") == F.col("file")) & (F.col("own_line") == F.col("line"))) & (F.col("node") != F.col("to_node")))
    kind = F.when(is_type(F.col("kind")), "ReferencesType").when(is_callable(F.col("kind")), "Calls").otherwise("Uses")
    grade = F.when(F.col("candidates") > 1, NAME_ONLY).otherwise(INFERRED)
    return met.select(F.col("node").alias("from_node"), "to_node", kind.alias("edge_kind"), grade.alias("confidence"), F.col("line").cast("int").alias("first_line"))


def load_workspace(spark: SparkSession, root: str, out: str, configuration: str = "Debug", platform: str = "AnyCPU") -> DataFrame:
    """Read the solution, projects or folder at ``root`` and write its tables below ``out``; gives a report per project:
    project, document_count, symbol_count, files_with_parse_errors, problems.

    Names are bound without types: to the only declaration of the name (inferred), else to all of them (by name only).
    Project files are read on the driver, as there are few; sources, declarations and edges are Spark jobs. Files of the
    projects that are not there have no document; a file of several projects belongs to the first by path.
    """
    began = time.time()
    projects, problems = read_workspace(root, configuration, platform)
    fields = "path string, name string, repo string, sdk string, target_framework string, language string, language_version string, preprocessor_symbols array<string>, project_references array<string>, usings array<string>, sources array<string>, generated_sources array<string>"
    rows = [(p.path, p.name, None, p.sdk, p.target_framework or "", p.language, p.language_version, p.preprocessor_symbols, p.project_references, p.usings, p.sources, []) for p in projects]
    table = spark.createDataFrame(rows, fields)
    table.write.parquet(f"{out}/projects.parquet")
    listed = spark.read.parquet(f"{out}/projects.parquet").select(F.explode("sources").alias("path"), "name", "language", F.col("path").alias("of"))
    listed = listed.groupBy("path").agg(F.min_by(F.struct("name", "language"), "of").alias("x")).select("path", F.col("x.name").alias("project"), F.col("x.language").alias("language"))
    found = materialize(read_sources(spark, root if not root.endswith((".sln", ".slnx", ".csproj", ".vcxproj")) else root.rpartition("/")[0]).join(listed, "path"))
    now = F.lit(began).cast("timestamp")
    found = found.withColumn("doc_id", F.xxhash64("path"))
    lang = F.when(F.col("language") == "CSharp", "csharp").otherwise("cpp")
    found.select("doc_id", "text", lang.alias("lang"), F.lit("repo").alias("source"), F.length("text").cast("long").alias("n_chars"), "path", F.lit(None).cast("string").alias("repo"), now.alias("fetched_at")).write.parquet(f"{out}/documents.parquet")
    none = F.lit(None).cast("array<struct<start_pos:int,end_pos:int,message:string>>")
    found.select("path", "project", "language", "doc_id", "hash", F.lit(None).cast("string").alias("failure"), none.alias("errors"), now.alias("loaded_at")).write.parquet(f"{out}/source_documents.parquet")

    declared = extract_declarations(found.select("path", "language", "text"))
    container = F.when(F.col("container").isNotNull(), F.concat(F.lit("T:"), "container")).alias("container_id")
    symbols = materialize(_symbols(declared).select("*", container))
    level = F.coalesce(F.initcap("accessibility"), F.when(F.col("language") == "Cpp", "Public").when(is_type(F.col("kind")) & F.col("container").isNull(), "Internal").otherwise("Private"))
    owned = symbols.join(listed.select("path", "project"), "path")
    owned.select("seq", "id", "kind", "name", "signature", "container_id", "namespace", "project", "language", level.alias("accessibility"), "modifiers", "parameters", F.lit(None).cast("string").alias("return_type"), F.lit(None).cast("string").alias("documentation"), F.lit(None).cast("string").alias("summary"), F.col("path").alias("file")).write.parquet(f"{out}/symbols.parquet")

    edges = _hierarchy(symbols.withColumn("accessibility", level)).unionByName(_references(found.select("path", "language", "text"), symbols))
    edges = edges.groupBy("from_node", "to_node", "edge_kind", "confidence").agg(F.count(F.lit(1)).cast("int").alias("edge_count"), F.min("first_line").alias("first_line"))
    edge_id = F.xxhash64("from_node", "to_node", "edge_kind", "confidence").alias("edge_id")
    edges.select(edge_id, "from_node", "to_node", "edge_kind", "edge_count", F.col("confidence").cast("byte").alias("confidence"), "first_line", now.alias("recorded_at")).write.parquet(f"{out}/graph_edges.parquet")

    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    code = F.concat(F.array_join(F.slice(lines, F.col("line"), F.col("stop_line") - F.col("line") + 1), "\n"), F.lit("\n"))
    served = symbols.select("seq", "path", "line", "stop_line").join(found.select("path", "text"), "path")
    served.select(F.col("seq").alias("item_id"), F.lit(0).cast("long").alias("request_id"), F.col("seq").alias("node"), F.lit("seed").alias("relation"), F.lit(0).alias("distance"), code.alias("code"), F.col("line").alias("code_line"), F.lit(None).cast("int").alias("token_budget"), now.alias("served_at")).write.parquet(f"{out}/context_items.parquet")

    documents = found.groupBy("project").agg(F.count(F.lit(1)).cast("int").alias("document_count"))
    counts = owned.groupBy("project").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    report = table.select(F.col("name").alias("project")).distinct().join(documents, "project", "left").join(counts, "project", "left").fillna(0)
    report = report.select(F.xxhash64("project").alias("report_id"), "project", now.alias("loaded_at"), F.lit(time.time() - began).alias("elapsed_seconds"), "document_count", "symbol_count", F.lit(None).cast("int").alias("files_with_parse_errors"), F.lit("Full").alias("snapshot_kind"))
    report.write.parquet(f"{out}/load_reports.parquet")
    for name, columns in EMPTY.items():
        spark.createDataFrame([], columns).write.parquet(f"{out}/{name}.parquet")
    notes = F.array(*[F.lit(p) for p in problems]) if problems else F.array().cast("array<string>")
    return spark.read.parquet(f"{out}/load_reports.parquet").select("project", "document_count", "symbol_count", "files_with_parse_errors", notes.alias("problems"))
