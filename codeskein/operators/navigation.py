"""Name search, positions, references, callers and callees over the base relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.functions.text import is_test, name_regex
from codeskein.relations import Relations, certain, is_callable

DEFAULT_MAX = 50


def container_chain(symbols: DataFrame) -> DataFrame:
    """symbols with ``chain``: names of the containers, innermost first, then the namespace's segments."""
    owner = symbols.select(F.col("id").alias("container_id"), F.col("name").alias("container_name"))
    spaces = F.reverse(F.filter(F.split(F.coalesce("namespace", F.lit("")), r"\.|::"), lambda x: x != ""))
    chain = F.concat(F.when(F.col("container_name").isNull(), F.array().cast("array<string>")).otherwise(F.array("container_name")), spaces)
    return symbols.join(owner, "container_id", "left").withColumn("chain", chain).drop("container_name")


def find_symbol(rel: Relations, query: str, kind: str | None = None, project: str | None = None, exact: bool = False, limit: int = DEFAULT_MAX) -> DataFrame:
    """Symbols whose last name segment matches, in rank order; one row more than ``limit`` tells of truncation.

    A query with ``*`` or ``?`` is a whole-name pattern, else a substring, or with ``exact`` the whole name; case
    is ignored. Leading segments must occur among the containers in order. Exact-case hits come first, then
    whole-name hits, short names, and ids.
    """
    segments = [s for s in re.split(r"\.|::", query) if s]
    if not segments:
        return rel.symbols.limit(0).select("id", "kind", "name", "project", "file")
    *outer, last = segments
    name = F.col("name")
    if "*" in last or "?" in last:
        hit = name.rlike(name_regex(last))
    else:
        hit = F.lower(name) == last.lower() if exact else F.contains(F.lower(name), F.lit(last.lower()))
    found = rel.symbols.where(hit)
    if kind:
        found = found.where(F.lower("kind") == kind.lower())
    if project:
        found = found.where(F.lower("project") == project.lower())
    if outer:
        pattern = "/(?:.*/)?".join(re.escape(q) for q in reversed(outer))
        found = container_chain(found_with_owners(rel, found)).where(hit & F.concat(F.lit("/"), F.array_join("chain", "/"), F.lit("/")).rlike(f"(?i)/{pattern}/"))
    order = [F.desc(name == last), F.desc(F.lower(name) == last.lower()), F.length("name"), F.col("id")]
    return found.orderBy(*order).limit(limit + 1).select("id", "kind", "name", "project", "file")


def found_with_owners(rel: Relations, found: DataFrame) -> DataFrame:
    """The rows and their containers, so that chains can be built without all symbols."""
    owners = rel.symbols.join(found.select(F.col("container_id").alias("id")).distinct(), "id", "left_semi")
    return found.unionByName(owners).dropDuplicates(["seq"]) if found is not rel.symbols else found


def declared_spans(rel: Relations) -> DataFrame:
    """Line spans of declarations: file, node, start, end (exclusive), from the code that was served with its line."""
    items = rel.table("context_items").where("node IS NOT NULL AND code IS NOT NULL AND code_line IS NOT NULL")
    lines = F.length(F.regexp_replace("code", "[^\n]", "")) + F.when(F.col("code").endswith("\n"), 0).otherwise(1)
    spans = items.select("node", F.col("code_line").cast("long").alias("start"), (F.col("code_line") + lines).cast("long").alias("end")).distinct()
    return spans.join(rel.symbols.select(F.col("seq").alias("node"), "file"), "node").select("file", "node", "start", "end")


def reference_positions(rel: Relations) -> DataFrame:
    """edge_id, file and line of every reference of a workspace member."""
    at = rel.references.where("first_line IS NOT NULL").select("edge_id", "from_node", "to_node", "confidence", F.col("first_line").cast("long").alias("line"))
    return at.join(rel.symbols.select(F.col("seq").alias("from_node"), "file"), "from_node")


#: Lines of a file that are swept together; spans are swept with every stretch they reach into.
STRETCH = 4096


def innermost_spans(points: DataFrame, spans: DataFrame) -> DataFrame:
    """file, line, node: the span of ``spans`` (file, node, start, end) that starts last before or at each point (file,
    line) and is open there; of equal starts the lowest node. Points outside all spans are left out.

    Both are sorted by stretches of STRETCH lines and swept once with a stack of open spans: what has ended by a line is
    taken from the top of the stack, and never comes back, as lines only rise.
    """
    stretches = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH)))
    opened = spans.where("start < end").select("file", stretches.alias("stretch"), F.col("start").alias("line"), "end", "node")
    asked = points.where("line IS NOT NULL").select("file", F.floor(F.col("line") / STRETCH).alias("stretch"), "line").distinct()
    events = opened.unionByName(asked, allowMissingColumns=True).where("file IS NOT NULL")
    # a stretch begins with the spans that reach into it; a span comes before the points of its line
    order = ("file", "stretch", "line", F.col("end").isNull(), F.desc("node"))
    return events.repartition("file", "stretch").sortWithinPartitions(*order).mapInPandas(_sweep, "file string, line long, node long")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, stack = None, []
    for pdf in batches:
        files, lines, nodes = [], [], []
        for file, stretch, line, end, node in zip(pdf["file"], pdf["stretch"], pdf["line"], pdf["end"].fillna(-1).astype("int64"), pdf["node"].fillna(-1).astype("int64")):
            if (file, stretch) != at:
                at, stack = (file, stretch), []
            if end >= 0:
                stack.append((end, node))
                continue
            while stack and stack[-1][0] <= line:
                stack.pop()
            if stack:
                files.append(file)
                lines.append(line)
                nodes.append(stack[-1][1])
        yield pd.DataFrame({"file": files, "line": lines, "node": nodes})


def enclosing_declarations(rel: Relations) -> DataFrame:
    """The innermost declaration around each reference: edge_id, node. Equal starts go to the lowest node."""
    at = reference_positions(rel).select("edge_id", "file", "line")
    return at.join(innermost_spans(at, declared_spans(rel)), ["file", "line"]).select("edge_id", "node")


def reference_at_declaration(rel: Relations) -> DataFrame:
    """The surest reference on the first line of each declaration: file, node, edge_id, confidence."""
    at, spans = reference_positions(rel), declared_spans(rel)
    met = spans.join(at, (at.file == spans.file) & (at.line == spans.start)).select(spans.file, "node", "start", "edge_id", F.coalesce("confidence", F.lit(0)).cast("int").alias("confidence"))
    order = Window.partitionBy("file", "node", "start").orderBy("confidence", "edge_id")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("file", "node", "start", "edge_id", "confidence")


def file_outline(rel: Relations) -> DataFrame:
    """Declarations of every file with their nesting depth: the earlier spans of the file that are still open."""
    spans = declared_spans(rel).groupBy("file", "node").agg(F.min_by(F.struct("start", "end"), F.struct("start", "end")).alias("s")).select("file", "node", "s.*")
    return open_before(spans)


def open_before(spans: DataFrame) -> DataFrame:
    """file, node, start, depth: spans (file, node, start, end) that come before by start and node and are open at the
    start. All that ends by then has begun before, so it's a running sum of starts and ends."""
    starts = spans.select("file", F.col("start").alias("line"), F.lit(1).alias("step"), "node", "start")
    ends = spans.select("file", F.col("end").alias("line"), F.lit(-1).alias("step"), "node", F.lit(None).cast("long").alias("start"))
    so_far = Window.partitionBy("file").orderBy("line", "step", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return starts.unionByName(ends).withColumn("depth", F.sum("step").over(so_far) - 1).where("start IS NOT NULL").select("file", "node", "start", "depth")


def with_caller(rel: Relations, references: DataFrame) -> DataFrame:
    caller = rel.symbols.select(F.col("seq").alias("from_node"), F.col("id").alias("caller"), "file", F.col("project").alias("caller_project"))
    return references.join(caller, "from_node", "left")


def references_by_target(rel: Relations) -> DataFrame:
    """Per workspace symbol: references, name-only ones apart, files and occurrences."""
    refs = with_caller(rel, rel.references).join(rel.symbols.select(F.col("seq").alias("to_node")), "to_node", "left_semi")
    sure = certain(F.col("confidence"))
    return refs.groupBy("to_node").agg(
        F.count(F.when(sure, 1)).alias("reference_count"),
        F.count(F.when(~sure, 1)).alias("name_only"),
        F.countDistinct(F.when(sure, F.col("file"))).alias("files"),
        F.sum(F.when(sure, F.col("edge_count")).otherwise(0)).alias("occurrences"),
    )


def references_by_file(rel: Relations, target: int) -> DataFrame:
    refs = with_caller(rel, rel.references.where((F.col("to_node") == target) & certain(F.col("confidence"))))
    return refs.groupBy("file").agg(F.count(F.lit(1)).alias("reference_count"), F.array_sort(F.collect_list("first_line")).alias("lines")).withColumn("is_test", is_test(F.col("file")))


def references_page(rel: Relations, target: int, limit: int = 200, offset: int = 0) -> DataFrame:
    """One page in the order of file, line and record."""
    refs = with_caller(rel, rel.references.where((F.col("to_node") == target) & certain(F.col("confidence"))))
    return refs.orderBy("file", F.asc_nulls_first("first_line"), "edge_id").offset(max(0, offset)).limit(max(0, limit)).select("edge_id", "caller", "file", "first_line")


def callers(rel: Relations) -> DataFrame:
    """Per callable: call sites, distinct callers (an unknown one counts), callers in tests, name-only sites."""
    refs = with_caller(rel, rel.references).join(rel.symbols.where(is_callable(F.col("kind"))).select(F.col("seq").alias("to_node")), "to_node", "left_semi")
    sure = certain(F.col("confidence"))
    return refs.groupBy("to_node").agg(
        F.sum(F.when(sure, F.col("edge_count")).otherwise(0)).alias("call_sites"),
        F.countDistinct(F.when(sure, F.coalesce("from_node", F.lit(-1)))).alias("distinct_callers"),
        F.countDistinct(F.when(sure & is_test(F.col("file")), F.col("from_node"))).alias("test_callers"),
        F.sum(F.when(sure, 0).otherwise(F.col("edge_count"))).alias("name_only_sites"),
    )


def callees(rel: Relations) -> DataFrame:
    """Per member and target: count, first line, surest grade, and whether the target is in the workspace, external or
    unresolved. External types and fields are no callees."""
    inside = rel.symbols.select(F.col("seq").alias("to_node"), F.col("id").alias("inside_id"))
    outside = rel.externals.select(F.col("node").alias("to_node"), F.col("id").alias("outside_id"))
    refs = rel.references.where(F.col("to_node").isNotNull() & certain(F.col("confidence")))
    grouped = refs.groupBy("from_node", "to_node").agg(F.sum("edge_count").alias("sites"), F.min("first_line").alias("first_line"), F.min(F.coalesce("confidence", F.lit(0))).cast("int").alias("confidence"))
    named = grouped.join(inside, "to_node", "left").join(F.broadcast(outside) if _fixed(rel) else outside, "to_node", "left")
    where = F.when(F.col("inside_id").isNotNull(), "workspace").when(F.col("outside_id").isNotNull(), "external").otherwise("unresolved")
    named = named.withColumn("place", where).where(~((F.col("place") == "external") & F.col("outside_id").rlike("^[TF]:")))
    return named.select("from_node", "to_node", F.coalesce("inside_id", "outside_id").alias("target"), "place", "sites", "first_line", "confidence")


def _fixed(rel: Relations, most: int = 100_000) -> bool:
    """Whether the table of library members is small enough to broadcast."""
    return rel.table("external_members").limit(most + 1).count() <= most

