"""Base relations of a symbol graph, read from the tables of the project's domain."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.session import read_table

#: Ordered grades of a reference, the surest first.
EXACT, INFERRED, NAME_ONLY = 0, 1, 2
TYPE_KINDS = ("Class", "Struct", "Interface", "Enum", "Record", "RecordStruct", "Delegate", "Union", "TypeAlias")
CALLABLE_KINDS = ("Method", "Constructor", "Destructor", "Operator", "Function", "Macro")
#: Edges along which a member is overridden or implemented, or a type derived.
DISPATCH_KINDS = ("Overrides", "ImplementsMember")
HIERARCHY_KINDS = ("Inherits", "Implements")
STRUCTURAL_KINDS = HIERARCHY_KINDS + DISPATCH_KINDS


def is_type(kind):
    return kind.isin(*TYPE_KINDS)


def is_callable(kind):
    return kind.isin(*CALLABLE_KINDS)


def is_member(kind):
    return ~is_type(kind) & ~kind.isin("Namespace", "Extension")


def certain(confidence):
    """Not found by name alone; an ungraded reference counts as certain."""
    return F.coalesce(confidence, F.lit(EXACT)) != NAME_ONLY


@dataclass(frozen=True)
class Relations:
    """Lazy relations over one folder of tables; every DataFrame is a plan, nothing is held."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def symbols(self) -> DataFrame:
        """One row per node; rows that were repeated count once."""
        return self.table("symbols").dropDuplicates(["seq"])

    @cached_property
    def references(self) -> DataFrame:
        """One row per reference record; resent rows count once, null counts are 0."""
        count = F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count")
        return self.table("graph_edges").select("edge_id", "from_node", "to_node", "edge_kind", count, "confidence", "first_line").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """References between workspace nodes folded by (from, to, kind): occurrences, surest grade, first line."""
        ends = self.symbols.select("seq")
        inside = self.references.where("from_node <> to_node").join(ends.withColumnRenamed("seq", "from_node"), "from_node", "left_semi").join(ends.withColumnRenamed("seq", "to_node"), "to_node", "left_semi")
        return inside.groupBy("from_node", "to_node", "edge_kind").agg(F.sum("edge_count").alias("edge_count"), F.min("confidence").alias("confidence"), F.min("first_line").alias("first_line"))

    @cached_property
    def externals(self) -> DataFrame:
        return self.table("external_members").dropDuplicates(["node"])

    @cached_property
    def newest_sources(self) -> DataFrame:
        """The newest row of every path."""
        s = self.table("source_documents").where(F.col("path").isNotNull())
        return s.groupBy("path").agg(F.max_by(F.struct("project", "language", "doc_id", "hash", "failure", "errors", "loaded_at"), F.struct("loaded_at", "doc_id")).alias("x")).select("path", "x.*")


#: The same relations for the SQL counterparts.
SYM_SQL = "sym AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY seq ORDER BY id) = 1)"
RAW_SQL = "raw AS (SELECT DISTINCT edge_id, from_node, to_node, edge_kind, CAST(coalesce(edge_count, 0) AS BIGINT) AS edge_count, confidence, first_line FROM graph_edges)"
EDGES_SQL = f"""{SYM_SQL}, {RAW_SQL},
    edges AS (SELECT from_node, to_node, edge_kind, CAST(sum(edge_count) AS BIGINT) AS edge_count, min(confidence) AS confidence, min(first_line) AS first_line
              FROM raw WHERE from_node <> to_node AND from_node IN (SELECT seq FROM sym) AND to_node IN (SELECT seq FROM sym) GROUP BY ALL)"""
NEWEST_SQL = "newest AS (SELECT * FROM source_documents WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC NULLS LAST, doc_id DESC NULLS LAST) = 1)"
