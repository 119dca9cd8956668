"""Queries of the language front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.lang.declarations import extract_declarations, name_references
from codeskein.relations import Relations


def newest_files(rel: Relations) -> DataFrame:
    """path, language and text of the newest state of every file."""
    newest = rel.newest_sources.where("doc_id IS NOT NULL AND language IS NOT NULL").select("path", "language", "doc_id")
    return rel.table("documents").select("doc_id", "text").join(newest, "doc_id").select("path", "language", "text")


def extracted(rel: Relations) -> DataFrame:
    return extract_declarations(newest_files(rel))


def extraction_recall(rel: Relations) -> DataFrame:
    """Of the recorded symbols, those whose name and kind were found in their file's newest text."""
    found = extracted(rel).select(F.col("path").alias("file"), "name", F.lit(True).alias("found")).distinct()
    met = rel.symbols.join(newest_files(rel).select(F.col("path").alias("file")).distinct(), "file", "left_semi").join(found, ["file", "name"], "left")
    return met.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("recorded"), F.count("found").alias("found"))


def name_only_references(rel: Relations) -> DataFrame:
    refs = name_references(newest_files(rel), rel.symbols)
    return refs.groupBy("path").agg(F.count(F.lit(1)).alias("reference_count"), F.countDistinct("target").alias("targets"), F.count(F.when(F.col("candidates") > 1, 1)).alias("ambiguous"))


_CALLS = {"extracted_declarations": extracted, "extraction_recall": extraction_recall, "name_only_references": name_only_references}

QUERIES = {name: (lambda spark, folder, f=f: f(Relations(spark, folder))) for name, f in _CALLS.items()}
SQL: dict[str, str] = {}
