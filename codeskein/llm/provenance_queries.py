"""Queries on files that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm.provenance import source_labels
from codeskein.session import read_table


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where(F.lower(F.trim("source")) == "repo")
    return source_labels(docs, read_table(spark, sf_dir, "source_documents"), read_table(spark, sf_dir, "projects"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_labels(spark, sf_dir).where(F.col("label") != "handwritten").select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_labels": p2_labels}
SQL: dict[str, str] = {}
