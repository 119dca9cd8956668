"""Queries on keyword-stuffed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm.spam import page_curves
from codeskein.session import read_table

#: The source that holds code; everything else is pages.
CODE_SOURCE = "repo"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where(F.coalesce(F.lower(F.trim("source")), F.lit("")) != CODE_SOURCE)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_curves(pages(spark, sf_dir)).where("flagged").select("doc_id")


def p9_page_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_curves(pages(spark, sf_dir))


QUERIES = {"p9_found": p9_found, "p9_page_curves": p9_page_curves}
SQL: dict[str, str] = {}
