"""Queries on files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeskein.llm.syntax import error_rates, syntax_errors
from codeskein.session import read_table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf_dir, "source_documents"), read_table(spark, sf_dir, "documents")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_errors(*_tables(spark, sf_dir)).select("doc_id").distinct()


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_errors(*_tables(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rates(*_tables(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
