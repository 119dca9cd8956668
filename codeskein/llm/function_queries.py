"""Queries on functions and their documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeskein.llm.functions import documented_functions, documented_names
from codeskein.session import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_names(read_table(spark, sf_dir, "documents")).distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(read_table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
SQL: dict[str, str] = {}
