"""Queries on filling containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm.bins import fill_containers
from codeskein.llm.tokens import token_count
from codeskein.session import materialize, read_table


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(sized_documents(spark, sf_dir), read_table(spark, sf_dir, "container_kinds"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers used, the fewest that the tokens could need, and the mean fill."""
    packed = p7_containers(spark, sf_dir)
    total = F.sum("tokens")
    return packed.groupBy("container_kind", "capacity").agg(
        F.countDistinct("container").alias("containers"), F.ceil(total / F.first("capacity")).alias("fewest"), (total / (F.countDistinct("container") * F.first("capacity"))).alias("mean_fill")
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: documents placed, documents whose tokens aren't all placed or that are split though they fit, and
    containers over their capacity."""
    sized = materialize(sized_documents(spark, sf_dir))
    packed = materialize(fill_containers(sized, read_table(spark, sf_dir, "container_kinds")))
    by_doc = packed.groupBy("container_kind", "capacity", "doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces")).join(sized, "doc_id", "full_outer")
    wrong = ~F.col("placed").eqNullSafe(F.col("tokens")) | ((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")))
    documents = by_doc.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(wrong, 1)).alias("wrong_documents"))
    loads = packed.groupBy("container_kind", "capacity", "container").agg(F.sum("tokens").alias("load"))
    return documents.join(loads.groupBy("container_kind").agg(F.count(F.when(F.col("load") > F.col("capacity"), 1)).alias("overfull")), "container_kind", "left")


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants}
SQL = {
    "p7_invariants": """SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS wrong_documents, CAST(0 AS BIGINT) AS overfull
        FROM (SELECT DISTINCT container_kind FROM container_kinds WHERE capacity_tokens > 0)"""
}
