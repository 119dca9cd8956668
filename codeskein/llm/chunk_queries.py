"""Queries on cutting oversized items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm.chunks import split_oversized
from codeskein.session import read_table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "context_items")).where("piece = 0").select("item_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "context_items"))


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized item put together again from its pieces without their overlaps: item_id, text_hash, and whether
    no piece exceeds the item's limit."""
    pieces = p5_pieces(spark, sf_dir)
    own = F.substring("code", F.col("overlap_before").cast("int") + 1, F.length("code"))
    parts = F.array_sort(F.collect_list(F.struct("piece", own.alias("own"))))
    whole = pieces.groupBy("item_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["own"]), "")).alias("text_hash"), F.max("n_chars").alias("longest"))
    limit = 4 * F.greatest(F.lit(1), F.coalesce("token_budget", F.lit(4000)))
    limits = read_table(spark, sf_dir, "context_items").groupBy("item_id").agg(F.max(limit).alias("limit_chars"))
    return whole.join(limits, "item_id").select("item_id", "text_hash", (F.col("longest") <= F.col("limit_chars")).alias("within"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}

SQL = {
    "p5_found": "SELECT DISTINCT item_id FROM context_items WHERE length(code) > 4 * greatest(1, coalesce(token_budget, 4000)) AND item_id IS NOT NULL",
    "p5_rebuilt": """SELECT item_id, md5(code) AS text_hash, true AS within FROM context_items WHERE length(code) > 4 * greatest(1, coalesce(token_budget, 4000)) AND item_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY served_at DESC NULLS LAST, code_line DESC NULLS LAST) = 1""",
}
