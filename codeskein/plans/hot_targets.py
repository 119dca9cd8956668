"""Queries on edge targets that hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.operators.skew import target_totals
from codeskein.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, heavy = target_totals(read_table(spark, sf_dir, "graph_edges"), read_table(spark, sf_dir, "caller_totals"))
    return totals.where(F.col("to_node").isNotNull() & (F.col("edge_rows") * 100 >= heavy.rows)).select("to_node")


def p1_target_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_totals(read_table(spark, sf_dir, "graph_edges"), read_table(spark, sf_dir, "caller_totals"))[0].drop("is_heavy")


QUERIES = {"p1_found": p1_found, "p1_target_totals": p1_target_totals}

SQL = {
    "p1_found": "SELECT to_node FROM graph_edges WHERE to_node IS NOT NULL GROUP BY to_node HAVING count(*) * 100 >= (SELECT count(*) FROM graph_edges)",
    "p1_target_totals": """
        WITH once AS (
          SELECT edge_id, to_node, from_node, CAST(coalesce(edge_count, 0) AS BIGINT) AS n, coalesce(edge_kind = 'Calls', false) AS is_call,
                 coalesce(confidence = 2, false) AS name_only, count(*) AS copies
          FROM graph_edges GROUP BY ALL),
        sums AS (
          SELECT to_node, CAST(sum(copies) AS BIGINT) AS edge_rows, CAST(sum(n * copies) AS BIGINT) AS sum_edge_count,
                 CAST(sum(CASE WHEN is_call AND NOT name_only THEN n ELSE 0 END) AS BIGINT) AS call_sites,
                 CAST(sum(CASE WHEN is_call AND name_only THEN n ELSE 0 END) AS BIGINT) AS name_only_call_sites,
                 count(DISTINCT from_node) + max(CASE WHEN from_node IS NULL THEN 1 ELSE 0 END) AS distinct_callers
          FROM once GROUP BY to_node),
        reported AS (
          SELECT symbol_node, total_call_sites AS reported_call_sites FROM caller_totals WHERE symbol_node IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY symbol_node ORDER BY reported_at DESC, total_call_sites DESC) = 1)
        SELECT sums.*, reported_call_sites FROM sums LEFT JOIN reported ON symbol_node = to_node""",
}
