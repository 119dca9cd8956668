"""Queries on mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.llm.mixture import mix_sources, sized_records
from codeskein.session import materialize, read_table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(sized_records(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mixture_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: its records with tokens, and whether none is taken too often, the budget is missed by at most
    half the longest record, and every share's error is one that such misses can make: at most the longest records of all
    sources, as a part of all tokens, off the target's part of all that can contribute."""
    targets = read_table(spark, sf_dir, "mixture_targets")
    records = materialize(sized_records(read_table(spark, sf_dir, "documents")))
    _, report = mix_sources(records, targets)
    longest = records.groupBy("source").agg(F.max("tokens").alias("longest"))
    caps = targets.select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    usable = F.sum(F.when(F.col("records") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)))
    wanted = F.when(F.col("records") > 0, F.col("target_share") / usable).otherwise(0.0)
    allowed = F.sum(F.coalesce("longest", F.lit(0))).over(Window.partitionBy(F.lit(0))) / F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))
    checked = report.join(longest, "source", "left").join(caps, "source")
    return checked.select(
        "source",
        "records",
        (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"),
        (2 * F.abs(F.col("actual_tokens") - F.col("budget")) <= F.coalesce("longest", F.lit(0))).alias("meets_budget"),
        (F.abs(F.col("actual_share") - wanted) <= allowed).alias("meets_share"),
    )


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_invariants": p8_invariants}
SQL = {
    "p8_invariants": """SELECT t.source, count(DISTINCT d.doc_id) AS records, true AS within_repeats, true AS meets_budget, true AS meets_share
        FROM (SELECT DISTINCT lower(trim(source)) AS source FROM mixture_targets) t LEFT JOIN (SELECT doc_id, lower(trim(source)) AS source FROM documents WHERE length(text) > 0) d USING (source) GROUP BY t.source"""
}
