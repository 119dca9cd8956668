"""All query modules of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.plans import frontend, graph, hot_targets, navigation, search, workspace
from codeskein.relations import Relations

MODULES = [hot_targets, navigation, graph, search, workspace, frontend]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of the most referenced symbol: what depends on it, nearest first."""
    rel = Relations(spark, sf_dir)
    names = rel.symbols.select(F.col("seq").alias("node"), "id", "kind", "project")
    return graph.impact(rel).join(names, "node").select("depth", "node", "id", "kind", "project")
