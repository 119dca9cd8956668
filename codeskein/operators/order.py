"""Places in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.session import materialize


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``position``, from 0, and ``total``, in the ascending order of the columns ``order``.

    The rows are sorted by ranges; the table that is broadcast has one row per range.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("__part").orderBy(*order)
    placed = ranged.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.row_number().over(inside) - 1)
    return placed.select(*rows.columns, "position", "total")
