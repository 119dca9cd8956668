from pyspark.sql import functions as F

from codeskein.session import cut_lineage, drop_tables, materialize, shuffle_width


def test_tables_are_written_once_and_dropped(spark):
    df = materialize(spark.range(10).withColumn("x", F.rand()))
    first = sorted(r["x"] for r in df.collect())
    assert sorted(r["x"] for r in df.collect()) == first and df.count() == 10
    assert materialize(spark.range(0)).count() == 0
    assert cut_lineage(spark.range(3)).count() == 3
    assert shuffle_width(spark) == 8


def test_dropping_leaves_nothing(spark):
    materialize(spark.range(3))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    drop_tables(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/table-*"))
