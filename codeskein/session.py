"""Session defaults, table loading and lineage cutting."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "codeskein", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; clusters bring their own settings."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; invent one only for a single local JVM."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codeskein-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result is written to the shared folder and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: computed once, it outlives executors.

    The tables of a context stay until ``drop_tables`` or until the folder is cleared, as results may still read them.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote in this context; results that read them can't be used after."""
    fs, at = file_system(spark, f"{_shared_folder(spark)}/table-*")
    for found in fs.globStatus(at) or []:
        fs.delete(found.getPath(), True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context.

    The archive goes to the shared folder the cluster names; a local JVM, and a cluster without such a folder, get it
    from the driver through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_codeskein_shipped", False):
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*")):
            if f.is_file() and f.suffix != ".pyc":
                z.write(f, f.relative_to(root.parent))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        target = f"{shared.rstrip('/')}/package-{uuid.uuid4().hex}/codeskein.zip"
        fs, at = file_system(spark, target)
        out = fs.create(at)
        out.write(packed.getvalue())
        out.close()
    else:
        target = str(Path(tempfile.mkdtemp(prefix="codeskein-package-")) / "codeskein.zip")
        Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    context._codeskein_shipped = True
