"""Source files as rows, snapshots of relations, and annotations."""

from __future__ import annotations

import json
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.session import file_system

SCHEMA_VERSION = 1


def read_sources(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, text and hash (SHA-256 of the bytes, upper hex) of the files below ``root``; a byte order mark is cut."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    content = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode(content, "UTF-8").alias("text"), F.upper(F.sha2("content", 256)).alias("hash"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system Spark knows; None if there is none."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    fs.setVerifyChecksum(False)  # others may have written it
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by one rename."""
    jvm = spark.sparkContext._jvm
    fs, fresh = file_system(spark, f"{path}.new")
    out = fs.create(fresh, True)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
    context.rename(fs.makeQualified(fresh), fs.makeQualified(file_system(spark, path)[1]), options)


class SnapshotStore:
    """Versions of named relations below a folder that all executors share. A version is written beside the others and
    becomes current by one rename of its manifest, through the folder's own file system; of older versions the last KEPT
    stay for those who still read them."""

    KEPT = 3

    def __init__(self, root: str, configuration: str = "Debug"):
        self.root, self.configuration = root.rstrip("/"), configuration

    def _pointer(self) -> str:
        return f"{self.root}/current.json"

    def manifest(self, spark: SparkSession) -> dict | None:
        """What is current, or None; ValueError if it can't be read as such."""
        text = read_text(spark, self._pointer())
        return None if text is None else json.loads(text)

    def save(self, relations: dict[str, DataFrame], applied: dict[str, int] | None = None) -> str:
        """Write a version; ``applied`` notes the last batch of every stream that is in it."""
        spark = next(iter(relations.values())).sparkSession
        version = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for name, df in relations.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        write_text(spark, self._pointer(), json.dumps({"schema": SCHEMA_VERSION, "configuration": self.configuration, "version": version, "relations": sorted(relations), "applied": applied or {}}))
        fs, at = file_system(spark, f"{self.root}/*-*")
        versions = sorted(f.getPath().getName() for f in fs.globStatus(at) or [] if f.isDirectory() and f.getPath().getName() != version)
        for old in versions[: -self.KEPT]:
            fs.delete(file_system(spark, f"{self.root}/{old}")[1], True)
        return version

    def load(self, spark: SparkSession) -> tuple[dict[str, DataFrame] | None, str | None]:
        """The current version, or None and why there is none that fits."""
        try:
            manifest = self.manifest(spark)
        except ValueError:
            return None, "damaged snapshot"
        if manifest is None:
            return None, "no snapshot"
        if manifest.get("schema") != SCHEMA_VERSION:
            return None, "other schema"
        if manifest.get("configuration") != self.configuration:
            return None, "other configuration"
        try:
            return {n: spark.read.parquet(f"{self.root}/{manifest['version']}/{n}") for n in manifest["relations"]}, None
        except Exception as e:  # any unreadable relation makes the snapshot unusable
            return None, f"damaged snapshot: {type(e).__name__}"


class Annotations:
    """Notes by target in a JSON file sorted by target; an unreadable file counts as empty."""

    def __init__(self, path: str):
        self.path = path
        try:
            self.notes = {n["target"]: n for n in json.loads(Path(path).read_text())}
        except (OSError, ValueError, KeyError, TypeError):
            self.notes = {}

    def get(self, target: str) -> str | None:
        return self.notes.get(target, {}).get("note")

    def set(self, target: str, note: str) -> None:
        """An empty note deletes."""
        if note.strip():
            self.notes[target] = {"target": target, "note": note, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        else:
            self.notes.pop(target, None)
        fresh = f"{self.path}.new"
        Path(fresh).write_text(json.dumps([self.notes[t] for t in sorted(self.notes)], indent=1))
        os.replace(fresh, self.path)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n["target"], n["note"], n["updated_at"]) for n in self.notes.values()], "target string, note string, updated_at string")


def newest_assemblies(assemblies: DataFrame) -> DataFrame:
    """Of assemblies (name, version, path) the highest version by name; equal versions go to the lower path."""
    parts = F.transform(F.split("version", r"\."), lambda x: F.lpad(x, 8, "0"))
    return assemblies.groupBy("name").agg(F.max_by("version", F.array_join(parts, ".")).alias("version"), F.min_by("path", F.struct(F.transform(F.split("version", r"\."), lambda x: -F.coalesce(x.try_cast("long"), F.lit(0))), F.col("path"))).alias("path"))
