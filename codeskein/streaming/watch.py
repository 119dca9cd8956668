"""File changes as a stream: debounced batches, and a state of files kept current by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeskein.operators.incremental import document_changes
from codeskein.sources.files import SnapshotStore

#: Quiet time that ends a batch of changes, and how late a change may arrive.
QUIET, LATENESS = "300 milliseconds", "10 seconds"
# What a watcher reports.
WATCHED = (".cs", ".csproj", ".sln", ".slnx", ".props", ".targets", ".vcxproj", ".h", ".hh", ".hpp", ".hxx", ".c", ".cc", ".cpp", ".cxx", ".inl", ".xaml", ".json", ".editorconfig")
IGNORED = r"(?:^|/)(?:bin|obj|\.git|\.vs)(?:/|$)"


def relevant(changes: DataFrame) -> DataFrame:
    """Changes (path, at) of files that matter; a path without a suffix may be a directory and is kept."""
    path = F.regexp_replace("path", r"\\", "/")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return changes.where(~path.rlike(IGNORED) & (suffix.isin(*WATCHED) | ((suffix == "") & (name != ""))))


def batches(changes: DataFrame, quiet: str = QUIET, lateness: str = LATENESS) -> DataFrame:
    """Batches of changes (root, path, at) of one workspace that nothing interrupts for ``quiet``: root, paths, events, whether something was lost (an empty
    path). Works on a stream (append mode) and on a table."""
    timed = changes.withWatermark("at", lateness) if changes.isStreaming else changes
    found = timed.groupBy("root", F.session_window("at", quiet)).agg(F.array_sort(F.collect_set(F.when(F.col("path") != "", F.col("path")))).alias("paths"), F.count(F.lit(1)).alias("events"), F.max(F.coalesce(F.col("path") == "", F.lit(True))).alias("lost"))
    return found.select("root", F.col("session_window.start").alias("started"), "paths", "events", "lost")


class FileState:
    """The last known state of every file (path, hash, project), updated by micro-batches.

    ``apply`` is for foreachBatch: the newest event of each path in the batch is merged with the state, a new
    version is written and becomes current at once; readers keep the version they read. The version notes the batch, so
    applying a batch of a stream again changes nothing.
    """

    def __init__(self, store: SnapshotStore, on_change: Callable[[DataFrame], None] | None = None):
        self.store, self.on_change = store, on_change

    def _known(self, spark: SparkSession) -> tuple[DataFrame, dict[str, int]]:
        known, _ = self.store.load(spark)
        if known is None:
            return spark.createDataFrame([], "path string, hash string, project string"), {}
        return known["files"], (self.store.manifest(spark) or {}).get("applied", {})

    def apply(self, events: DataFrame, batch_id: int, stream: str = "") -> None:
        """events: path, hash (null: deleted), project, at."""
        before, applied = self._known(events.sparkSession)
        if applied.get(stream, -1) >= batch_id:
            return
        newest = events.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("hash", "project"), F.struct("at", "hash")).alias("x")).select("path", "x.*")
        after = before.join(newest, "path", "left_anti").unionByName(newest.where("hash IS NOT NULL"))
        self._become(before, after, {**applied, stream: batch_id})

    def _become(self, before: DataFrame, after: DataFrame, applied: dict[str, int]) -> None:
        if self.on_change:
            self.on_change(document_changes(before, after).where("change <> 'unchanged'"))
        self.store.save({"files": after}, applied)

    def reconcile(self, files: DataFrame) -> None:
        """Take ``files`` (path, hash, project; one row per path) as they are now, after a start or when events were
        lost: what differs from the state goes the way of any change."""
        before, applied = self._known(files.sparkSession)
        self._become(before, files.where("path IS NOT NULL AND hash IS NOT NULL").select("path", "hash", "project"), applied)

    def follow(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(lambda events, n: self.apply(events, n, checkpoint)).option("checkpointLocation", checkpoint)

    def current(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """The state after everything that has arrived by now: what a query that must see its own writes reads."""
        self.follow(stream, checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self._known(stream.sparkSession)[0]
