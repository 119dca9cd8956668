"""Change detection between two states of a workspace, and what has to be bound again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.operators.skew import skew_join
from codeskein.relations import Relations


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (new, changed, removed, unchanged) from two states of path, hash, project.

    Hashes and projects are compared null-safely; both states have one row per path.
    """
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & F.col("a.project").eqNullSafe(F.col("b.project"))
    change = F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def print_details() -> Column:
    """What of a declaration others may depend on."""
    return F.concat_ws("|", "kind", "signature", F.coalesce("return_type", F.lit("")), F.lower("accessibility"), F.array_join("modifiers", " "))


def prints(symbols: DataFrame) -> DataFrame:
    return symbols.select("file", "id", "name", "kind", print_details().alias("details"))


def differing_prints(before: DataFrame, after: DataFrame) -> DataFrame:
    """Prints of either state that the other doesn't hold, by value and multiplicity, with their side.

    One grouped sum of signed ones over both states; a difference of several gives as many rows.
    """
    columns = before.columns
    signed = before.withColumn("__n", F.lit(1)).unionByName(after.withColumn("__n", F.lit(-1)))
    left = signed.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "before").otherwise("after").alias("side")
    return left.select(*columns, side, F.explode(F.sequence(F.lit(1), F.abs("__n"))).alias("__copy")).drop("__copy")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    return differing_prints(before, after).select("name").distinct()


def rebinds_everything(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether a type or namespace kept its id but not its print, or an operator's print differs."""
    different = differing_prints(before, after)
    types = different.where(F.col("kind").isin("Class", "Struct", "Interface", "Enum", "Namespace")).groupBy("id").agg(F.countDistinct("side").alias("sides"))
    everywhere = different.where(F.col("kind").isin("Operator", "Destructor", "Macro", "Extension"))
    return types.where("sides > 1").select("id").unionByName(everywhere.select("id")).agg((F.count(F.lit(1)) > 0).alias("rebind_all"))


def file_names(rel: Relations) -> DataFrame:
    """path, name: the identifiers of every file's newest text, those in comments and strings among them.

    One name is listed once per file; nothing is kept of numbers.
    """
    texts = rel.newest_sources.where("doc_id IS NOT NULL").select("doc_id", "path").join(rel.table("documents").select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id")
    return texts.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}_][\p{L}\p{Nd}_]*"), F.lit(0)))).alias("name"))


def files_to_bind(rel: Relations, names: DataFrame) -> DataFrame:
    """Files whose own identifiers meet one of ``names``, whether or not anything there was bound to it before; files
    that only a recorded reference ties to such a symbol come besides, as their text may not be at hand."""
    changed = names.select("name").where("name IS NOT NULL").distinct()
    mention = skew_join(file_names(rel), changed, "name", "inner").select(F.col("path").alias("file"))
    targets = rel.symbols.join(changed, "name", "left_semi").select(F.col("seq").alias("to_node"))
    sources = rel.references.join(targets, "to_node", "left_semi").select(F.col("from_node").alias("seq")).distinct()
    bound = rel.symbols.join(sources, "seq", "left_semi").select("file")
    return mention.unionByName(bound).distinct()


def debounced(changes: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Batches of changes: a batch ends when nothing follows for longer than ``gap``."""
    sessions = changes.where(F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap))
    return sessions.agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("session_window")
