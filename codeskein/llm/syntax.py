"""Source files that do not parse, by table-driven parsers over whole token streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.lang.grammars import analyse

LANGUAGES = ("CSharp", "Cpp")
#: Distinct pairs of file suffix and language up to which they are broadcast.
MOST_SUFFIXES = 10_000

_PARSED = "doc_id long, language string, error_line int, error_column int, error_token string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def error_of(text: str, language: str) -> tuple[int, int, str] | None:
    """1-based line and column of the first unrecoverable error and the token there ("" for the end of the text)."""
    tokens, _, at = analyse(text, language)
    if at is None:
        return None
    before = "".join(tokens[:at])
    return before.count("\n") + 1, len(before) - before.rfind("\n"), tokens[at] if at < len(tokens) else ""


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, language, text in zip(pdf["doc_id"], pdf["language"], pdf["text"]):
            if error := error_of(text or "", language):
                rows.append((doc, language, *error))
        yield pd.DataFrame(rows, columns=["doc_id", "language", "error_line", "error_column", "error_token"])


def syntax_errors(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document and language whose text is not valid in it: doc_id, language, error_line,
    error_column, error_token (the first token at which no parse can go on; "" if the text ends too early).

    sources: path, doc_id, language; docs: doc_id, path, text. Judged is every distinct (doc_id, language) of
    sources with a document. Null and empty texts are valid, null languages and ids are left out, a language
    other than CSharp and Cpp gives no rows. Repeated rows count once; of several texts under one doc_id
    each is judged. Other columns are ignored.

    Texts are not shuffled: the languages that sources give to each file suffix, a small table whose size is
    checked, are broadcast and every document is parsed where it is read; only errors meet sources. Documents
    whose own path has another suffix than their source row's are few and are joined by id.
    """
    wanted = sources.select("doc_id", "language", suffix(F.col("path")).alias("suffix")).where(F.col("doc_id").isNotNull() & F.col("language").isin(*LANGUAGES))
    files = docs.select("doc_id", F.coalesce(suffix(F.col("path")), F.lit("")).alias("suffix"), "text").where(F.col("doc_id").isNotNull())
    known = wanted.select(F.coalesce("suffix", F.lit("")).alias("suffix"), "language").distinct()
    pairs = known.limit(MOST_SUFFIXES + 1).collect()
    ids = wanted.select("doc_id", "language").distinct()
    if len(pairs) > MOST_SUFFIXES:
        return files.join(ids, "doc_id").select("doc_id", "language", "text").mapInPandas(_parse, _PARSED).distinct()
    spark = sources.sparkSession
    table = F.broadcast(spark.createDataFrame([(r["suffix"], r["language"]) for r in pairs], "suffix string, language string"))
    errors = files.join(table, "suffix").select("doc_id", "language", "text").mapInPandas(_parse, _PARSED)
    found = errors.join(ids, ["doc_id", "language"]).distinct()
    odd = files.select("doc_id", "suffix").join(ids, "doc_id").join(table, ["suffix", "language"], "left_anti").select("doc_id", "language").distinct()
    if odd.limit(1).count():
        other = files.join(odd, "doc_id").join(table, ["suffix", "language"], "left_anti")
        found = found.unionByName(other.select("doc_id", "language", "text").mapInPandas(_parse, _PARSED).distinct())
    return found


def error_rates(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Per repository and language: repo, language, files, invalid_files, invalid_rate, reported_files.

    A file is a path; judged is its newest text that was taken (latest loaded_at, then highest doc_id). repo is the
    document's, null where it has none. reported_files counts the files whose newest row has a failure or errors.
    """
    newest = sources.where(F.col("language").isin(*LANGUAGES) & F.col("doc_id").isNotNull() & F.col("path").isNotNull())
    newest = newest.groupBy("path").agg(
        F.max_by(F.struct("doc_id", "language", (F.col("failure").isNotNull() | (F.size(F.coalesce("errors", F.array())) > 0)).alias("reported")), F.struct("loaded_at", "doc_id")).alias("x")
    )
    newest = newest.select("x.*").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("reported").cast("long")).alias("reported"))
    bad = syntax_errors(sources, docs).select("doc_id", "language", F.lit(1).alias("bad")).distinct()
    judged = newest.join(bad, ["doc_id", "language"], "left").join(docs.select("doc_id", "repo").distinct(), "doc_id")
    sums = judged.groupBy("repo", "language").agg(F.sum("files").alias("files"), F.sum(F.when(F.col("bad") == 1, F.col("files")).otherwise(0)).alias("invalid_files"), F.sum("reported").alias("reported_files"))
    return sums.withColumn("invalid_rate", F.round(F.col("invalid_files") / F.col("files"), 6))
