"""A mixture of sources with target shares of all tokens.

Every record gets a hash-random key in [0, 1). Keys are cut into ranges; the ranges' token sums, a table whose
size depends on the number of ranges only, give the prefix sum before each range, and a window inside each range
gives every record's own. A record is taken as often as whole rounds through its source fit the source's budget,
and once more if its prefix lies within what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.llm.tokens import VOCABULARY, token_count
from codeskein.session import materialize

#: Records of a source in one range of keys, about.
RANGE_ROWS = 20_000


def sized_records(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower case; null as ""), tokens; null texts have 0."""
    return docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.coalesce(token_count(F.col("text"), path), F.lit(0)).alias("tokens"))


def mixture_plan(sums: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budgets, one row per target source: source, target_share, max_repeats, source_tokens, records, budget, rounds.

    Without ``total_tokens`` the mixture is as large as it can be with every share exact: the least, over the
    sources with tokens and a share, of tokens x max_repeats / share. Sources without tokens can't contribute;
    the shares of the others then keep their proportions and sum to one. Given ``total_tokens``, a source stops
    at its cap. Repeated target rows count once, the greatest share standing; null or negative shares count as
    0, null or negative max_repeats as 0.
    """
    share, cap = (F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("target_share", "max_repeats"))
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), share.cast("double").alias("target_share"), cap.cast("long").alias("max_repeats")).where(F.col("source").isNotNull())
    wanted = wanted.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("x")).select("source", "x.*")
    plan = wanted.join(sums, "source", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("source_tokens", "records")})
    all_rows = Window.partitionBy(F.lit(0))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    plan = plan.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(all_rows)).otherwise(0.0))
    most = F.col("source_tokens") * F.col("max_repeats")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.when(usable, most / F.col("share"))).over(all_rows)
    plan = plan.withColumn("budget", F.when(usable, F.least(F.floor(F.col("share") * total + F.lit(1e-6)).cast("long"), most)).otherwise(0).cast("long"))
    return plan.withColumn("rounds", F.when(usable, F.floor(F.col("budget") / F.col("source_tokens"))).otherwise(0).cast("long")).drop("share")


def mix_sources(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    records: doc_id, source, tokens (see ``sized_records``). Mixture: doc_id, source, tokens, position (prefix
    sum of tokens in key order, the record's own left out), copies (at least 1). Report, one row per target source:
    source, target_share, actual_share, budget, actual_tokens, source_tokens, records, taken_records, most_copies.

    A record is taken once more than the whole rounds if its prefix sum, half of it counted, lies within the
    remaining budget; so a source misses its budget by at most half a record. copies never exceeds max_repeats.
    Records without tokens, with a null ``doc_id`` or of a source without target are left out; rows repeated
    under one ``doc_id`` and source count once, the longest standing. Equal keys are ordered by doc_id. Empty
    tables give an empty mixture.
    """
    sized = records.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"))
    sized = materialize(sized)
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("records"))
    plan = materialize(mixture_plan(sums, targets, total_tokens))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "doc_id"), 11) / F.lit(float(1 << 53))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("records") / RANGE_ROWS)).cast("long")
    keyed = sized.join(F.broadcast(plan.select("source", "budget", "rounds", "source_tokens", "records", "max_repeats")), "source")
    keyed = keyed.withColumn("key", key).withColumn("range", F.least(ranges - 1, F.floor(F.col("key") * ranges)))
    per_range = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("range_tokens"))
    before = per_range.select("source", "range", (F.sum("range_tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("range_tokens")).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id")
    placed = keyed.join(before, ["source", "range"]).withColumn("position", F.col("before") + F.sum("tokens").over(inside) - F.col("tokens"))
    rest = F.col("budget") - F.col("rounds") * F.col("source_tokens")
    once_more = (F.col("rounds") < F.col("max_repeats")) & (2 * F.col("position") + F.col("tokens") <= 2 * rest)
    mixture = placed.withColumn("copies", (F.col("rounds") + once_more.cast("long")).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "position", "copies")

    reached = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("taken_records"), F.max("copies").alias("most_copies"))
    report = plan.join(F.broadcast(reached), "source", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("actual_tokens", "taken_records", "most_copies")})
    share = F.coalesce(F.try_divide("actual_tokens", F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
    report = report.select("source", "target_share", share.alias("actual_share"), "budget", "actual_tokens", "source_tokens", "records", "taken_records", "most_copies")
    return mixture, report
