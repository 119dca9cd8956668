"""Joins and per-key totals for keys of which a few hold most rows.

Heavy keys are found with a frequent-items sketch: partial sketches are built map-side and merged, so the
pass costs one scan and ships a few kilobytes per task. Their number is bounded by ``1 / share``; that is what
makes it safe to broadcast what belongs to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.session import shuffle_width

#: A heavy key's side of a join is broadcast up to this many rows and salted beyond it.
BROADCAST_ROWS = 100_000
SALTS = 64
#: A key is heavy from this share of the rows on, and from less where rows are spread over more tasks.
SHARE, LEAST_SHARE = 1 / 256, 1 / 4096
#: Items the sketch can track at most.
MOST_TRACKED = 1 << 17


def default_share(df: DataFrame) -> float:
    """One task's part of a shuffle, between LEAST_SHARE and SHARE: a key that holds as much is worth parting."""
    return min(SHARE, max(LEAST_SHARE, 1 / shuffle_width(df.sparkSession)))


@dataclass(frozen=True)
class HeavyKeys:
    """Keys holding at least ``share`` of all rows, by the sketch's upper bounds, and the exact row count."""

    keys: tuple
    rows: int
    share: float

    def has(self, key: Column) -> Column:
        """True for heavy keys and for null, which joins nothing and so needs no shuffle by key."""
        return key.isNull() | key.isin(list(self.keys)) if self.keys else key.isNull()


def heavy_keys(df: DataFrame, key: str, share: float | None = None) -> HeavyKeys:
    """The keys that hold at least ``share`` of the rows (by default one task's part of a shuffle).

    The sketch tracks ``32 / share`` items; its error is at most 3.5 / (items / 0.75) of the rows, well under
    ``share``, so no such key is missed; a share that would need more items than a sketch can track is an error. An
    empty table has none; null is never listed.
    """
    share = share or default_share(df)
    tracked = 1 << max(10, int(32 / share - 1).bit_length())
    if tracked > MOST_TRACKED:
        raise ValueError(f"shares under 32/{MOST_TRACKED} can't be told: {share}")
    found = df.agg(F.expr(f"approx_top_k(`{key}`, {int(1 / share) + 1}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    keys = tuple(sorted(x["item"] for x in found["top"] or [] if x["item"] is not None and x["count"] >= share * found["rows"]))
    return HeavyKeys(keys, found["rows"], share)


def skew_join(fact: DataFrame, side: DataFrame, key: str, how: str = "left", heavy: HeavyKeys | None = None) -> DataFrame:
    """``fact`` join ``side`` on ``key`` (inner or left) without sending a heavy key's rows to one task.

    Rows of ``side`` for heavy keys are counted first. Up to BROADCAST_ROWS they are broadcast; beyond that
    both sides are salted. All other keys take the ordinary shuffle. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    heavy = heavy or heavy_keys(fact, key)
    rest = fact.where(~heavy.has(F.col(key))).join(side, key, how)
    hot, hot_side = fact.where(heavy.has(F.col(key))), side.where(F.col(key).isin(list(heavy.keys)) if heavy.keys else F.lit(False))
    if not heavy.keys or hot_side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return hot.join(F.broadcast(hot_side), key, how).unionByName(rest)
    salt = F.array([F.lit(i) for i in range(SALTS)])
    salted = hot.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), F.lit(SALTS)).cast("int")).join(hot_side.withColumn("__salt", F.explode(salt)), [key, "__salt"], how)
    return salted.drop("__salt").unionByName(rest)


def target_totals(edges: DataFrame, caller_totals: DataFrame, share: float | None = None) -> tuple[DataFrame, HeavyKeys]:
    """Totals of every edge target, one row per ``to_node`` (null and 0 included), and the heavy keys.

    Columns: to_node, edge_rows (all rows, resent ones too), sum_edge_count (over all rows), call_sites and
    name_only_call_sites (sums over distinct ``edge_id`` of kind Calls), distinct_callers (null counts as one),
    reported_call_sites (newest figure of ``caller_totals``, null if none), is_heavy.

    Resent rows are folded by edge, then pairs (target, source) are pre-aggregated, which spreads a hot target
    over its sources; only then do keys meet. Heavy targets are joined to the reported figures by broadcast,
    all others by shuffle, and both are united. Null counts are 0, null confidences count as known. Columns
    beyond those named here are ignored. Empty tables give no rows.
    """
    heavy = heavy_keys(edges, "to_node", share)
    count = F.coalesce(F.col("edge_count"), F.lit(0)).cast("long")
    calls, name_only = F.coalesce(F.col("edge_kind") == "Calls", F.lit(False)), F.coalesce(F.col("confidence") == 2, F.lit(False))
    once = edges.select("edge_id", "to_node", "from_node", count.alias("n"), calls.alias("is_call"), name_only.alias("name_only"))
    once = once.groupBy(*once.columns).agg(F.count(F.lit(1)).alias("copies"))
    pairs = once.groupBy("to_node", "from_node").agg(
        F.sum("copies").alias("edge_rows"),
        F.sum(F.col("n") * F.col("copies")).alias("sum_edge_count"),
        F.sum(F.when(F.col("is_call") & ~F.col("name_only"), F.col("n")).otherwise(0)).alias("call_sites"),
        F.sum(F.when(F.col("is_call") & F.col("name_only"), F.col("n")).otherwise(0)).alias("name_only_call_sites"),
    )
    reported = caller_totals.select(F.col("symbol_node").alias("to_node"), "total_call_sites", "reported_at").where(F.col("to_node").isNotNull())
    reported = reported.groupBy("to_node").agg(F.max_by("total_call_sites", F.struct("reported_at", "total_call_sites")).alias("reported_call_sites"))

    def totals(part: DataFrame, side: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("edge_rows", "sum_edge_count", "call_sites", "name_only_call_sites")]
        return part.groupBy("to_node").agg(*sums, F.count(F.lit(1)).alias("distinct_callers")).join(side, "to_node", "left")

    is_heavy = heavy.has(F.col("to_node"))
    hot = totals(pairs.where(is_heavy), F.broadcast(reported.where(is_heavy))).withColumn("is_heavy", F.col("to_node").isNotNull())
    return hot.unionByName(totals(pairs.where(~is_heavy), reported).withColumn("is_heavy", F.lit(False))), heavy
