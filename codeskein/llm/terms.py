"""How characteristic a term is of its record: graph-of-words degree times collection rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.operators.skew import heavy_keys, skew_join
from codeskein.session import materialize

#: Two terms are neighbours when at most this many places apart, plus one, in a record's list.
WINDOW = 3
#: Share of the pivoted length in the normalisation.
SLOPE = 0.003


def normal_terms(terms):
    """Lower-cased terms without surrounding white space, empty and null ones dropped, order kept; null gives none."""
    clean = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(F.regexp_replace(t, r"^\s+|\s+$", "")))
    return F.filter(clean, lambda t: t.isNotNull() & (t != ""))


def term_weights(hits: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per record and distinct term: hit_id, term, degree, holders, rarity, weight.

    degree: distinct other terms within ``window`` places in the record (all rows of one ``hit_id`` together;
    rows sent again add nothing). holders: records that hold the term. rarity: ln((records + 1) / holders) for
    terms with at least two holders and 0 for terms of a single record, which tie it to no other; records counts
    every distinct ``hit_id``. weight: (1 + degree) / (1 - SLOPE + SLOPE * length / mean length) * rarity, with
    length the record's distinct terms. Null ``hit_id``, null or empty arrays and blank terms give no rows; an
    empty table gives none. Other columns are ignored.

    Neighbours are told apart by 64-bit hashes. Rows are brought together by record once, and all that concerns a
    record is counted there. Records that hold a large share of all rows are found first and counted by finer keys.
    Frequent terms get their holders by broadcast, the others by shuffle.
    """
    if window < 2:
        raise ValueError("a window spans at least two places")
    rows = hits.where(F.col("hit_id").isNotNull()).select("hit_id", normal_terms(F.col("terms")).alias("words"))
    hot = heavy_keys(rows, "hit_id")
    is_hot = F.col("hit_id").isin(list(hot.keys)) if hot.keys else F.lit(False)
    degrees = _degrees(rows.where(~is_hot).repartition("hit_id"), window).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("hit_id")))
    if hot.keys:
        finer = materialize(_degrees(rows.where(is_hot), window))
        lengths = finer.groupBy("hit_id").agg(F.count(F.lit(1)).alias("length"))
        degrees = degrees.unionByName(finer.join(F.broadcast(lengths), "hit_id"))
    degrees = materialize(degrees)
    records = rows.select("hit_id").distinct().count()
    mean = degrees.agg(F.sum(1 / F.col("length")), F.count(F.lit(1))).first()
    mean = mean[1] / mean[0] if mean[1] else 1.0  # a record of n terms has n rows
    holders = degrees.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    rarity = F.when(F.col("holders") > 1, F.log(F.lit(records + 1.0) / F.col("holders"))).otherwise(0.0)
    pivot = F.lit(1 - SLOPE) + F.lit(SLOPE) * F.col("length") / F.lit(float(mean))
    scored = skew_join(degrees, holders, "term", "inner").withColumn("rarity", rarity)
    return scored.select("hit_id", "term", "degree", "holders", "rarity", ((1 + F.col("degree")) / pivot * F.col("rarity")).alias("weight"))


def _degrees(rows: DataFrame, window: int) -> DataFrame:
    """hit_id, term, degree; each record's windows are formed inside its rows."""
    near = F.transform(
        F.col("words"),
        lambda t, i: F.struct(t.alias("term"), F.array_remove(F.array_distinct(F.slice(F.col("words"), F.greatest(F.lit(1), i + 2 - window), window - 1 + F.least(i + 1, F.lit(window)))), t).alias("near")),
    )
    each = rows.distinct().select("hit_id", F.explode(near).alias("x"))
    edges = each.select("hit_id", "x.term", F.explode_outer(F.transform("x.near", lambda t: F.xxhash64(t))).alias("neighbour")).distinct()
    return edges.groupBy("hit_id", "term").agg(F.count("neighbour").alias("degree"))
