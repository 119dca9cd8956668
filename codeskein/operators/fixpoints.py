"""Fixpoints and orders over links: what survives repeated removal, levels of a dependency order, nearest members."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.operators.closure import closure
from codeskein.session import materialize


def greatest_fixpoint(candidates: DataFrame, needs: DataFrame) -> DataFrame:
    """The largest set of candidates (node) all of whose needs (node, needed) are in the set themselves.

    Every round removes what needs a removed or unknown node; it ends when nothing is removed.
    """
    kept = materialize(candidates.select("node").distinct())
    while True:
        broken = needs.join(kept.withColumnRenamed("node", "needed"), "needed", "left_anti").select("node").distinct()
        after = materialize(kept.join(broken, "node", "left_anti"))
        if after.count() == kept.count():
            return after
        kept = after


def dependency_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """node, level: 0 for nodes that need nothing, else one more than the highest level needed. Nodes on or behind a
    cycle have a null level."""
    left = materialize(nodes.select("node").distinct())
    needs = materialize(needs.select("node", "needed").join(left.withColumnRenamed("node", "needed"), "needed", "left_semi").distinct())
    done = None
    for level in count():
        waiting = needs.join(left.withColumnRenamed("node", "needed"), "needed", "left_semi").select("node").distinct()
        free = materialize(left.join(waiting, "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = materialize(left.join(free.select("node"), "node", "left_anti"))
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def nearest_members(start: DataFrame, bases: DataFrame, members: DataFrame, levels: int | None = None) -> DataFrame:
    """Members (type, name, member) of the nearest type that has one of a name, from ``start`` (node) through
    ``bases`` (src, dst): a name found at one level hides those of all further levels."""
    reached = closure(start, bases, levels)
    found = reached.join(members.withColumnRenamed("type", "node"), "node")
    nearest = found.groupBy("name").agg(F.min("depth").alias("depth"))
    return found.join(nearest, ["name", "depth"]).select("name", "depth", "node", "member")
