"""Which members override or implement which, told from names, kinds and parameter types along the bases of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.operators.closure import pairs_closure
from codeskein.operators.skew import skew_join
from codeskein.relations import is_type

#: Modifiers of a member that others may override.
OPEN = ("virtual", "abstract", "override")


def members_of_types(symbols: DataFrame) -> DataFrame:
    """type, seq, id, key, modifiers, accessibility of members of types; ``key`` is name, kind and parameter types."""
    types = symbols.where(is_type(F.col("kind"))).select(F.col("id").alias("container_id"), F.col("seq").alias("type"))
    own = symbols.where(~is_type(F.col("kind")) & (F.col("kind") != "Constructor")).join(types, "container_id")
    none = F.array().cast("array<string>")
    kinds = F.transform(F.coalesce("parameters", F.array().cast("array<struct<name:string,type:string,modifier:string,default_value:string>>")), lambda p: F.coalesce(p["type"], F.lit("")))
    key = F.to_json(F.struct("name", "kind", kinds.alias("types")))
    return own.select("type", "seq", "id", key.alias("key"), F.coalesce("modifiers", none).alias("modifiers"), F.lower("accessibility").alias("accessibility"))


def _has(modifiers: str, *wanted: str) -> Column:
    return F.arrays_overlap(modifiers, F.array(*[F.lit(w) for w in wanted]))


def override_links(symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """member_id, base_member_id, depth: for every member that isn't static the member of the nearest base type, over
    any number of bases, with its name, kind and parameter types that is virtual, abstract or itself an override.

    bases: src, dst (nodes of types). Of several in equally near bases the lowest node counts; circles end the walk.
    """
    members = members_of_types(symbols)
    own = members.where(~_has("modifiers", "static")).select(F.col("type").alias("src"), F.col("id").alias("member_id"), "key")
    open_members = members.where(_has("modifiers", *OPEN)).select(F.col("type").alias("dst"), F.col("seq").alias("base_seq"), F.col("id").alias("base_member_id"), "key")
    # a type's members and its bases' both meet on the pair first, so that a common name is no hot key
    met = skew_join(pairs_closure(bases), own, "src", "inner").join(open_members, ["dst", "key"])
    return met.groupBy("member_id").agg(F.min_by("base_member_id", F.struct("depth", "base_seq")).alias("base_member_id"), F.min("depth").alias("depth"))


def implementation_links(symbols: DataFrame, bases: DataFrame, interfaces: DataFrame) -> DataFrame:
    """type, interface_member_id, member_id: what implements each member of an interface a type names: the first public
    member that isn't static of the type, else of its nearest base, with the same name, kind and parameter types.

    bases and interfaces: src, dst.
    """
    members = members_of_types(symbols)
    faces = interfaces.select(F.col("src").alias("type"), F.col("dst").alias("face")).distinct()
    wanted = skew_join(faces, members.select(F.col("type").alias("face"), F.col("id").alias("interface_member_id"), "key"), "face", "inner").select("type", "interface_member_id", "key")
    homes = pairs_closure(bases).select(F.col("src").alias("type"), F.col("dst").alias("home"), "depth")
    homes = faces.select("type", F.col("type").alias("home"), F.lit(0).alias("depth")).distinct().unionByName(homes.join(faces.select("type").distinct(), "type", "left_semi"))
    able = members.where((F.col("accessibility") == "public") & ~_has("modifiers", "static")).select(F.col("type").alias("home"), "seq", F.col("id").alias("member_id"), "key")
    found = skew_join(homes, able, "home", "inner").join(wanted, ["type", "key"])
    return found.groupBy("type", "interface_member_id").agg(F.min_by("member_id", F.struct("depth", "seq")).alias("member_id"))
