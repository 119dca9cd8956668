"""What a symbol argument stands for: an id in any of its short forms, a place in a file, or a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.operators.navigation import container_chain, declared_spans, innermost_spans, reference_positions
from codeskein.operators.skew import skew_join
from codeskein.relations import Relations, is_type
from codeskein.session import materialize

#: Stages in the order in which they are tried; the first that finds something decides.
STAGES = ("declared here", "referenced here", "enclosing", "id", "id without return type", "start of id", "simplified parameters", "name", "part of name", "external")
_PLACE = r"^(.+\.[A-Za-z]+):(\d+)(?::(\d+))?$"


def without_return(symbol_id: Column) -> Column:
    return F.regexp_replace(symbol_id, "~.*$", "")


def simplified(symbol_id: Column) -> Column:
    """The id with the name spaces of its parameters' types left out."""
    inside = F.regexp_replace(F.regexp_extract(symbol_id, r"\((.*)\)", 1), r"[\w`.:]*[.:](?=[\w`])", "")
    return F.concat(F.regexp_extract(symbol_id, r"^([^(]*)\(", 1), F.lit("("), inside, F.lit(")"))


def _grams(name: Column) -> Column:
    """The runs of three letters of a name, and those of one and two."""
    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1)), lambda i: F.substring(name, i, F.lit(n)))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _own_constructors_left_out(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits without the constructors of types that are hits of the same query themselves."""
    kinds = found.join(symbols.select(F.col("seq").alias("node"), "kind", "id", "container_id"), "node")
    types = kinds.where(is_type(F.col("kind"))).select("query", F.col("id").alias("container_id"))
    builds = kinds.where(F.col("kind") == "Constructor").join(types, ["query", "container_id"], "left_semi").select("query", "node")
    return found.join(builds, ["query", "node"], "left_anti")


def symbol_candidates(rel: Relations, asked: DataFrame) -> DataFrame:
    """query, node, id, n: what each asked string may stand for, n being the place of the deciding stage in STAGES.

    asked: query. A place is ``file:line`` or ``file:line:column`` with a whole path: the declaration that begins on the
    line (the innermost of several), else what the surest reference on it refers to, else the declaration around it; as
    the tables have no columns, a column is read over. Other strings are tried as an id, as an id without its return
    type, as its beginning up to ``(``, ``~`` or `` ` ``, with parameter types without their name spaces, then as a name,
    whole or in part, whose leading segments must be containers in order; case is ignored, and a type goes before its own
    constructors. Last come the ids and names of library members. Null and empty strings, and those that nothing stands
    for, give no row; repeated ones count once.
    """
    queries = materialize(asked.select(F.trim("query").alias("query")).where("query <> ''").distinct())
    symbols = rel.symbols
    place = queries.where(F.col("query").rlike(_PLACE)).select("query", F.regexp_extract("query", _PLACE, 1).alias("file"), F.regexp_extract("query", _PLACE, 2).cast("long").alias("line"))
    spans = declared_spans(rel)
    begun = place.join(spans.withColumnRenamed("start", "line"), ["file", "line"]).groupBy("query").agg(F.min_by("node", F.struct("end", "node")).alias("node"))
    at = reference_positions(rel).where("to_node IS NOT NULL")
    surest = place.join(at, ["file", "line"]).groupBy("query").agg(F.min_by("to_node", F.struct(F.coalesce("confidence", F.lit(0)), "edge_id")).alias("node"))
    around = place.join(innermost_spans(place, spans), ["file", "line"]).select("query", "node")

    def met(keys: DataFrame, by: DataFrame = queries) -> DataFrame:
        return skew_join(by, keys, "query", "inner").select("query", "node").distinct()

    def keyed(key: Column) -> DataFrame:
        return symbols.select(key.alias("query"), F.col("seq").alias("node")).where("query <> ''")

    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.when(F.substring("id", i, F.lit(1)).isin("(", "~", "`"), F.substring("id", F.lit(1), i - 1))), lambda x: x.isNotNull())
    starts = symbols.select(F.explode(cuts).alias("query"), F.col("seq").alias("node"))
    chained = container_chain(symbols).select(F.col("seq").alias("node"), F.lower("name").alias("name"), F.lower(F.concat(F.lit("/"), F.array_join("chain", "/"), F.lit("/"))).alias("chain"))
    segments = F.filter(F.split(F.lower("query"), r"\.|::"), lambda x: x != "")
    names = queries.select("query", segments.alias("s")).where(F.size("s") > 0)
    outer = F.reverse(F.slice("s", F.lit(1), F.size("s") - 1))
    escaped = F.transform(outer, lambda x: F.regexp_replace(x, r"([^\w])", r"\\$1"))
    names = names.select("query", F.element_at("s", -1).alias("name"), F.concat(F.lit("/"), F.array_join(escaped, "/(?:.*/)?"), F.lit("/")).alias("pattern"), F.size("s").alias("n"))
    fits = (F.col("n") == 1) | F.expr("chain RLIKE pattern")
    whole = skew_join(chained, names, "name", "inner").where(fits).select("query", "node")
    open_names = names.join(whole.select("query").distinct(), "query", "left_anti").withColumnRenamed("name", "part").withColumn("gram", F.substring("part", 1, 3))
    grams = chained.select("node", "name", "chain", F.explode(_grams(F.col("name"))).alias("gram"))
    inside = skew_join(grams, open_names, "gram", "inner").where(F.contains("name", "part") & fits).select("query", "node")
    outside = rel.externals.select("id", "name", "node")
    external = met(outside.select(F.col("id").alias("query"), "node").unionByName(outside.select(F.col("name").alias("query"), "node")))

    found = [begun, surest, around, met(keyed(F.col("id"))), met(keyed(without_return(F.col("id"))).join(symbols.where(F.contains("id", F.lit("~"))).select(F.col("seq").alias("node")), "node", "left_semi")), met(starts), met(keyed(simplified(F.col("id"))).where(F.contains("query", F.lit("(")))), whole, inside, external]
    every = None
    for n, hits in enumerate(found):
        hits = hits.select("query", "node").withColumn("n", F.lit(n))
        every = hits if every is None else every.unionByName(hits)
    first = Window.partitionBy("query")
    every = materialize(every.distinct().withColumn("first", F.min("n").over(first)).where("n = first").select("query", "node", "n"))
    every = _own_constructors_left_out(every.select("query", "node"), symbols).join(every, ["query", "node"])
    ids = symbols.select(F.col("seq").alias("node"), "id").unionByName(rel.externals.select("node", "id"))
    return every.join(ids, "node", "left").select("query", "node", "id", "n")


def resolve_symbols(rel: Relations, asked: DataFrame) -> DataFrame:
    """query, stage, candidates, node: how many symbols each asked string stands for, and the one with the least id."""
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("n") + 1)
    found = symbol_candidates(rel, asked).groupBy("query", "n").agg(F.count(F.lit(1)).alias("candidates"), F.min_by("node", F.struct("id", "node")).alias("node"))
    return found.select("query", stage.alias("stage"), "candidates", "node")
