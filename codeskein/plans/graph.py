"""Queries of hierarchies, closures, ranks, paths and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.functions.text import is_test
from codeskein.operators.closure import closure, pagerank, pairs_closure, rank_links
from codeskein.operators.communities import community_links, louvain_communities, modularity, type_links
from codeskein.operators.hierarchy import implementation_links, override_links
from codeskein.operators.order import numbered
from codeskein.operators.skew import heavy_keys, skew_join
from codeskein.relations import DISPATCH_KINDS, EDGES_SQL, HIERARCHY_KINDS, STRUCTURAL_KINDS, Relations, certain, is_type
from codeskein.session import materialize

IMPACT_DEPTH = 3
PATH_DEPTH = 8


def _one(spark, node: int) -> DataFrame:
    return spark.createDataFrame([(node,)], "node long")


def _most(rel: Relations, end: str, kinds: tuple[str, ...]) -> int:
    """The node that stands at ``end`` of most edges of ``kinds``; a single number, -1 if there is none."""
    row = rel.edges.where(F.col("edge_kind").isin(*kinds)).groupBy(end).count().orderBy(F.desc("count"), end).first()
    return row[0] if row else -1


def _most_sql(end: str, kinds: tuple[str, ...]) -> str:
    return f"(SELECT {end} FROM edges WHERE edge_kind IN {kinds} GROUP BY {end} ORDER BY count(*) DESC, {end} LIMIT 1)"


def _links(rel: Relations, kinds: tuple[str, ...], reverse: bool = False) -> DataFrame:
    src, dst = ("to_node", "from_node") if reverse else ("from_node", "to_node")
    return rel.edges.where(F.col("edge_kind").isin(*kinds)).select(F.col(src).alias("src"), F.col(dst).alias("dst"))


def steps_sql(name: str, seed: str, links: str, bound: str = "true") -> str:
    """A recursive table (node, depth) of nodes with their least depths; every node is visited once."""
    return f"""{name}(node, depth) USING KEY (node) AS (SELECT * FROM ({seed})
        UNION SELECT dst, min(depth) + 1 FROM {name} JOIN ({links}) ON src = node WHERE {bound} AND dst NOT IN (SELECT node FROM recurring.{name}) GROUP BY dst)"""


def _walk_sql(seed: str, links: str, depth: int | None = None) -> str:
    """Closure with least depths, to ``depth`` if given; ``links`` gives src and dst."""
    bound = "true" if depth is None else f"depth < {depth}"
    return f"""WITH RECURSIVE {EDGES_SQL}, links AS ({links}), {steps_sql('walk', seed, 'SELECT * FROM links', bound)},
        reached AS (SELECT node, CAST(depth AS INTEGER) AS depth FROM walk)"""


def bases(rel: Relations) -> DataFrame:
    """All bases and interfaces of the type with most derived edges going out, nearest first."""
    return closure(_one(rel.spark, _most(rel, "from_node", HIERARCHY_KINDS)), _links(rel, HIERARCHY_KINDS)).where("depth > 0")


def derived(rel: Relations) -> DataFrame:
    return closure(_one(rel.spark, _most(rel, "to_node", HIERARCHY_KINDS)), _links(rel, HIERARCHY_KINDS, reverse=True)).where("depth > 0")


def implementations(rel: Relations) -> DataFrame:
    """Everything that derives from, implements or overrides a symbol, with the relation of the last step."""
    reached = closure(_one(rel.spark, _most(rel, "to_node", STRUCTURAL_KINDS)), _links(rel, STRUCTURAL_KINDS, reverse=True))
    above = reached.select(F.col("node").alias("to_node"), (F.col("depth") + 1).alias("depth"))
    steps = rel.edges.where(F.col("edge_kind").isin(*STRUCTURAL_KINDS)).join(above, "to_node").select(F.col("from_node").alias("node"), "depth", "edge_kind")
    return reached.where("depth > 0").join(steps, ["node", "depth"]).groupBy("node", "depth").agg(F.min("edge_kind").alias("relation"))


def called_as(rel: Relations) -> DataFrame:
    """Members through which a member may be called: what it overrides or implements, upwards."""
    return closure(_one(rel.spark, _most(rel, "from_node", DISPATCH_KINDS)), _links(rel, DISPATCH_KINDS))


def family_references(rel: Relations) -> DataFrame:
    """References to a member or to any member of its family: those it can be called as and what implements them."""
    up = called_as(rel)
    family = closure(up.select("node"), _links(rel, DISPATCH_KINDS, reverse=True)).select("node")
    refs = rel.references.join(family.withColumnRenamed("node", "to_node"), "to_node", "left_semi")
    return refs.groupBy("to_node").agg(F.count(F.when(certain(F.col("confidence")), 1)).alias("reference_count"), F.count(F.when(~certain(F.col("confidence")), 1)).alias("name_only"))


def inherited_members(rel: Relations) -> DataFrame:
    """Members of a type and of its bases with the depth of the declaring type; 32 nearest types at most."""
    types = rel.symbols.where(is_type(F.col("kind"))).select(F.col("seq").alias("node"), F.col("id").alias("container_id"))
    first = rel.edges.where(F.col("edge_kind").isin(*HIERARCHY_KINDS)).join(types.withColumnRenamed("node", "from_node"), "from_node", "left_semi").groupBy("from_node").count().orderBy(F.desc("count"), "from_node").first()
    reached = closure(_one(rel.spark, first[0] if first else -1), _links(rel, HIERARCHY_KINDS)).join(types, "node")
    near = reached.orderBy("depth", "node").limit(32)
    return near.join(rel.symbols.select("container_id", "id", "kind"), "container_id").select("container_id", "depth", "id", "kind")


def override_matches(rel: Relations) -> DataFrame:
    """Members and what they override by name: see hierarchy.override_links; certain Inherits edges give the bases."""
    return override_links(rel.symbols, _links(rel, ("Inherits",)))


def interface_matches(rel: Relations) -> DataFrame:
    return implementation_links(rel.symbols, _links(rel, ("Inherits",)), _links(rel, ("Implements",)))


def implementation_counts(rel: Relations) -> DataFrame:
    """Per member: members that override or implement it, directly or through others."""
    return pairs_closure(_links(rel, DISPATCH_KINDS, reverse=True)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("implementations"))


def page_rank(rel: Relations) -> DataFrame:
    return pagerank(rel.symbols.select(F.col("seq").alias("node")), rank_links(rel.edges, rel.symbols)).withColumn("rank", F.round("rank", 9))


def rank_percentile(rel: Relations) -> DataFrame:
    """i / (n - 1) in the order of rank and node, distinct even for ties; the order is by ranges, counts per range."""
    rank = page_rank(rel)
    return percentile(rank, "rank", "node")


def percentile(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """rows with ``percentile``: place in the order of ``by`` and ``tie`` as a part of the last one's."""
    share = F.when(F.col("total") <= 1, 1.0).otherwise(F.col("position") / (F.col("total") - 1))
    return numbered(rows, by, tie).select(*rows.columns, F.round(share, 6).alias("percentile"))


def impact(rel: Relations, depth: int = IMPACT_DEPTH) -> DataFrame:
    """What depends on the most referenced symbol: node, depth. Its direct members start too but aren't reported;
    structural edges are always followed, others unless found by name only."""
    start = _most(rel, "to_node", ("Calls", "Uses", "ReferencesType"))
    members = rel.edges.where((F.col("edge_kind") == "Contains") & (F.col("from_node") == start)).select(F.col("to_node").alias("node"))
    followed = rel.edges.where((F.col("edge_kind") != "Contains") & (F.col("edge_kind").isin(*STRUCTURAL_KINDS) | certain(F.col("confidence"))))
    reached = closure(_one(rel.spark, start).unionByName(members), followed.select(F.col("to_node").alias("src"), F.col("from_node").alias("dst")), depth)
    return reached.where("depth > 0")


_IMPACT_SQL = _walk_sql(
    f"SELECT {_most_sql('to_node', ('Calls', 'Uses', 'ReferencesType'))} AS node, 0 AS depth UNION SELECT to_node, 0 FROM edges WHERE edge_kind = 'Contains' AND from_node = {_most_sql('to_node', ('Calls', 'Uses', 'ReferencesType'))}",
    f"SELECT to_node AS src, from_node AS dst FROM edges WHERE edge_kind <> 'Contains' AND (edge_kind IN {STRUCTURAL_KINDS} OR coalesce(confidence, 0) <> 2)",
    IMPACT_DEPTH,
)


def impact_by_depth(rel: Relations) -> DataFrame:
    tests = rel.symbols.select(F.col("seq").alias("node"), is_test(F.col("file")).alias("t"))
    return impact(rel).join(tests, "node").groupBy("depth").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("t"), 1)).alias("test_members"))


def impact_by_project(rel: Relations) -> DataFrame:
    where = rel.symbols.select(F.col("seq").alias("node"), "project", is_test(F.col("file")).alias("t"))
    return impact(rel).join(where, "node").groupBy("project").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("t"), 1)).alias("test_members"))


def forward_edges(rel: Relations) -> DataFrame:
    """Certain calls, uses and type references, and dispatch reversed."""
    along = rel.edges.where(F.col("edge_kind").isin("Calls", "Uses") & certain(F.col("confidence"))).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    return along.unionByName(_links(rel, DISPATCH_KINDS, reverse=True)).distinct()


def path_lengths(rel: Relations) -> DataFrame:
    """Steps from the member with most calls to every member it can reach within eight."""
    return closure(_one(rel.spark, _most(rel, "from_node", ("Calls",))), forward_edges(rel), PATH_DEPTH)


def entry_points(rel: Relations) -> DataFrame:
    """Public methods and functions, or Main, that nothing calls or uses, that override nothing and call something:
    the 200 with most outgoing edges, Main first, then those outside tests, by reach over three steps; ten of them."""
    e = rel.edges
    used = e.where(F.col("edge_kind").isin("Calls", "Uses")).select(F.col("to_node").alias("seq"))
    dispatched = e.where(F.col("edge_kind").isin(*DISPATCH_KINDS)).select(F.col("from_node").alias("seq"))
    out = e.where(F.col("edge_kind").isin("Calls", "Uses")).groupBy(F.col("from_node").alias("seq")).agg(F.count(F.lit(1)).alias("out_degree"))
    fits = rel.symbols.where(F.col("kind").isin("Method", "Function") & ((F.lower("accessibility") == "public") | F.col("name").isin("Main", "main")))
    fits = fits.join(used, "seq", "left_anti").join(dispatched, "seq", "left_anti").join(out, "seq").select("seq", "id", "name", "file", "out_degree")
    fits = materialize(fits.orderBy(F.desc("out_degree"), "seq").limit(200))
    steps = materialize(e.where(F.col("edge_kind").isin("Calls", "Uses") & certain(F.col("confidence"))).select(F.col("from_node").alias("at"), "to_node").distinct())
    seen = fits.select("seq", F.col("seq").alias("at"))
    for _ in range(3):
        seen = materialize(seen.unionByName(seen.join(steps, "at").select("seq", F.col("to_node").alias("at"))).distinct())
    reach = seen.groupBy("seq").agg((F.count(F.lit(1)) - 1).alias("reach"))
    ranked = fits.join(reach, "seq").orderBy(F.desc(F.col("name") == "Main"), is_test(F.col("file")), F.desc("reach"), "id")
    return ranked.limit(10).select("id", "out_degree", "reach")


def top_level_types(rel: Relations) -> DataFrame:
    """Each symbol's outermost type, whatever the depth of nesting: every round doubles the containers skipped.

    What still moves after as many rounds as any chain could need runs in a circle and has no outermost type.
    """
    at = materialize(rel.symbols.select("seq", "id", F.col("container_id").alias("above"), F.lit(True).alias("more")))
    for _ in range(at.count().bit_length() + 1):
        owners = at.where("above IS NOT NULL").select(F.col("id").alias("above"), F.col("above").alias("further"))
        at = materialize(skew_join(at.drop("more"), owners, "above").select("seq", "id", F.coalesce("further", "above").alias("above"), F.col("further").isNotNull().alias("more")))
        if not at.where("more").limit(1).count():
            break
    types = rel.symbols.where(is_type(F.col("kind"))).select(F.col("id").alias("top"))
    return at.where("NOT more").select("seq", F.coalesce("above", "id").alias("top")).join(types, "top", "left_semi").select("seq", "top")


def _context_links(rel: Relations) -> DataFrame:
    """Every certain edge both ways: node, next, relation, priority, count; containment and bases go before calls, and
    what a member uses before what uses it."""
    near = rel.edges.where(certain(F.col("confidence")))
    order = F.when(F.col("edge_kind") == "Contains", 0).when(F.col("edge_kind").isin(*STRUCTURAL_KINDS), 1).when(F.col("edge_kind") == "Calls", 2).otherwise(3)
    out = near.select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col("edge_kind").alias("relation"), order.alias("priority"), "edge_count")
    back = near.select(F.col("to_node").alias("node"), F.col("from_node").alias("next"), F.col("edge_kind").alias("relation"), (order + 4).alias("priority"), "edge_count")
    return out.unionByName(back)


def context_hops(rel: Relations, seeds: DataFrame, hops: int, percentiles: DataFrame) -> DataFrame:
    """What lies within ``hops`` steps of ``seeds`` (node), which are left out: node, depth, relation, priority, weight.

    Of the edges over which a node is first reached the best relation counts, then the greatest weight: the node's
    percentile and a tenth of ln(1 + count).
    """
    links = materialize(_context_links(rel))
    heavy = heavy_keys(links, "node")
    frontier = visited = materialize(seeds.select("node").distinct())
    found = None
    for depth in range(1, hops + 1):
        step = skew_join(links, frontier, "node", "inner", heavy).select(F.col("next").alias("node"), "relation", "priority", F.log1p("edge_count").alias("count"))
        step = step.join(visited, "node", "left_anti").groupBy("node").agg(F.min(F.struct("priority", (-F.col("count")).alias("less"), "relation")).alias("x"))
        step = materialize(step.select("node", F.lit(depth).alias("depth"), F.col("x.relation").alias("relation"), F.col("x.priority").alias("priority"), (-F.col("x.less") / 10).alias("counted")))
        found = step if found is None else found.unionByName(step)
        frontier = step.select("node")
        visited = visited.unionByName(frontier)
    weight = F.round(F.coalesce("percentile", F.lit(0.0)) + F.col("counted"), 6).alias("weight")
    return found.join(percentiles, "node", "left").select("node", "depth", "relation", "priority", weight)


def context_neighbours(rel: Relations) -> DataFrame:
    """Two hops around the member with most calls."""
    return context_hops(rel, _one(rel.spark, _most(rel, "from_node", ("Calls",))), 2, rank_percentile(rel).select("node", "percentile"))


def types_by_project(rel: Relations) -> DataFrame:
    return rel.symbols.groupBy("project").agg(F.count(F.when(is_type(F.col("kind")), 1)).alias("types"), F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files"))


def namespace_topk(rel: Relations) -> DataFrame:
    counts = rel.symbols.where(F.coalesce("namespace", F.lit("")) != "").groupBy("project", "namespace").agg(F.count(F.lit(1)).alias("symbols"))
    order = Window.partitionBy("project").orderBy(F.desc("symbols"), "namespace")
    return counts.withColumn("place", F.row_number().over(order)).where("place <= 15")


def louvain(rel: Relations) -> DataFrame:
    return louvain_communities(type_links(rel))


_H, _S, _D = HIERARCHY_KINDS, STRUCTURAL_KINDS, DISPATCH_KINDS
_TYPES = "('Class', 'Struct', 'Interface', 'Enum', 'Record', 'RecordStruct', 'Delegate', 'Union', 'TypeAlias')"
_TESTED = "regexp_matches(coalesce(file, ''), '(?i)(?:^|[\\\\/])[^\\\\/]*Tests?(?:[\\\\/.]|$)')"
_UP = "SELECT from_node AS src, to_node AS dst FROM edges WHERE edge_kind IN {}"
_DOWN = "SELECT to_node AS src, from_node AS dst FROM edges WHERE edge_kind IN {}"
RANK_SQL = f"""WITH RECURSIVE {EDGES_SQL},
    links AS (
      SELECT a, b, sum(w) AS w FROM (
        SELECT from_node AS a, to_node AS b, 1 + ln(greatest(edge_count, 1)) AS w FROM edges WHERE edge_kind <> 'Contains' AND coalesce(confidence, 0) <> 2
        UNION ALL SELECT m.seq, o.seq, 0.5 FROM sym m JOIN sym o ON o.id = m.container_id) GROUP BY ALL),
    tot AS (SELECT a, sum(w) AS t FROM links GROUP BY a),
    n AS (SELECT count(*) AS n FROM sym),
    pr(it, id, v) AS (
      SELECT 0, seq, 1.0::DOUBLE / (SELECT n FROM n) FROM sym
      UNION ALL
      SELECT it + 1, id, sum(x) FROM (
        SELECT p.it AS it, l.b AS id, 0.85 * p.v * l.w / t.t AS x FROM pr p JOIN links l ON l.a = p.id JOIN tot t ON t.a = p.id WHERE p.it < 40
        UNION ALL
        SELECT p.it, p.id, 0.15 / (SELECT n FROM n) + 0.85 * (sum(CASE WHEN t.a IS NULL THEN p.v ELSE 0 END) OVER ()) / (SELECT n FROM n)
        FROM pr p LEFT JOIN tot t ON t.a = p.id WHERE p.it < 40) u GROUP BY it, id),
    ranked AS (SELECT id AS node, round(v, 9) AS rank FROM pr WHERE it = 40)"""

_MEMBERS_SQL = f"""members AS (SELECT t.seq AS type, m.seq, m.id, m.name, m.kind, m.modifiers, m.accessibility, list_transform(coalesce(m.parameters, []), lambda p: coalesce(p.type, '')) AS types
      FROM sym m JOIN sym t ON t.id = m.container_id WHERE t.kind IN {_TYPES} AND m.kind NOT IN {_TYPES} AND m.kind <> 'Constructor')"""
_PAIRS_SQL = """up AS (SELECT DISTINCT from_node AS src, to_node AS dst FROM edges WHERE edge_kind = 'Inherits'),
    pairs(src, dst, depth) USING KEY (src, dst) AS (SELECT src, dst, 1 FROM up
      UNION SELECT p.src, up.dst, min(p.depth) + 1 FROM pairs p JOIN up ON p.dst = up.src WHERE p.src <> up.dst AND (p.src, up.dst) NOT IN (SELECT (src, dst) FROM recurring.pairs) GROUP BY p.src, up.dst)"""

_CALLS: dict[str, tuple] = {
    "type_hierarchy_bases": (bases, _walk_sql(f"SELECT {_most_sql('from_node', _H)} AS node, 0 AS depth", _UP.format(_H)) + " SELECT * FROM reached WHERE depth > 0"),
    "derived_depth": (derived, _walk_sql(f"SELECT {_most_sql('to_node', _H)} AS node, 0 AS depth", _DOWN.format(_H)) + " SELECT * FROM reached WHERE depth > 0"),
    "find_implementations": (
        implementations,
        _walk_sql(f"SELECT {_most_sql('to_node', _S)} AS node, 0 AS depth", _DOWN.format(_S))
        + f" SELECT r.node, r.depth, min(edge_kind) AS relation FROM reached r JOIN edges ON from_node = r.node AND edge_kind IN {_S} JOIN reached u ON u.node = to_node AND u.depth + 1 = r.depth WHERE r.depth > 0 GROUP BY ALL",
    ),
    "called_as": (called_as, _walk_sql(f"SELECT {_most_sql('from_node', _D)} AS node, 0 AS depth", _UP.format(_D)) + " SELECT * FROM reached"),
    "find_references_family": (
        family_references,
        f"""WITH RECURSIVE {EDGES_SQL},
            {steps_sql('up', f"SELECT {_most_sql('from_node', _D)} AS node, 0 AS depth", _UP.format(_D))},
            {steps_sql('fam', 'SELECT DISTINCT node, 0 AS depth FROM up', _DOWN.format(_D))}
            SELECT to_node, count(*) FILTER (WHERE coalesce(confidence, 0) <> 2) AS reference_count, count(*) FILTER (WHERE confidence = 2) AS name_only
            FROM raw WHERE to_node IN (SELECT node FROM fam) GROUP BY to_node""",
    ),
    "inherited_members": (
        inherited_members,
        _walk_sql(f"SELECT (SELECT from_node FROM edges JOIN sym ON seq = from_node WHERE edge_kind IN {_H} AND kind IN {_TYPES} GROUP BY from_node ORDER BY count(*) DESC, from_node LIMIT 1) AS node, 0 AS depth", _UP.format(_H))
        + f", near AS (SELECT s.id, depth FROM reached JOIN sym s ON s.seq = node WHERE kind IN {_TYPES} ORDER BY depth, node LIMIT 32) SELECT m.container_id, depth, m.id, m.kind FROM near JOIN sym m ON m.container_id = near.id",
    ),
    "override_match": (
        override_matches,
        f"""WITH RECURSIVE {EDGES_SQL}, {_MEMBERS_SQL}, {_PAIRS_SQL}
            SELECT m.id AS member_id, arg_min(b.id, (depth, b.seq)) AS base_member_id, CAST(min(depth) AS INTEGER) AS depth FROM pairs JOIN members m ON m.type = src JOIN members b ON b.type = dst AND b.name = m.name AND b.kind = m.kind AND b.types = m.types
            WHERE NOT list_contains(m.modifiers, 'static') AND list_has_any(b.modifiers, ['virtual', 'abstract', 'override']) GROUP BY m.id""",
    ),
    "interface_match": (
        interface_matches,
        f"""WITH RECURSIVE {EDGES_SQL}, {_MEMBERS_SQL}, {_PAIRS_SQL},
            faces AS (SELECT DISTINCT from_node AS type, to_node AS face FROM edges WHERE edge_kind = 'Implements'),
            homes AS (SELECT type, face, type AS home, 0 AS depth FROM faces UNION ALL SELECT type, face, dst, depth FROM faces JOIN pairs ON src = type)
            SELECT h.type, i.id AS interface_member_id, arg_min(m.id, (h.depth, m.seq)) AS member_id FROM homes h JOIN members i ON i.type = h.face JOIN members m ON m.type = h.home AND m.name = i.name AND m.kind = i.kind AND m.types = i.types
            WHERE lower(m.accessibility) = 'public' AND NOT list_contains(m.modifiers, 'static') GROUP BY h.type, i.id""",
    ),
    "implementation_counts": (
        implementation_counts,
        f"""WITH RECURSIVE {EDGES_SQL}, d AS (SELECT DISTINCT to_node AS src, from_node AS dst FROM edges WHERE edge_kind IN {_D}),
            r(src, dst) AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON r.dst = d.src) SELECT src AS node, count(*) AS implementations FROM r WHERE src <> dst GROUP BY src""",
    ),
    "pagerank": (page_rank, RANK_SQL + " SELECT node, rank FROM ranked"),
    "rank_percentile": (rank_percentile, RANK_SQL + " SELECT node, rank, round((row_number() OVER (ORDER BY rank, node) - 1) / (SELECT n - 1 FROM n), 6) AS percentile FROM ranked"),
    "impact_analysis": (impact, _IMPACT_SQL + " SELECT * FROM reached WHERE depth > 0"),
    "impact_by_depth": (impact_by_depth, _IMPACT_SQL + f" SELECT depth, count(*) AS members, count(*) FILTER (WHERE {_TESTED}) AS test_members FROM reached JOIN sym ON seq = node WHERE depth > 0 GROUP BY depth"),
    "impact_by_project": (impact_by_project, _IMPACT_SQL + f" SELECT project, count(*) AS members, count(*) FILTER (WHERE {_TESTED}) AS test_members FROM reached JOIN sym ON seq = node WHERE depth > 0 GROUP BY project"),
    "find_path_lengths": (
        path_lengths,
        _walk_sql(
            f"SELECT {_most_sql('from_node', ('Calls', 'Calls'))} AS node, 0 AS depth",
            f"SELECT from_node AS src, to_node AS dst FROM edges WHERE edge_kind IN ('Calls', 'Uses') AND coalesce(confidence, 0) <> 2 UNION SELECT to_node, from_node FROM edges WHERE edge_kind IN {_D}",
            PATH_DEPTH,
        )
        + " SELECT * FROM reached",
    ),
    "entry_points": (
        entry_points,
        f"""WITH {EDGES_SQL}, o AS (SELECT from_node, count(*) AS out_degree FROM edges WHERE edge_kind IN ('Calls', 'Uses') GROUP BY from_node),
            fits AS (SELECT seq, id, name, file, out_degree FROM sym JOIN o ON from_node = seq WHERE kind IN ('Method', 'Function') AND (lower(accessibility) = 'public' OR name IN ('Main', 'main'))
              AND seq NOT IN (SELECT to_node FROM edges WHERE edge_kind IN ('Calls', 'Uses')) AND seq NOT IN (SELECT from_node FROM edges WHERE edge_kind IN {_D}) ORDER BY out_degree DESC, seq LIMIT 200),
            steps AS (SELECT DISTINCT from_node AS a, to_node AS b FROM edges WHERE edge_kind IN ('Calls', 'Uses') AND coalesce(confidence, 0) <> 2),
            r1 AS (SELECT seq, seq AS x FROM fits UNION SELECT seq, b FROM fits JOIN steps ON a = seq), r2 AS (SELECT * FROM r1 UNION SELECT seq, b FROM r1 JOIN steps ON a = x),
            r3 AS (SELECT * FROM r2 UNION SELECT seq, b FROM r2 JOIN steps ON a = x), c AS (SELECT seq, count(*) - 1 AS reach FROM r3 GROUP BY seq)
            SELECT id, out_degree, reach FROM fits JOIN c USING (seq) ORDER BY (name = 'Main') DESC, {_TESTED}, reach DESC, id LIMIT 10""",
    ),
    "top_level_types": (
        top_level_types,
        f"""WITH RECURSIVE {EDGES_SQL}, up(seq, id, above) AS (SELECT seq, id, container_id FROM sym UNION SELECT up.seq, o.id, o.container_id FROM up JOIN sym o ON o.id = up.above)
            SELECT up.seq, up.id AS top FROM up JOIN sym t ON t.id = up.id WHERE above IS NULL AND t.kind IN {_TYPES}""",
    ),
    "context_neighbors": (
        context_neighbours,
        f"""{RANK_SQL}, pc AS (SELECT node, round((row_number() OVER (ORDER BY rank, node) - 1) / (SELECT n - 1 FROM n), 6) AS percentile FROM ranked),
            o AS (SELECT from_node, to_node, edge_kind, edge_count, CASE WHEN edge_kind = 'Contains' THEN 0 WHEN edge_kind IN {_S} THEN 1 WHEN edge_kind = 'Calls' THEN 2 ELSE 3 END AS p FROM edges WHERE coalesce(confidence, 0) <> 2),
            l AS (SELECT from_node AS start, to_node AS node, edge_kind, p, edge_count FROM o UNION ALL SELECT to_node, from_node, edge_kind, p + 4, edge_count FROM o),
            d0 AS (SELECT {_most_sql('from_node', ('Calls', 'Calls'))} AS node),
            d1 AS (SELECT l.*, 1 AS depth FROM l JOIN d0 ON start = d0.node WHERE l.node NOT IN (SELECT node FROM d0)),
            d2 AS (SELECT l.*, 2 AS depth FROM l WHERE start IN (SELECT node FROM d1) AND l.node NOT IN (SELECT node FROM d0 UNION ALL SELECT node FROM d1)),
            b AS (SELECT *, ln(1 + edge_count) AS w FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY p, edge_count DESC, edge_kind) = 1)
            SELECT b.node, depth, edge_kind AS relation, p AS priority, round(coalesce(percentile, 0) + w / 10, 6) AS weight FROM b LEFT JOIN pc ON pc.node = b.node""",
    ),
    "types_by_project": (types_by_project, f"WITH {EDGES_SQL} SELECT project, count(*) FILTER (WHERE kind IN {_TYPES}) AS types, count(*) AS symbols, count(DISTINCT file) AS files FROM sym GROUP BY project"),
    "namespace_topk": (
        namespace_topk,
        f"WITH {EDGES_SQL}, c AS (SELECT project, namespace, count(*) AS symbols FROM sym WHERE coalesce(namespace, '') <> '' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY symbols DESC, namespace) AS INTEGER) AS place FROM c QUALIFY place <= 15",
    ),
    "community_links": (
        lambda r: community_links(r),
        f"""WITH {EDGES_SQL} SELECT least(a.project, b.project) AS a, greatest(a.project, b.project) AS b, round(sum(1 + ln(greatest(edge_count, 1))), 6) AS weight
            FROM edges JOIN sym a ON a.seq = from_node JOIN sym b ON b.seq = to_node WHERE edge_kind <> 'Contains' AND coalesce(confidence, 0) <> 2 AND a.project <> b.project GROUP BY ALL""",
    ),
    "modularity": (
        lambda r: modularity(r),
        f"""WITH {EDGES_SQL}, l AS (SELECT a.project AS pa, b.project AS pb, 1 + ln(greatest(edge_count, 1)) AS w FROM edges JOIN sym a ON a.seq = from_node JOIN sym b ON b.seq = to_node WHERE edge_kind <> 'Contains' AND coalesce(confidence, 0) <> 2),
            d AS (SELECT p, sum(w) AS deg FROM (SELECT pa AS p, w FROM l UNION ALL SELECT pb, w FROM l) GROUP BY p)
            SELECT round((SELECT 2 * sum(CASE WHEN pa = pb THEN w ELSE 0 END) FROM l) / sum(deg) - sum(deg * deg) / (sum(deg) * sum(deg)), 6) AS modularity FROM d""",
    ),
    "louvain": (louvain, None),
}

QUERIES = {name: (lambda spark, folder, f=f: f(Relations(spark, folder))) for name, (f, _) in _CALLS.items()}
SQL = {name: sql for name, (_, sql) in _CALLS.items() if sql}
