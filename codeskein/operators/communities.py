"""Communities of types: links, modularity and Louvain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.operators.order import numbered
from codeskein.relations import Relations, certain, is_type
from codeskein.session import materialize

LEVELS, PASSES, LEAST_GAIN = 20, 50, 1e-12
#: Links up to which one task runs a level by arrays; larger levels are run by joins, with the same result.
ONE_TASK_LINKS = 2_000_000
#: Rounds between two looks at modularity, the least rise with which they go on, and the least gain of a move.
ROUNDS, LEAST_RISE, LEAST_STEP = 4, 1e-6, 1e-6
#: Weights are counted in parts of this size.
WEIGHT_SCALE = 2.0**20


def weighted_edges(rel: Relations) -> DataFrame:
    """from_node, to_node, weight of certain edges that aren't containment."""
    kept = rel.edges.where((F.col("edge_kind") != "Contains") & certain(F.col("confidence")))
    return kept.select("from_node", "to_node", (1 + F.log(F.greatest(F.col("edge_count"), F.lit(1)))).alias("weight"))


def _projects(rel: Relations) -> DataFrame:
    a = rel.symbols.select(F.col("seq").alias("from_node"), F.col("project").alias("pa"))
    b = rel.symbols.select(F.col("seq").alias("to_node"), F.col("project").alias("pb"))
    return weighted_edges(rel).join(a, "from_node").join(b, "to_node").select("pa", "pb", "weight")


def community_links(rel: Relations) -> DataFrame:
    """Undirected link weight between every two projects."""
    links = _projects(rel).where("pa <> pb")
    return links.groupBy(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.round(F.sum("weight"), 6).alias("weight"))


def modularity(rel: Relations) -> DataFrame:
    """Modularity of the partition into projects."""
    links = _projects(rel)
    inside = links.agg((2 * F.sum(F.when(F.col("pa") == F.col("pb"), F.col("weight")).otherwise(0))).alias("inside"))
    ends = links.select(F.col("pa").alias("p"), "weight").unionByName(links.select(F.col("pb").alias("p"), "weight"))
    degrees = ends.groupBy("p").agg(F.sum("weight").alias("deg")).agg(F.sum("deg").alias("total"), F.sum(F.col("deg") * F.col("deg")).alias("squares"))
    return degrees.join(F.broadcast(inside)).select(F.round(F.col("inside") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total")), 6).alias("modularity"))


def type_links(rel: Relations) -> DataFrame:
    """Links between outermost types: a, b (a < b), weight."""
    top = rel.symbols.select("seq", F.coalesce("container_id", F.when(is_type(F.col("kind")), F.col("id"))).alias("top")).where("top IS NOT NULL")
    number = rel.symbols.select(F.col("id").alias("top"), F.col("seq").alias("type"))
    of = top.join(number, "top").select("seq", "type")
    links = weighted_edges(rel).join(of.select(F.col("seq").alias("from_node"), F.col("type").alias("x")), "from_node").join(of.select(F.col("seq").alias("to_node"), F.col("type").alias("y")), "to_node")
    return links.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"))


def louvain(edges: list[tuple[int, int, float]], resolution: float = 1.0) -> dict[int, int]:
    """Communities by visits one after another, to compare with: nodes in ascending order move to the neighbouring community of
    greatest gain until none improves, then communities become nodes; numbered by size, the largest 0."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    member = {n: i for i, n in enumerate(nodes)}
    graph: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = member[a], member[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        if i != j:
            graph[j][i] = graph[j].get(i, 0.0) + w
    group = list(range(len(nodes)))
    for _ in range(LEVELS):
        degree = [sum(w * (2 if j == i else 1) for j, w in links.items()) for i, links in enumerate(graph)]
        total = sum(degree)
        home, weight = list(range(len(graph))), list(degree)
        moved = False
        for _ in range(PASSES):
            better = False
            for i, links in enumerate(graph):
                old = home[i]
                weight[old] -= degree[i]
                near: dict[int, float] = {old: 0.0}
                for j, w in links.items():
                    if j != i:
                        near[home[j]] = near.get(home[j], 0.0) + w
                best, most = old, near[old] - resolution * weight[old] * degree[i] / total
                for c, w in near.items():
                    gain = w - resolution * weight[c] * degree[i] / total
                    if gain > most + LEAST_GAIN:
                        best, most = c, gain
                weight[best] += degree[i]
                home[i] = best
                better |= best != old
            moved |= better
            if not better:
                break
        if not moved:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(home))}
        group = [names[home[g]] for g in group]
        folded: list[dict[int, float]] = [{} for _ in names]
        for i, links in enumerate(graph):
            for j, w in links.items():
                if j >= i:
                    a, b = names[home[i]], names[home[j]]
                    folded[a][b] = folded[a].get(b, 0.0) + w
                    if a != b:
                        folded[b][a] = folded[b].get(a, 0.0) + w
        graph = folded
    sizes: dict[int, int] = {}
    for g in group:
        sizes[g] = sizes.get(g, 0) + 1
    order = {g: k for k, g in enumerate(sorted(sizes, key=lambda g: (-sizes[g], g)))}
    return {n: order[group[i]] for n, i in member.items()}


def _turn(node, k: int):
    """Whether a node (a number, an array or a column) may move in round ``k``: half of the nodes, others each time."""
    mixed = (node % 2147483648 * 2654435761 + (k + 1) * 2654445111) % 4294967296
    return (F.floor(mixed / 65536) if isinstance(node, Column) else mixed // 65536) % 2 == 0


def _array_level(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One level by arrays: the place of the community of each node; ``own`` has the weight inside each node."""
    n = len(nodes)
    i, j, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    degree = np.bincount(i, w, n) + 2 * own
    total, inside = degree.sum(), 2 * own.sum()

    def quality(home: np.ndarray) -> float:
        size = np.bincount(home, degree, n)
        return (w[home[i] == home[j]].sum() + inside) / total - (size * size).sum() / (total * total)

    home = best = np.arange(n)
    most, k = quality(home), 0
    while True:
        for _ in range(ROUNDS):
            turn = _turn(nodes, k)[i]
            k += 1
            key, which = np.unique(i[turn] * n + home[j[turn]], return_inverse=True)
            towards, node, to = np.bincount(which, w[turn], len(key)), key // n, key % n
            size, members, old = np.bincount(home, degree, n), np.bincount(home, minlength=n), home[node]
            stay = np.zeros(n)
            stay[node[to == old]] = towards[to == old]
            stay -= (size[home] - degree) * degree / total
            gain = towards - size[to] * degree[node] / total
            ok = (to != old) & ~((members[old] == 1) & (members[to] == 1) & (to > old)) & (gain > stay[node] + LEAST_STEP)
            order = np.lexsort((to[ok], -gain[ok], node[ok]))
            node, to = node[ok][order], to[ok][order]
            first = np.ones(len(node), bool)
            first[1:] = node[1:] != node[:-1]
            home = home.copy()
            home[node[first]] = to[first]
        now = quality(home)
        if now > most:
            best = home
        if now <= most + LEAST_RISE:
            return best
        most = now


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All levels by arrays: node, community (the node it is named by)."""
    rows = pd.concat(list(batches))
    if rows.empty:
        return
    x, y, w = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["weight"].to_numpy(float)
    nodes = start = np.unique(np.concatenate([x, y]))
    at = np.arange(len(nodes))
    a, b = np.searchsorted(nodes, x), np.searchsorted(nodes, y)
    while True:
        n, same = len(nodes), a == b
        own = np.bincount(a[same], w[same], n)
        home = _array_level(nodes, a[~same], b[~same], w[~same], own)
        kept, place = np.unique(home, return_inverse=True)
        if len(kept) == n:
            break
        at, nodes = place[at], nodes[kept]
        low, high = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
        key, which = np.unique(low * len(kept) + high, return_inverse=True)
        a, b, w = key // len(kept), key % len(kept), np.bincount(which, w, len(key))
    yield pd.DataFrame({"node": start, "community": nodes[at]})


def louvain_communities(links: DataFrame) -> DataFrame:
    """node, community. Rounds in which half of the nodes move to the neighbouring community of greatest gain are
    repeated until modularity rises no more, then communities become nodes, until nothing is folded. A level of up to
    ONE_TASK_LINKS links runs by arrays in one task, after counting, a larger one by joins, with the same result. The
    numbers are by size, the largest 0."""
    return synchronous_communities(links, ONE_TASK_LINKS)


def synchronous_communities(links: DataFrame, one_task_links: int = 0) -> DataFrame:
    # whole weights, so that sums don't depend on their order
    links = materialize(links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.sum("weight") * WEIGHT_SCALE).alias("weight")))
    found = None
    while True:
        if links.limit(one_task_links + 1).count() <= one_task_links:
            level, more = materialize(links.coalesce(1).mapInPandas(_run, "node long, community long")), False
        else:
            level = _joined_level(links)
            more = level.where("node <> community").limit(1).count() > 0
        found = level if found is None else materialize(found.join(level.select(F.col("node").alias("community"), F.col("community").alias("above")), "community").select("node", F.col("above").alias("community")))
        if not more:
            break
        ends = links.join(level.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(level.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
        links = materialize(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight")))
    sizes = found.groupBy("community").agg((-F.count(F.lit(1))).alias("smaller"))
    numbers = numbered(sizes, "smaller", "community").select("community", F.col("position").alias("number"))
    return found.join(numbers, "community").select("node", F.col("number").cast("long").alias("community"))


def _joined_level(links: DataFrame) -> DataFrame:
    """One level by joins: node, community; what _array_level gives."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))  # what is inside a node counts twice
    both = materialize(ways.where("a <> b"))
    state = materialize(ways.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")).withColumn("community", F.col("node")))
    total = state.agg(F.sum("degree")).first()[0] or 1.0

    def quality(state: DataFrame) -> float:
        home = state.select("node", "community")
        near = ways.join(home.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(home.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
        inside = near.where("x = y").agg(F.sum("weight")).first()[0] or 0.0
        squares = state.groupBy("community").agg(F.sum("degree").alias("size")).agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0.0
        return inside / total - squares / (total * total)

    best, most, k = state, quality(state), 0
    while True:
        for _ in range(ROUNDS):
            sizes = state.groupBy("community").agg(F.sum("degree").alias("size"), F.count(F.lit(1)).alias("members"))
            near = both.where(_turn(F.col("a"), k)).join(state.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("towards"))
            k += 1
            own = state.withColumnRenamed("community", "old").join(sizes.select(F.col("community").alias("old"), F.col("size").alias("old_size"), F.col("members").alias("old_members")), "old")
            near = near.join(sizes, "community").join(own, "node")
            other = F.col("community") != F.col("old")
            may = other & ~((F.col("old_members") == 1) & (F.col("members") == 1) & (F.col("community") > F.col("old")))
            gain = F.col("towards") - F.col("size") * F.col("degree") / total
            stay = F.coalesce(F.max(F.when(~other, F.col("towards"))), F.lit(0.0)) - (F.first("old_size") - F.first("degree")) * F.first("degree") / total
            moves = near.groupBy("node").agg(F.max(F.when(may, F.struct(gain.alias("gain"), (-F.col("community")).alias("to")))).alias("x"), stay.alias("stay"))
            moves = moves.where(F.col("x.gain") > F.col("stay") + LEAST_STEP).select("node", (-F.col("x.to")).alias("to"))
            state = materialize(state.join(moves, "node", "left").select("node", "degree", F.coalesce("to", "community").alias("community")))
        now = quality(state)
        if now > most:
            best = state
        if now <= most + LEAST_RISE:
            return best.select("node", "community")
        most = now
