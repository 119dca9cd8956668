"""Level-synchronous traversals: breadth-first closures, distances and ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.operators.skew import HeavyKeys, heavy_keys, skew_join
from codeskein.session import materialize

DAMPING, ITERATIONS, CONTAINER_WEIGHT = 0.85, 40, 0.5
#: Levels after which the lineage of a rank or a closure is cut.
CUT_EVERY = 8
#: Links up to which one task ranks them with arrays; more are ranked by distributed rounds, with the same result.
ONE_TASK_LINKS = 2_000_000
#: Links of one block of those rounds, about.
BLOCK_LINKS = 500_000
_BLOCK_TYPES = [("block", pa.int32()), *[(c, pa.binary()) for c in ("nodes", "dangling", "src", "share", "target", "ids", "ends")]]
_SENT_TYPES = [("block", pa.int32()), ("origin", pa.int32()), ("ids", pa.binary()), ("gained", pa.binary()), ("lost", pa.float64())]
_RANK_TYPES = [("node", pa.int64()), ("rank", pa.float64())]
_BLOCK = "block int, nodes binary, dangling binary, src binary, share binary, target binary, ids binary, ends binary"
_SENT = "block int, origin int, ids binary, gained binary, lost double"


def closure(seeds: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (node) along ``links`` (src, dst): node, depth, the seeds at depth 0.

    The links are worked out once. Every level joins the frontier to the links, removes what was visited and is written to the shared folder, and
    what was visited is written together every CUT_EVERY levels, so the plan doesn't grow; the loop ends at an empty
    frontier, which every finite graph reaches as no node is visited twice, or at ``max_depth``. Links of a source
    that holds very many are joined by broadcasting the frontier's few such nodes.
    """
    links = materialize(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    heavy: HeavyKeys = heavy_keys(links, "src")
    frontier = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = skew_join(links, frontier.select(F.col("node").alias("src")), "src", "inner", heavy)
        found = step.select(F.col("dst").alias("node")).distinct().join(visited.select("node"), "node", "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % CUT_EVERY == 0:
            visited = materialize(visited)
    return visited


def pairs_closure(links: DataFrame) -> DataFrame:
    """src, dst, depth: every node and what it reaches in one or more steps along ``links`` (src, dst), itself left out,
    with the least number of steps.

    Only pairs found in the last round go on; the loop ends when a round finds none. As many rows come out as there are
    such pairs: meant for shallow links such as overrides.
    """
    links = materialize(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    heavy: HeavyKeys = heavy_keys(links, "src")
    frontier = known = links.withColumn("depth", F.lit(1))
    steps = links.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for depth in count(2):
        step = skew_join(steps, frontier.select("src", F.col("dst").alias("at")), "at", "inner", heavy).select("src", F.col("next").alias("dst"))
        frontier = materialize(step.where("src <> dst").distinct().join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
        if depth % CUT_EVERY == 0:
            known = materialize(known)


def pagerank(nodes: DataFrame, links: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """node, rank after exactly ``iterations`` rounds; links: src, dst, weight, parallel ones add up.

    The mass of nodes without links is spread evenly. Up to ONE_TASK_LINKS one task ranks all; more go in blocks.
    """
    nodes = nodes.select("node").distinct()
    n = nodes.count()
    if not n or not iterations:
        return nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    folded = materialize(links.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    if n <= ONE_TASK_LINKS and folded.limit(ONE_TASK_LINKS + 1).count() <= ONE_TASK_LINKS:
        marked = folded.unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight")))
        return marked.coalesce(1).mapInPandas(_array_rank(iterations, damping), "node long, rank double")
    return _block_ranks(nodes, folded, n, iterations, damping)


def _block_ranks(nodes: DataFrame, folded: DataFrame, n: int, iterations: int, damping: float) -> DataFrame:
    """node, rank: nodes are dealt to blocks with the links that go out of them; in every round each block sends the
    others what their nodes gain, added up by node, and the mass of its nodes without links. The arrays of a block are
    one row, so a round moves few rows; CUT_EVERY rounds are one job."""
    blocks = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, math.ceil(folded.count() / BLOCK_LINKS))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    owned, dealt = nodes.select(of("node").alias("block"), "node"), folded.select(of("src").alias("block"), "src", "dst", of("dst").alias("to"), "weight")
    held = materialize(owned.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_block(blocks), _BLOCK))
    held = held.repartition(blocks, "block").persist()  # moved once, not in every job
    first, send, rank = (_block_round(gives, blocks, n, damping) for gives in (None, "send", "rank"))
    sent = held.groupBy("block").applyInArrow(first, _SENT)
    for k in range(1, iterations):
        sent = held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(send, _SENT)
        if k % CUT_EVERY == 0:
            sent = materialize(sent)
    ranks = materialize(held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(rank, "node long, rank double"))
    held.unpersist()
    return ranks


def _block(blocks: int):
    def run(owned: pa.Table, dealt: pa.Table) -> pa.Table:
        if not owned.num_rows:
            return _table(_BLOCK_TYPES, [])
        nodes = np.sort(owned["node"].to_numpy())
        src, dst, to, weight = (dealt[c].to_numpy() for c in ("src", "dst", "to", "weight"))
        place = np.minimum(np.searchsorted(nodes, src), len(nodes) - 1)
        known = nodes[place] == src
        place, dst, to, weight = place[known], dst[known], to[known], weight[known]
        total = np.bincount(place, weight, len(nodes))
        order = np.lexsort((dst, to))
        place, dst, to, share = place[order], dst[order], to[order], (weight / total[place])[order]
        new = np.append(True, dst[1:] != dst[:-1])[: len(dst)]
        ends = np.searchsorted(to[new], np.arange(blocks + 1))
        columns = [nodes, total == 0, place.astype(np.int32), share, (np.cumsum(new) - 1).astype(np.int32), dst[new], ends.astype(np.int64)]
        return _table(_BLOCK_TYPES, [[owned["block"][0].as_py(), *(c.tobytes() for c in columns)]])

    return run


def _block_round(gives: str | None, blocks: int, n: int, damping: float):
    """Takes what was sent to a block, if ``gives``; gives the rank of its nodes, or what it sends to the others."""

    def run(held: pa.Table, sent: pa.Table | None) -> pa.Table:
        if not held.num_rows:
            return _table(_RANK_TYPES if gives == "rank" else _SENT_TYPES, [])
        own = held.to_pylist()[0]
        read = lambda c, kind: np.frombuffer(own[c], kind)
        nodes, dangling, ids, ends = read("nodes", np.int64), read("dangling", bool), read("ids", np.int64), read("ends", np.int64)
        rank = np.full(len(nodes), 1.0 / n)
        if sent is not None:
            gained, lost = np.zeros(len(nodes)), 0.0
            for m in sorted(sent.to_pylist(), key=lambda m: m["origin"]):
                lost += m["lost"]
                to = np.frombuffer(m["ids"], np.int64)
                at = np.minimum(np.searchsorted(nodes, to), len(nodes) - 1)
                known = nodes[at] == to
                gained[at[known]] += np.frombuffer(m["gained"], np.float64)[known]
            rank = (1 - damping) / n + damping * (gained + lost / n)
        if gives == "rank":
            return pa.table({"node": nodes, "rank": rank})
        moved = np.bincount(read("target", np.int32), rank[read("src", np.int32)] * read("share", np.float64), len(ids))
        lost = float(rank[dangling].sum())
        return _table(_SENT_TYPES, [[b, own["block"], ids[i:j].tobytes(), moved[i:j].tobytes(), lost] for b, (i, j) in enumerate(zip(ends[:-1], ends[1:]))])

    return run if gives else lambda held: run(held, None)


def _table(types: list[tuple], rows: list[list]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(types)], schema=pa.schema(types))


def _array_rank(iterations: int, damping: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        nodes = np.sort(rows.loc[rows["dst"].isna(), "src"].to_numpy(np.int64))
        links = rows[rows["dst"].notna()]
        src, dst = np.searchsorted(nodes, links["src"].to_numpy(np.int64)), np.searchsorted(nodes, links["dst"].to_numpy(np.int64))
        n, weight = len(nodes), links["weight"].to_numpy(float)
        total = np.bincount(src, weight, n)
        share, dangling = weight / total[src], total == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            rank = (1 - damping) / n + damping * (np.bincount(dst, rank[src] * share, n) + rank[dangling].sum() / n)
        yield pd.DataFrame({"node": nodes, "rank": rank})

    return run


def rank_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of the rank: certain edges but containment, weight 1 + ln(count), and child to container with 0.5."""
    along = edges.where((F.col("edge_kind") != "Contains") & (F.coalesce("confidence", F.lit(0)) != 2))
    along = along.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), (1 + F.log(F.greatest(F.col("edge_count"), F.lit(1)))).alias("weight"))
    owner = symbols.select(F.col("id").alias("container_id"), F.col("seq").alias("dst"))
    inside = symbols.join(owner, "container_id").select(F.col("seq").alias("src"), "dst", F.lit(CONTAINER_WEIGHT).alias("weight"))
    return along.unionByName(inside)
