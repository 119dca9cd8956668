import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from codeskein.operators import closure as closures
from codeskein.operators.closure import closure, pagerank, pairs_closure
from codeskein.operators.communities import louvain, louvain_communities, synchronous_communities
from codeskein.plans import graph
from codeskein.plans.graph import percentile


def test_closure_gives_breadth_first_depths(spark):
    rng = random.Random(3)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(80)] + [(0, None), (None, 3)]
    df = spark.createDataFrame(links, "src long, dst long")
    depth, frontier = {0: 0, 5: 0}, [0, 5]
    while frontier:
        frontier = sorted({b for a, b in links if a in frontier and b is not None and b not in depth})
        depth.update({b: max(depth.values()) + 1 for b in frontier})
    found = {r["node"]: r["depth"] for r in closure(spark.createDataFrame([(0,), (5,), (5,)], "node long"), df, 50).collect()}
    assert found == depth
    assert closure(spark.createDataFrame([], "node long"), df, 5).count() == 0


def test_distributed_rank_equals_array_rank(spark, monkeypatch):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    links = spark.createDataFrame([(rng.randrange(25), rng.randrange(30), rng.random() + 0.1) for _ in range(90)], "src long, dst long, weight double")
    one = {r["node"]: r["rank"] for r in pagerank(nodes, links, 6).collect()}
    monkeypatch.setattr(closures, "ONE_TASK_LINKS", 0)
    many = {r["node"]: r["rank"] for r in pagerank(nodes, links, 6).collect()}
    assert one == pytest.approx(many) and sum(one.values()) == pytest.approx(1)
    assert pagerank(nodes.limit(0), links, 2).count() == 0


def test_rank_by_blocks_equals_array_rank(spark, monkeypatch):
    """Whatever the blocks: most nodes go out to one, some have no links, negative numbers, more rounds than one job holds."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i * 7 - 100,) for i in range(60)], "node long")
    rows = [((rng.randrange(40) if i % 3 else 3) * 7 - 100, (rng.randrange(60) if i % 2 else 8) * 7 - 100, rng.random() + 0.1) for i in range(200)]
    links = spark.createDataFrame(rows, "src long, dst long, weight double")
    one = {r["node"]: r["rank"] for r in pagerank(nodes, links, 19).collect()}
    monkeypatch.setattr(closures, "ONE_TASK_LINKS", 0)
    monkeypatch.setattr(closures, "BLOCK_LINKS", 9)
    many = {r["node"]: r["rank"] for r in pagerank(nodes, links, 19).collect()}
    assert len(many) == 60 and many == pytest.approx(one, rel=1e-12)


def test_percentile_is_distinct_for_ties(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(9)], "node long, rank double")
    got = percentile(rows, "rank", "node").orderBy("rank", "node").collect()
    assert [r["percentile"] for r in got] == [round(i / 8, 6) for i in range(9)]
    assert percentile(rows.limit(1), "rank", "node").first()["percentile"] == 1.0


def test_louvain_finds_two_cliques(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)]
    found = louvain(edges)
    assert found[0] == found[1] == found[2] != found[3] == found[4] == found[5]
    links = spark.createDataFrame(edges, "a long, b long, weight double")
    spread = {r["node"]: r["community"] for r in synchronous_communities(links).collect()}
    assert set(spread) == set(range(6)) and len(set(spread.values())) < 6
    assert links.agg(F.sum("weight")).first()[0] == 7


def test_registered_closures_run_to_the_end_of_deep_chains(spark):
    """Chains of eleven steps that close to a ring, compared with a walk without a bound."""
    ring, side = [(i, (i + 1) % 12) for i in range(12)], [(0, 20), (0, 21), (30, 0), (31, 0)]
    pairs = ring + side
    edges = spark.createDataFrame([(a, b, kind, 1, 0) for a, b in pairs for kind in ("Inherits", "Overrides")], "from_node long, to_node long, edge_kind string, edge_count long, confidence int")
    nodes = sorted({n for p in pairs for n in p})
    symbols = spark.createDataFrame([(n, f"T{n}", "Class", None) for n in nodes] + [(100 + n, f"M{n}", "Method", f"T{n}") for n in nodes], "seq long, id string, kind string, container_id string")
    rel = SimpleNamespace(spark=spark, edges=edges, references=edges, symbols=symbols)

    def walk(seeds, links):
        depth, frontier = dict.fromkeys(seeds, 0), set(seeds)
        while frontier:
            frontier = {b for a, b in links if a in frontier and b not in depth}
            depth.update(dict.fromkeys(frontier, max(depth.values()) + 1))
        return depth

    up, down = walk([0], pairs), walk([0], [(b, a) for a, b in pairs])
    family = walk(up, [(b, a) for a, b in pairs])
    assert max(up.values()) == max(down.values()) == 11
    got = lambda df: {r["node"]: r["depth"] for r in df.collect()}
    assert got(graph.bases(rel)) == {n: d for n, d in up.items() if d}
    assert got(graph.derived(rel)) == got(graph.implementations(rel)) == {n: d for n, d in down.items() if d}
    assert got(graph.called_as(rel)) == up
    assert {r["to_node"] for r in graph.family_references(rel).collect()} == {b for a, b in pairs if b in family}
    assert {r["container_id"]: r["depth"] for r in graph.inherited_members(rel).collect()} == {f"T{n}": d for n, d in up.items()}


def test_communities_are_the_same_by_joins_and_by_arrays_and_as_good_as_sequential_ones(spark):
    rng = random.Random(5)
    pairs = {(min(a, b), max(a, b)) for a in range(60) for b in rng.sample(range(a // 10 * 10, a // 10 * 10 + 10), 4) + [rng.randrange(60)] if a != b}
    edges = [(a, b, 1 + rng.random()) for a, b in sorted(pairs)]
    links = spark.createDataFrame(edges, "a long, b long, weight double")

    def quality(home):
        total, inside, degree = 0.0, 0.0, {}
        for a, b, w in edges:
            total += 2 * w
            inside += 2 * w * (home[a] == home[b])
            for n in (a, b):
                degree[home[n]] = degree.get(home[n], 0.0) + w
        return inside / total - sum(d * d for d in degree.values()) / total**2

    arrays = {r["node"]: r["community"] for r in louvain_communities(links).collect()}
    joins = {r["node"]: r["community"] for r in synchronous_communities(links).collect()}
    assert arrays == joins and set(arrays) == set(range(60))
    assert quality(arrays) > 0.97 * quality(louvain(edges))


def chain(spark, n):
    """0 <- 1 <- 2 ... and back from the end to the start, with a shortcut."""
    rows = [(i, i + 1) for i in range(n)] + [(n, 0), (0, 0), (None, 3), (3, None), (0, 2)]
    return spark.createDataFrame(rows, "src long, dst long")


def test_closure_goes_to_any_depth_and_ends_on_a_circle(spark):
    got = {r["node"]: r["depth"] for r in closure(spark.createDataFrame([(0,)], "node long"), chain(spark, 40)).collect()}
    assert got == {0: 0, 1: 1, **{i: i - 1 for i in range(2, 41)}}


def test_pairs_closure_has_every_pair_once(spark):
    rows = pairs_closure(chain(spark, 9)).collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == [(a, b) for a in range(10) for b in range(10) if a != b]
    assert pairs_closure(chain(spark, 9).limit(0)).count() == 0


def test_outermost_types_through_many_containers_and_circles(spark):
    class Tables:
        symbols = spark.createDataFrame(
            [(i, f"t{i}", f"t{i - 1}" if i else None, "Class") for i in range(20)] + [(50, "a", "b", "Class"), (51, "b", "c", "Class"), (52, "c", "a", "Class"), (53, "m", "a", "Method"), (54, "f", None, "Function")],
            "seq long, id string, container_id string, kind string",
        )

    got = {(r["seq"], r["top"]) for r in graph.top_level_types(Tables).collect()}
    assert got == {(i, "t0") for i in range(20)}
