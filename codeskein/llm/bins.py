"""Filling fixed-capacity containers by a grouping genetic algorithm on islands.

Texts larger than the container give full pieces, which fill containers of their own, and one rest. Rests and
smaller texts are sorted by size over the whole kind and dealt in turns, so that every block of about BLOCK_ITEMS
has the sizes of the whole. Each block is evolved on several islands, whose individuals are whole packings; after
every epoch each island passes its elite to the next one. A block that is proven to need as many containers as its
best packing has is left as it is. The containers that stay underfilled are opened again, and what they held is
dealt into new, fewer blocks, until one block is left; every kind goes its own way.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import nsmallest
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.session import materialize, shuffle_width

BLOCK_ITEMS = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION, CHILDREN = 2, 3, 3, 6, 3
#: Containers filled less than this are opened again while more than one block is left.
WELL_FILLED = 0.995
#: How far sizes are blurred to give the first packings of an island different orders.
BLUR = 0.3

Packing = list[list[int]]
#: Containers used, the fewer the better, and how unevenly they are filled: larger is better.
Worth = tuple[int, float]


def fewest_bins(sizes: list[int], cap: int) -> int:
    """A proven lower bound: for every threshold, items too large to share with one of that size stand alone, and what
    the other large ones leave open must take the small ones."""
    ordered = sorted(sizes)
    before = [0, *accumulate(ordered)]
    half = bisect_right(ordered, cap // 2)
    best = -(-before[-1] // cap)
    for t in {0, *ordered[:half]}:
        alone, small = bisect_right(ordered, cap - t), bisect_left(ordered, t)
        beside = max(half, alone) - half
        left = beside * cap - (before[max(half, alone)] - before[half])
        need = before[half] - before[min(small, half)] - left
        best = max(best, len(ordered) - max(half, alone) + beside + max(0, -(-need // cap)))
    return best


def _best_fit(items: list[int], sizes: list[int], cap: int, bins: Packing, room: list[tuple[int, int]]) -> None:
    """Puts ``items`` in their order, each where it leaves least room; ``room`` is sorted (room, bin)."""
    for i in items:
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            left, b = room.pop(k)
            bins[b].append(i)
        else:
            left, b = cap, len(bins)
            bins.append([i])
        insort(room, (left - sizes[i], b))


def _better_fill(inside: list[int], outside: list[int], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange between a bin and displaced items that fills its ``room`` best: gain, places to leave the bin,
    places to enter it. One or two leave for one, or one for two. ``outside`` is sorted."""
    gain, leave, enter = 0, (), ()
    singles = [(s, (p,)) for p, s in enumerate(inside)]
    pairs = [(inside[p] + inside[q], (q, p)) for p in range(len(inside)) for q in range(p)] if len(inside) < 8 else []
    for s, places in singles + pairs:
        k = bisect_right(outside, s + room) - 1
        if k >= 0 and outside[k] - s > gain:
            gain, leave, enter = outside[k] - s, places, (k,)
            if gain == room:
                return gain, leave, enter
    for s, places in singles:
        low, high = 0, len(outside) - 1
        while low < high:
            both = outside[low] + outside[high] - s
            if both > room:
                high -= 1
                continue
            if both > gain:
                gain, leave, enter = both, places, (low, high)
            low += 1
    return gain, leave, enter


def _loads(bins: Packing, sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


def _place(displaced: list[int], sizes: list[int], cap: int, bins: Packing, loads: list[int], rng: random.Random) -> None:
    """Displaced items first take the place of smaller ones where they fill a bin better, then all are best-fitted.
    ``loads`` are those of ``bins`` at the start."""
    room = [cap - x for x in loads]
    displaced = sorted(displaced, key=lambda i: (sizes[i], i))
    outside = [sizes[i] for i in displaced]
    order = [k for k, r in enumerate(room) if r]
    rng.shuffle(order)
    for k in order:
        if not outside:
            break
        gain, leave, enter = _better_fill([sizes[i] for i in bins[k]], outside, room[k])
        if not gain:
            continue
        entering = [displaced[e] for e in enter]
        for e in sorted(enter, reverse=True):
            del displaced[e], outside[e]
        for p in sorted(leave, reverse=True):
            i = bins[k].pop(p)
            at = bisect_left(outside, sizes[i])
            outside.insert(at, sizes[i])
            displaced.insert(at, i)
        bins[k] += entering
        room[k] -= gain
    _best_fit(displaced[::-1], sizes, cap, bins, sorted((r, k) for k, r in enumerate(room)))


def worth(bins: Packing, sizes: list[int], cap: int) -> Worth:
    """Fewer bins are better; of as many, the packing whose bins are filled less evenly, as its rests can be joined."""
    return -len(bins), sum([x * x for x in _loads(bins, sizes)]) / (cap * cap)


def crossover(a: Packing, b: Packing, sizes: list[int], cap: int, rng: random.Random) -> Packing:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` that share an item with them are emptied and
    what they held besides is placed again."""
    loads = _loads(b, sizes)
    best = sorted(range(len(b)), key=lambda k: -loads[k])[: max(1, len(b) // 2)]
    first = rng.randrange(len(best))
    injected = best[first : first + rng.randint(1, max(1, len(best) // 2))]
    bins, loads = [list(b[k]) for k in injected], [loads[k] for k in injected]
    taken = {i for x in bins for i in x}
    displaced = []
    for x, load in zip(a, _loads(a, sizes)):
        if taken.isdisjoint(x):
            bins.append(list(x))
            loads.append(load)
        else:
            displaced += [i for i in x if i not in taken]
    _place(displaced, sizes, cap, bins, loads, rng)
    return bins


def mutate(bins: Packing, sizes: list[int], cap: int, rng: random.Random) -> Packing:
    """Empties some of the worst-filled bins and a few others and places their items again."""
    if len(bins) < 3:
        return bins
    loads = _loads(bins, sizes)
    gone = {*nsmallest(rng.randint(1, 3), range(len(bins)), key=loads.__getitem__), *(rng.randrange(len(bins)) for _ in range(rng.randint(1, 4)))}
    kept = [k for k in range(len(bins)) if k not in gone]
    left = [list(bins[k]) for k in kept]
    _place([i for k in sorted(gone) for i in bins[k]], sizes, cap, left, [loads[k] for k in kept], rng)
    return left


def first_packing(sizes: list[int], cap: int, rng: random.Random, blur: float = 0.0) -> Packing:
    """Best fit, the largest first, by sizes blurred at random."""
    weight = [s * (1 + blur * (rng.random() - 0.5)) for s in sizes] if blur else sizes
    bins: Packing = []
    _best_fit(sorted(range(len(sizes)), key=lambda i: (-weight[i], i)), sizes, cap, bins, [])
    return bins


def evolve(sizes: list[int], cap: int, seeds: list[Packing], rng: random.Random, generations: int) -> list[Packing]:
    """The two best packings after ``generations``, from ``seeds`` or, without them, from best fits of several orders;
    ends early once no packing can have fewer bins."""
    fewest = fewest_bins(sizes, cap)
    packings = seeds or [first_packing(sizes, cap, rng)]
    population = [(worth(x, sizes, cap), x) for x in packings]
    if min(len(x) for x in packings) > fewest:
        while len(population) < POPULATION:
            x = first_packing(sizes, cap, rng, BLUR)
            population.append((worth(x, sizes, cap), x))
    population.sort(key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(population[0][1]) <= fewest:
            break
        for _ in range(CHILDREN):
            a, b = (max(rng.sample(population, 2), key=lambda x: x[0])[1] for _ in range(2))
            child = crossover(a, b, sizes, cap, rng)
            if rng.random() < 0.5:
                child = mutate(child, sizes, cap, rng)
            population.append((worth(child, sizes, cap), child))
        population = sorted(population, key=lambda x: x[0], reverse=True)[:POPULATION]
    return [x for _, x in population[:2]]


def _to_bins(places: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(places):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _to_places(bins: Packing, n: int) -> list[int]:
    places = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            places[i] = b
    return places


_ISLAND = "container_kind int, capacity long, block long, island int, doc_ids array<long>, pieces array<int>, sizes array<int>, elites array<array<int>>, used int, fill double, first_used int, fewest int"


def _epoch(epoch: int, level: int, generations: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            elites, used, fill, first, fewest = [], [], [], [], []
            for kind, cap, block, island, sizes, before in zip(pdf["container_kind"], pdf["capacity"], pdf["block"], pdf["island"], pdf["sizes"], pdf["elites"]):
                rng = random.Random(f"{kind}/{level}/{block}/{island}/{epoch}")
                sizes, cap = [int(x) for x in sizes], int(cap)
                seeds = [_to_bins([int(y) for y in x]) for x in before] if before is not None else []
                found = evolve(sizes, cap, seeds, rng, generations)
                elites.append([_to_places(x, len(sizes)) for x in found])
                used.append(len(found[0]))
                fill.append(worth(found[0], sizes, cap)[1])
                first.append(len(first_packing(sizes, cap, rng)) if before is None else 0)
                fewest.append(fewest_bins(sizes, cap) if before is None else 0)
            out = pdf.assign(elites=elites, used=used, fill=fill)
            yield out.assign(first_used=first, fewest=fewest) if epoch == 0 else out

    return run


def _evolve_blocks(items: DataFrame, level: int) -> DataFrame:
    """items: container_kind, capacity, doc_id, piece, size, block. Gives them with ``bin``, unique in the block, and
    with the block's containers: used, by the first best fit (first_used) and at least needed (fewest)."""
    # a fixed number of tasks: the rows are few and small, what is done with them is not
    width = shuffle_width(items.sparkSession)
    packed = items.repartition(width, "container_kind", "block").groupBy("container_kind", "capacity", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "size"))).alias("x"))
    none = F.lit(None)
    islands = packed.select(
        "container_kind", "capacity", "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("x.doc_id").alias("doc_ids"), F.col("x.piece").alias("pieces"), F.col("x.size").alias("sizes"),
        none.cast("array<array<int>>").alias("elites"), none.cast("int").alias("used"), none.cast("double").alias("fill"), none.cast("int").alias("first_used"), none.cast("int").alias("fewest"),
    )
    ring = Window.partitionBy("container_kind", "block").orderBy("island")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(EPOCHS):
        islands = islands.mapInPandas(_epoch(epoch, level, GENERATIONS), _ISLAND)
        if epoch + 1 < EPOCHS:
            islands = islands.repartition(width, "container_kind", "block")
            migrant = F.coalesce(F.lag(F.element_at("elites", 1)).over(ring), F.last(F.element_at("elites", 1)).over(whole))
            islands = islands.withColumn("elites", F.concat("elites", F.array(migrant)))
    figures = ("used", "first_used", "fewest")
    best = islands.groupBy("container_kind", "capacity", "block").agg(F.max_by(F.struct("doc_ids", "pieces", "sizes", F.element_at("elites", 1).alias("bins"), *figures), F.struct(-F.col("used"), "fill", -F.col("island"))).alias("b"))
    rows = F.arrays_zip("b.doc_ids", "b.pieces", "b.sizes", "b.bins")
    return best.select("container_kind", "capacity", "block", *[F.col(f"b.{f}") for f in figures], F.explode(rows).alias("r")).select(
        "container_kind", "capacity", "block", *figures, F.col("r.doc_ids").alias("doc_id"), F.col("r.pieces").alias("piece"), F.col("r.sizes").alias("size"), F.col("r.bins").alias("bin")
    )


def _deal(items: DataFrame, blocks: dict[int, int], level: int) -> DataFrame:
    """``items`` with ``block``: in the order of size they go to a kind's blocks in turns, back and forth.

    Positions come from a range-partitioned sort, in which a hash parts equal sizes, and from the counts of the
    ranges before; the broadcast table has one row per range and kind.
    """
    mixed = F.xxhash64(F.lit(level), "doc_id", "piece").alias("__mixed")
    ranged = materialize(items.select("container_kind", "capacity", "doc_id", "piece", "size", mixed).repartitionByRange("container_kind", "size", "__mixed").withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("container_kind", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("container_kind", "__part", (F.sum("n").over(Window.partitionBy("container_kind").orderBy("__part")) - F.col("n")).alias("__before"))
    inside = Window.partitionBy("container_kind", "__part").orderBy("size", "__mixed", "doc_id", "piece")
    at = F.col("__before") + F.row_number().over(inside) - 1
    n = F.lit(1)
    for kind, count in blocks.items():
        n = F.when(F.col("container_kind") == kind, count).otherwise(n)
    turn = F.pmod(at, n)
    block = F.when(F.pmod(F.floor(at / n), F.lit(2)) == 0, turn).otherwise(n - 1 - turn).cast("long")
    return ranged.join(F.broadcast(before), ["container_kind", "__part"]).select("container_kind", "capacity", "doc_id", "piece", "size", block.alias("block"))


def fill_containers(sized: DataFrame, kinds: DataFrame) -> DataFrame:
    """Assignment of every text to containers of every kind: container_kind, capacity, container, doc_id, piece, tokens,
    and of the block it was packed in: block_used, block_first (containers of plain best fit) and block_fewest (a lower
    bound), null for full pieces.

    sized: doc_id, tokens. A text within the capacity has one piece, 0. A larger one is split: piece k < last
    holds ``capacity`` tokens from token k * capacity on and has a container to itself; the last holds the rest.
    No container holds more than its capacity; every token of every text is placed once per kind. Null or
    negative tokens count as 0, and such texts are placed too. Rows repeated under a ``doc_id`` count once, the
    longest standing; null ids are left out. Kinds with a null or non-positive capacity are left out, of repeated
    kinds the largest capacity stands. Empty tables give no rows. ``container`` is unique within its kind.
    """
    texts = sized.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.greatest(F.lit(0), F.coalesce(F.max("tokens"), F.lit(0))).cast("long").alias("tokens"))
    texts = materialize(texts)
    caps = kinds.where((F.col("capacity_tokens") > 0) & F.col("container_kind").isNotNull()).groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    caps = [(r["container_kind"], r["capacity"]) for r in caps.collect()]
    figures = ("used", "first_used", "fewest")
    named = ("block_used", "block_first", "block_fewest")
    unknown = [F.lit(None).cast("int").alias(f) for f in named]
    if not caps:
        return texts.limit(0).select(F.lit(0).alias("container_kind"), F.lit(0).cast("long").alias("capacity"), F.lit("").alias("container"), "doc_id", F.lit(0).alias("piece"), "tokens", *unknown)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(caps)]))
    cut = texts.select("doc_id", "tokens", each.alias("k")).select("doc_id", "tokens", "k.*").withColumn("pieces", F.floor(F.col("tokens") / F.col("capacity")).cast("int"))
    rest = F.col("tokens") - F.col("pieces") * F.col("capacity")
    full = cut.where("pieces > 0").select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    done = full.select("container_kind", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", F.col("capacity").alias("tokens"), *unknown)

    def counted(items: DataFrame) -> dict[int, int]:
        return {r["container_kind"]: r["count"] for r in items.groupBy("container_kind").count().collect()}

    open_items = cut.where((rest > 0) | (F.col("pieces") == 0)).select("container_kind", "capacity", "doc_id", F.col("pieces").alias("piece"), rest.cast("int").alias("size"))
    level, held = 0, counted(open_items)
    while held:
        blocks = {k: -(-n // BLOCK_ITEMS) for k, n in held.items()}
        placed = materialize(_evolve_blocks(_deal(open_items, blocks, level), level))
        name = F.concat_ws("-", F.lit(f"l{level}"), "block", "bin").alias("container")
        columns = ["container_kind", "capacity", name, "doc_id", "piece", F.col("size").cast("long").alias("tokens"), *[F.col(f).alias(n) for f, n in zip(figures, named)]]
        fill = F.sum("size").over(Window.partitionBy("container_kind", "block", "bin")) / F.col("capacity")
        placed = materialize(placed.withColumn("again", (fill < WELL_FILLED) & F.col("container_kind").isin([k for k, n in blocks.items() if n > 1])))
        left = counted(placed.where("again"))
        # where well-filled containers are rare, pooling again would not shrink the rest: that kind is done
        held = {k: n for k, n in left.items() if n <= held[k] // 2}
        again = F.col("again") & F.col("container_kind").isin(list(held))
        done = done.unionByName(placed.where(~again).select(*columns))
        open_items = placed.where(again).select("container_kind", "capacity", "doc_id", "piece", "size")
        level += 1
    return done
