import random
from collections import Counter, defaultdict

from codeskein.llm import bins
from codeskein.llm.bins import crossover, evolve, fewest_bins, fill_containers, first_packing, worth

SIZED, KINDS = "doc_id long, tokens long, bin string, piece string", "container_kind int, capacity_tokens int"


def test_crossover_keeps_every_item_once_and_capacity():
    rng = random.Random(1)
    sizes = [rng.randint(0, 60) for _ in range(80)]
    a, b = (evolve(sizes, 100, [], random.Random(s), 0)[0] for s in (1, 2))
    for s in range(30):
        child = crossover(a, b, sizes, 100, random.Random(s))
        assert sorted(i for x in child for i in x) == list(range(80))
        assert all(sum(sizes[i] for i in x) <= 100 for x in child)
        a = child


def triplets(count, cap, rng):
    """Sizes that fill ``count`` bins by threes without a rest."""
    sizes = []
    for _ in range(count):
        a = rng.randint(cap * 38 // 100, cap * 49 // 100)
        b = rng.randint((cap - a) * 42 // 100, (cap - a) // 2)
        sizes += [a, b, cap - a - b]
    rng.shuffle(sizes)
    return sizes


def test_evolution_uses_fewer_bins_than_best_fit():
    for seed in range(3):
        sizes = triplets(60, 512, random.Random(seed))
        plain = len(first_packing(sizes, 512, random.Random(0)))
        evolved = evolve(sizes, 512, [], random.Random(0), 20)[0]
        assert 60 <= len(evolved) <= plain - 4
        assert sorted(i for x in evolved for i in x) == list(range(180)) and all(sum(sizes[i] for i in x) <= 512 for x in evolved)
    rng = random.Random(9)
    uniform = [rng.randint(100, 260) for _ in range(250)]
    assert len(evolve(uniform, 512, [], rng, 10)[0]) < len(first_packing(uniform, 512, rng))


def test_more_generations_never_make_it_worse():
    sizes = triplets(30, 100, random.Random(4))
    found = [worth(evolve(sizes, 100, [], random.Random(1), g)[0], sizes, 100) for g in (0, 4, 16)]
    assert found == sorted(found)


def test_the_lower_bound_holds_and_is_met_where_large_items_stand_alone():
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.randint(4, 60)
        sizes = [rng.randint(0, cap) for _ in range(rng.randint(1, 40))]
        assert -(-sum(sizes) // cap) <= fewest_bins(sizes, cap) <= len(first_packing(sizes, cap, rng))
    assert fewest_bins([60] * 7, 100) == 7 and fewest_bins([60, 60, 50, 50, 30], 100) == 3


def verify(rows, sized, kinds):
    placed, load = defaultdict(int), Counter()
    for r in rows:
        placed[r["container_kind"], r["doc_id"]] += r["tokens"]
        load[r["container_kind"], r["container"]] += r["tokens"]
        assert load[r["container_kind"], r["container"]] <= r["capacity"]
    for k, cap in kinds.items():
        for d, t in sized.items():
            assert placed[k, d] == t
            pieces = sorted((r["piece"], r["tokens"]) for r in rows if r["container_kind"] == k and r["doc_id"] == d)
            assert [p for p, _ in pieces] == list(range(len(pieces))) and all(n == cap for _, n in pieces[:-1])
            assert len(pieces) == 1 or t > cap
    return load


def best_fit_decreasing(sized, cap):
    """Containers that one sequential best fit over all rests needs, full pieces included."""
    room, full = [], sum(t // cap for t in sized.values())
    for size in sorted((t % cap for t in sized.values() if t % cap), reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - size)
        else:
            room.append(cap - size)
    return full + len(room)


def test_every_token_once_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(bins, "BLOCK_ITEMS", 40)
    rng = random.Random(7)
    sized = {i: rng.choice([0, 1, 30, 55, 100, 101, 250, rng.randint(1, 99)]) for i in range(150)}
    rows = [(i, t, None, None) for i, t in sized.items()]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 5, None, None)], SIZED)
    kinds = spark.createDataFrame([(1, 100), (2, 64), (2, 64), (3, None), (4, 0)], KINDS)
    out = fill_containers(df, kinds).collect()
    load = verify(out, sized, {1: 100, 2: 64})
    for k, cap in ((1, 100), (2, 64)):
        used = [n for (kind, _), n in load.items() if kind == k]
        assert len(used) <= best_fit_decreasing(sized, cap) + 2


def test_nulls_and_empty_tables(spark):
    empty, kinds = spark.createDataFrame([], SIZED), spark.createDataFrame([(1, 10)], KINDS)
    assert fill_containers(empty, kinds).count() == 0
    one = spark.createDataFrame([(1, None, None, None), (2, -3, None, None)], SIZED)
    assert sorted((r["doc_id"], r["tokens"]) for r in fill_containers(one, kinds).collect()) == [(1, 0), (2, 0)]
    assert fill_containers(one, spark.createDataFrame([], KINDS)).count() == 0
