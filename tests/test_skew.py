import random
from collections import Counter

from pyspark.sql import functions as F

from codeskein.operators import skew
from codeskein.operators.skew import heavy_keys, skew_join, target_totals

EDGES = "edge_id long, from_node long, to_node long, edge_kind string, edge_count int, confidence tinyint, first_line int, recorded_at timestamp, edge_rows string"
TOTALS = "symbol_node long, total_call_sites int, distinct_callers int, reported_at timestamp"


def test_heavy_keys_misses_none(spark):
    rng = random.Random(5)
    keys = [1] * 400 + [2] * 100 + [None] * 300 + [rng.randrange(10, 5000) for _ in range(1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = heavy_keys(df, "k", 1 / 64)
    assert found.rows == 2000
    assert {1, 2} <= set(found.keys) and None not in found.keys
    assert len(found.keys) < 10
    assert heavy_keys(df.limit(0), "k").keys == ()


def test_skew_join_equals_join_by_broadcast_and_by_salt(spark, monkeypatch):
    rng = random.Random(1)
    fact = spark.createDataFrame([(i, rng.choice([7] * 6 + [None] + list(range(20)))) for i in range(600)], "i long, k long")
    side = spark.createDataFrame([(k, k * 10 + j) for k in (7, 3, 7, 99) for j in range(2)], "k long, v long")
    for how in ("inner", "left"):
        expected = sorted(map(tuple, fact.join(side, "k", how).collect()), key=str)
        assert sorted(map(tuple, skew_join(fact, side, "k", how).collect()), key=str) == expected
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
        assert sorted(map(tuple, skew_join(fact, side, "k", how).collect()), key=str) == expected
        monkeypatch.undo()


def test_target_totals_against_plain_python(spark):
    rng = random.Random(2)
    rows = []
    for e in range(500):
        row = (e, rng.choice([None, 1, 2, 3, 4]), rng.choice([50] * 5 + [0, None, *range(100, 140)]), rng.choice(["Calls", "Uses", None]), rng.choice([None, 0, 1, 5]), rng.choice([None, 0, 1, 2]), 1, None, "x")
        rows += [row] * rng.choice([1, 1, 1, 2])
    reported = [(50, 9, 1, None), (50, 9, 1, None), (100, 3, 1, None)]
    got, heavy = target_totals(spark.createDataFrame(rows, EDGES), spark.createDataFrame(reported, TOTALS))
    got = {r["to_node"]: r for r in got.collect()}
    assert heavy.rows == len(rows) and 50 in heavy.keys
    count, total, sites, callers = Counter(), Counter(), Counter(), {}
    for r in rows:
        count[r[2]] += 1
        total[r[2]] += r[4] or 0
        callers.setdefault(r[2], set()).add(r[1])
    for r in set(rows):
        if r[3] == "Calls" and r[5] != 2:
            sites[r[2]] += r[4] or 0
    assert set(got) == set(count)
    for k, r in got.items():
        assert (r["edge_rows"], r["sum_edge_count"], r["call_sites"], r["distinct_callers"]) == (count[k], total[k], sites[k], len(callers[k]))
        assert r["reported_call_sites"] == {50: 9, 100: 3}.get(k)


def test_target_totals_of_nothing(spark):
    got, heavy = target_totals(spark.createDataFrame([], EDGES), spark.createDataFrame([], TOTALS))
    assert got.count() == 0 and heavy.rows == 0


def test_null_aware_flag(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    assert [r[0] for r in df.select(heavy_keys(df, "k", 1 / 4).has(F.col("k"))).collect()] == [True, True]
