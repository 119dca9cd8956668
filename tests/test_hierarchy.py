import time

from codeskein.operators.hierarchy import implementation_links, override_links
from codeskein.operators.navigation import innermost_spans, open_before

SYMBOL = "seq long, id string, container_id string, name string, kind string, accessibility string, modifiers array<string>, parameters array<struct<name:string,type:string,modifier:string,default_value:string>>"


def symbols(spark, members):
    """Types 1 to 5 named T1.. and members (seq, type, name, parameter types, modifiers, accessibility)."""
    types = [(t, f"T{t}", None, f"T{t}", "Class" if t < 5 else "Interface", "public", [], None) for t in range(1, 6)]
    rows = [(s, f"T{t}.{n}#{s}", f"T{t}", n, k, a, m, None if p is None else [(f"p{i}", x, None, None) for i, x in enumerate(p)]) for s, t, n, p, m, a, k in members]
    return spark.createDataFrame(types + rows, SYMBOL)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_overrides_go_to_the_nearest_open_member_with_the_same_parameters(spark):
    s = symbols(spark, [
        (10, 1, "Run", ["int"], ["override"], "Public", "Method"),
        (11, 1, "Run", ["string"], ["override"], "Public", "Method"),
        (12, 1, "Stop", None, None, "Public", "Method"),
        (13, 1, "Make", [], ["static"], "Public", "Method"),
        (20, 2, "Run", ["int"], [], "Public", "Method"),
        (30, 3, "Run", ["int"], ["virtual"], "Public", "Method"),
        (31, 3, "Stop", [], ["abstract"], "Public", "Method"),
        (32, 3, "Make", [], ["virtual"], "Public", "Method"),
        (40, 4, "Run", ["int"], ["virtual"], "Public", "Method"),
        (41, 4, "Run", ["string"], ["virtual"], "Public", "Property"),
    ])
    got = {(r["member_id"], r["base_member_id"], r["depth"]) for r in override_links(s, links(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (1, 1)])).collect()}
    assert ("T1.Run#10", "T3.Run#30", 2) in got and ("T1.Stop#12", "T3.Stop#31", 2) in got
    assert ("T3.Run#30", "T4.Run#40", 1) in got
    assert not [g for g in got if g[0] in ("T1.Run#11", "T1.Make#13")]
    assert override_links(s, links(spark, [])).count() == 0


def test_interface_members_are_met_by_the_type_or_its_nearest_base(spark):
    s = symbols(spark, [
        (50, 5, "Open", ["int"], [], "Public", "Method"), (51, 5, "Close", [], [], "Public", "Method"), (52, 5, "Peek", [], [], "Public", "Method"),
        (10, 1, "Open", ["int"], [], "public", "Method"), (11, 1, "Close", [], [], "private", "Method"),
        (20, 2, "Open", ["int"], [], "Public", "Method"), (21, 2, "Close", [], [], "Public", "Method"), (22, 2, "Peek", ["int"], [], "Public", "Method"),
    ])
    got = {(r["type"], r["interface_member_id"], r["member_id"]) for r in implementation_links(s, links(spark, [(1, 2)]), links(spark, [(1, 5), (1, 5)])).collect()}
    assert got == {(1, "T5.Open#50", "T1.Open#10"), (1, "T5.Close#51", "T2.Close#21")}


def test_spans_are_swept_as_by_comparing_all(spark):
    spans = [("f", n, s, e) for n, (s, e) in enumerate([(1, 20000), (5, 9), (5, 12), (7, 8), (30, 30), (4095, 4098), (4096, 4097), (9000, 9001)])] + [(None, 99, 1, 5)]
    points = [("f", x) for x in (0, 1, 5, 7, 8, 9, 11, 12, 4095, 4096, 4097, 9000, 9001, 19999, 20000)] + [("g", 3), ("f", None), ("f", 7)]
    got = {(r["file"], r["line"]): r["node"] for r in innermost_spans(spark.createDataFrame(points, "file string, line long"), spark.createDataFrame(spans, "file string, node long, start long, end long")).collect()}
    expected = {}
    for f, x in points:
        inside = [(s, -n) for g, n, s, e in spans if g == f and x is not None and s <= x < e]
        if inside:
            expected[f, x] = -max(inside)[1]
    assert got == expected


def test_one_file_of_very_many_spans(spark):
    n = 200_000
    spans = spark.range(n).selectExpr("'f' AS file", "id AS node", "id * 2 AS start", "id * 2 + 2 + (id % 7) AS end")
    points = spark.range(2 * n).selectExpr("'f' AS file", "id AS line")
    began = time.perf_counter()
    assert innermost_spans(points, spans).count() == 2 * n
    depths = {r["depth"]: r["count"] for r in open_before(spans).groupBy("depth").count().collect()}
    assert sum(depths.values()) == n and max(depths) <= 4
    assert time.perf_counter() - began < 60
