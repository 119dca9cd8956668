from codeskein.operators.fixpoints import dependency_levels, greatest_fixpoint, nearest_members


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_greatest_fixpoint(spark):
    nodes = frame(spark, [(n,) for n in "abcde"], "node string")
    needs = frame(spark, [("a", "b"), ("b", "a"), ("c", "x"), ("d", "c")], "node string, needed string")
    assert {r["node"] for r in greatest_fixpoint(nodes, needs).collect()} == {"a", "b", "e"}
    assert greatest_fixpoint(nodes.limit(0), needs).count() == 0


def test_levels_and_cycles(spark):
    nodes = frame(spark, [(n,) for n in "abcdef"], "node string")
    needs = frame(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "zz")], "node string, needed string")
    assert {r["node"]: r["level"] for r in dependency_levels(nodes, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0}


def test_nearer_members_hide_further_ones(spark):
    bases = frame(spark, [("D", "C"), ("C", "B"), ("C", "I")], "src string, dst string")
    members = frame(spark, [("B", "Run", "B.Run"), ("C", "Run", "C.Run"), ("B", "Old", "B.Old"), ("I", "Old", "I.Old"), ("Z", "Run", "Z.Run")], "type string, name string, member string")
    found = {(r["name"], r["member"]) for r in nearest_members(frame(spark, [("D",)], "node string"), bases, members).collect()}
    assert found == {("Run", "C.Run"), ("Old", "B.Old"), ("Old", "I.Old")}
