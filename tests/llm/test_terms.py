import math

from codeskein.llm.terms import SLOPE, term_weights

HITS = "hit_id long, terms array<string>, term string, weight double"


def brute(rows, window):
    words, near = {}, {}
    for hit, terms in rows:
        if hit is None:
            continue
        clean = [t.strip().lower() for t in terms or [] if t is not None and t.strip()]
        words.setdefault(hit, set()).update(clean)
        for i, t in enumerate(clean):
            near.setdefault((hit, t), set()).update(x for x in clean[max(0, i - window + 1) : i + window] if x != t)
    lengths = {h: len(w) for h, w in words.items() if w}
    mean = sum(lengths.values()) / len(lengths) if lengths else 1
    out = {}
    for (h, t), n in near.items():
        holders = sum(t in w for w in words.values())
        rarity = math.log((len(words) + 1) / holders) if holders > 1 else 0.0
        out[h, t] = (len(n), holders, (1 + len(n)) / (1 - SLOPE + SLOPE * lengths[h] / mean) * rarity)
    return out


def test_weights_against_brute_force(spark):
    rows = [(1, ["A", " b", "c ", "a", "", None]), (1, ["A", " b", "c ", "a", "", None]), (1, ["z"]), (2, ["b", "c"]), (3, None), (4, []), (None, ["b"]), (5, ["Ärger", "b", "d", "e", "f", "b", "g"]), (6, ["solo"])]
    got = {(r["hit_id"], r["term"]): r for r in term_weights(spark.createDataFrame([(h, t, "x", 1.0) for h, t in rows], HITS)).collect()}
    expected = brute(rows, 3)
    assert set(got) == set(expected)
    for k, (degree, holders, weight) in expected.items():
        assert (got[k]["degree"], got[k]["holders"]) == (degree, holders)
        assert math.isclose(got[k]["weight"], weight, abs_tol=1e-9)


def test_nothing_gives_nothing(spark):
    assert term_weights(spark.createDataFrame([], HITS)).count() == 0


def test_a_record_with_most_rows(spark):
    rows = [(1, [f"t{i % 7}", f"u{i % 5}", "common"]) for i in range(300)] + [(i, [f"t{i % 7}", "x"]) for i in range(2, 40)]
    got = {(r["hit_id"], r["term"]): r for r in term_weights(spark.createDataFrame([(h, t, "x", 1.0) for h, t in rows], HITS)).collect()}
    expected = brute(rows, 3)
    assert {k: (r["degree"], r["holders"]) for k, r in got.items()} == {k: v[:2] for k, v in expected.items()}
    assert all(math.isclose(got[k]["weight"], v[2], abs_tol=1e-9) for k, v in expected.items())
