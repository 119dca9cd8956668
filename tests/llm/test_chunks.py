import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeskein.llm.chunks import _pieces, cut_points, reach, split_oversized, successor_tables

ITEMS = "item_id long, code string, code_line int, token_budget int, served_at timestamp, piece string, text string"


def greedy(at, end, following):
    """The same cutting, one piece after another."""
    out, k = [], 0
    while True:
        out.append((int(at[k]), int(at[end[k]])))
        if end[k] == len(at) - 1:
            return out
        k = int(following[k])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", "\n", "\r\n", "  x", "{\n", "}\n", "é", "😀", "word" * 9, "\n\n", "\r"]), min_size=1, max_size=120), st.sampled_from([4, 8, 12, 40, 100]))
def test_pointer_doubling_equals_greedy_cutting(parts, limit):
    text, overlap = "".join(parts), limit // 10
    at, kind = cut_points(text, limit)
    end, following = successor_tables(at, kind, limit, overlap)
    expected = greedy(at, end, following)
    out = _pieces(pd.DataFrame([(1, text, limit, overlap, 5)], columns=["item_id", "text", "limit_chars", "overlap_chars", "first_line"]))
    assert [(r.start, r.start + r.n_chars) for r in out.itertuples()] == expected
    done = 0
    for r in out.itertuples():
        assert r.n_chars <= limit and text[r.start : r.start + r.n_chars] == r.code
        assert r.start <= done <= r.start + r.n_chars and done - r.start == r.overlap_before <= overlap
        assert r.code_line == 5 + len(re.findall(r"\r\n|\n|\r", text[: r.start]))
        done = r.start + r.n_chars
    assert done == len(text)


def test_reach_follows_all_paths():
    import numpy as np

    assert reach(np.array([1, 3, 2, 4, 4, 4]), np.array([0])).tolist() == [0, 1, 3, 4]


def test_rows_of_all_kinds(spark):
    long = "\n".join(f"line {i}" for i in range(40))
    rows = [(1, long, 7, 10, None, "x", "y"), (1, long, 7, 10, None, "x", "y"), (2, "short", 1, 10, None, None, None), (3, None, 1, 1, None, None, None), (4, "", None, None, None, None, None), (None, long, 1, 1, None, None, None), (5, "x" * 17000, None, None, None, None, None), (6, "abcdef", 1, 0, None, None, None)]
    got = split_oversized(spark.createDataFrame(rows, ITEMS)).collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == {1, 5, 6}
    assert sorted(r["piece"] for r in by[1]) == list(range(len(by[1]))) and max(r["n_chars"] for r in by[1]) <= 40
    assert all(r["code_line"] is None for r in by[5]) and max(r["n_chars"] for r in by[5]) <= 16000
    assert max(r["n_chars"] for r in by[6]) <= 4
    assert split_oversized(spark.createDataFrame([], ITEMS)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], ITEMS), overlap_share=0.5)


@pytest.mark.parametrize("limit,overlap", [(1000, 100), (1000, 20), (40, 2), (16000, 1600)])
@pytest.mark.parametrize("share", [0.03, 0.11, 0.125, 0.3])
def test_pieces_always_share_something(limit, overlap, share):
    line = ("word " * limit)[: max(1, int(limit * share)) - 2]
    for end in ("\n", "\r\n"):
        text = (line + end) * 60
        out = _pieces(pd.DataFrame([(1, text, limit, overlap, 5)], columns=["item_id", "text", "limit_chars", "overlap_chars", "first_line"]))
        assert len(out) > 1 and (out["overlap_before"][1:] > 0).all() and out["overlap_before"].max() <= overlap
        assert out["n_chars"].max() <= limit and out["start"].iloc[-1] + out["n_chars"].iloc[-1] == len(text)
