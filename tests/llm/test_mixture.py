import random

import pytest
from pyspark.sql import functions as F

from codeskein.llm import mixture
from codeskein.llm.mixture import mix_sources, sized_records
from codeskein.llm.tokens import token_count

RECORDS, TARGETS = "doc_id long, source string, tokens long, key double", "source string, target_share double, max_repeats int"


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("日本語 text 😀",)], "text string")
    got = [r[0] for r in df.select(token_count(F.col("text"))).collect()]
    assert got[:3] == [2, 0, None] and got[3] > 3


@pytest.mark.parametrize("range_rows", [20_000, 7])
def test_shares_and_caps(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixture, "RANGE_ROWS", range_rows)
    rng = random.Random(1)
    rows = [(i, "big", rng.randint(1, 20), 0.0) for i in range(400)] + [(i, "small", rng.randint(1, 20), 0.0) for i in range(400, 430)] + [(1, "big", 3, 0.0), (None, "big", 5, 0.0), (9000, "other", 50, 0.0), (9001, "big", 0, 0.0), (9002, "big", None, 0.0)]
    targets = spark.createDataFrame([("big", 0.5, 1), (" Small", 0.5, 3), ("none", 0.2, 2), (None, 0.1, 1), ("zero", None, None)], TARGETS)
    mixed, report = mix_sources(spark.createDataFrame(rows, RECORDS), targets)
    mixed, report = mixed.collect(), {r["source"]: r for r in report.collect()}
    small = sum(t for _, s, t, _ in rows if s == "small")
    assert report["small"]["actual_tokens"] == 3 * small == report["small"]["budget"]
    assert abs(report["big"]["actual_tokens"] - 3 * small) <= 10
    assert report["none"]["actual_tokens"] == 0 and report["zero"]["target_share"] == 0
    assert abs(report["big"]["actual_share"] - 0.5) < 0.02
    assert max(r["copies"] for r in mixed if r["source"] == "small") == 3 and max(r["copies"] for r in mixed if r["source"] == "big") == 1
    positions = sorted((r["position"], r["tokens"]) for r in mixed if r["source"] == "big")
    for (a, n), (b, _) in zip(positions, positions[1:]):
        assert a + n == b


def test_rounds_repeat_a_source(spark):
    rows = spark.createDataFrame([(i, "a", 10, 0.0) for i in range(10)], RECORDS)
    mixed, report = mix_sources(rows, spark.createDataFrame([("a", 1.0, 5)], TARGETS), total_tokens=250)
    copies = sorted(r["copies"] for r in mixed.collect())
    assert copies == [2] * 5 + [3] * 5 and report.first()["actual_tokens"] == 250
    mixed, report = mix_sources(rows, spark.createDataFrame([("a", 1.0, 2)], TARGETS), total_tokens=9999)
    assert report.first()["actual_tokens"] == 200


def test_empty_tables(spark):
    mixed, report = mix_sources(spark.createDataFrame([], RECORDS), spark.createDataFrame([("a", 1.0, 5)], TARGETS))
    assert mixed.count() == 0 and report.first()["actual_tokens"] == 0
    docs = spark.createDataFrame([(1, None, None), (2, " Repo ", "x")], "doc_id long, source string, text string")
    assert [(r["source"], r["tokens"]) for r in sized_records(docs).orderBy("doc_id").collect()] == [("", 0), ("repo", 1)]
