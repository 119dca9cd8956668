from compare import FOLDER

from codeskein.operators import search
from codeskein.operators.search import bm25, bm25_top, top_hits
from codeskein.plans.graph import rank_percentile
from codeskein.plans.search import known_items, search_quality
from codeskein.relations import Relations


def test_search_quality_ranks_by_centrality_too(spark, monkeypatch):
    """The ranking asked for has the percentile of every symbol."""
    given, plain = [], search.bm25_top

    def noted(rel, queries, limit, percentiles=None):
        given.append(percentiles)
        return plain(rel, queries, limit, percentiles)

    monkeypatch.setattr(search, "bm25_top", noted)
    rel = Relations(spark, FOLDER)
    quality = search_quality(rel).first()
    assert quality["questions"] > 0 and quality["hit_at_5"] >= 0.8
    assert given[0].orderBy("node").collect() == rank_percentile(rel).select("node", "percentile").orderBy("node").collect()


def test_pruned_ranking_is_that_of_all_symbols(spark):
    rel = Relations(spark, "/root/testdata/sf0.001")
    ranks = spark.createDataFrame([(1000 + i, (i * 37 % 160) / 160) for i in range(160)], "node long, percentile double")
    words = [r["name"] for r in rel.symbols.select("name").orderBy("seq").limit(40).collect()]
    rows = [(w,) for w in words] + [(f"{a} {b}",) for a, b in zip(words, words[7:])] + [("get the loader of needle",), ("zzz",), ("",), (None,)]
    queries = spark.createDataFrame(rows, "query string").where("query IS NOT NULL")
    for limit in (1, 5):
        every = top_hits(bm25(rel, queries, ranks), limit)
        pruned = bm25_top(rel, queries, limit, ranks)
        columns = ("query", "node", "score", "place")
        assert sorted((*[r[c] for c in columns], *r["matched"]) for r in pruned.collect()) == sorted((*[r[c] for c in columns], *r["matched"]) for r in every.collect())


def test_ranking_by_shards_and_chunks_is_that_of_all_symbols(spark, monkeypatch):
    """However few symbols and sets of words meet in one task."""
    monkeypatch.setattr(search, "SHARD_ROWS", 400)
    monkeypatch.setattr(search, "CHUNK_SETS", 12)
    rel = Relations(spark, FOLDER)
    queries = rel.table("search_hits").where("query IS NOT NULL").select("query").distinct().orderBy("query").limit(60)
    every = top_hits(bm25(rel, queries), 3)
    sharded = bm25_top(rel, queries, 3)
    columns = ("query", "node", "score", "place")
    assert sorted((*[r[c] for c in columns], *r["matched"]) for r in sharded.collect()) == sorted((*[r[c] for c in columns], *r["matched"]) for r in every.collect())


def test_terms_are_worked_out_once_for_a_word(spark):
    rel = Relations(spark, FOLDER)
    held = search.held_words(rel)
    told = search.word_terms(held).groupBy("word").count()
    assert told.count() == told.select("word").distinct().count() <= held.select("word").distinct().count() < held.count() / 2


def test_a_shard_ranks_sets_of_words_with_its_own_symbols():
    """As search_quality needs it for all known items: best first kept, ties kept, words that are not in the shard left out."""
    import pyarrow as pa

    parts = pa.table({"word": [1, 1, 1, 2, 2], "node": [10, 11, 12, 11, 13], "part": [1.0, 2.0, 2.0, 1.5, 3.0]})
    sets = pa.table({"set": [7, 8, 9], "words": ["get load", "zip", "load zip"], "numbers": pa.array([[1, 2], [5], [2, 5]], pa.list_(pa.int64())), "reached": [0.0, 0.0, 2.0]})
    found = search._best_of_shard(2)(parts, sets).to_pylist()
    assert sorted((r["set"], r["node"], r["score"], r["matched"]) for r in found) == [(7, 11, 3.5, ["get", "load"]), (7, 13, 3.0, ["load"]), (9, 13, 3.0, ["load"])]


def test_known_items_are_followed_down_to_the_best_right_answer(spark, monkeypatch):
    """Places are those of ranking everything, whatever the right answers; for types asked for by name hardly any set of words is ranked."""
    ranked, plain = [], search._best_of_sets

    def noted(sets, parts, limit):
        ranked.append(sets.count())
        return plain(sets, parts, limit)

    monkeypatch.setattr(search, "_best_of_sets", noted)
    rel = Relations(spark, FOLDER)
    ranks = spark.createDataFrame([(1000 + i, (i * 37 % 160) / 160) for i in range(160)], "node long, percentile double")
    items = known_items(rel)
    nodes = [r["seq"] for r in rel.symbols.select("seq").orderBy("seq").collect()]
    asked = [r["query"] for r in items.select("query").distinct().orderBy("query").limit(40).collect()] + ["get the loader of needle", "zzz", "load", "the"]
    other = spark.createDataFrame([(q, nodes[(k * 53 + j * 7) % len(nodes)]) for k, q in enumerate(asked) for j in range(4)], "query string, node long")
    columns = ("query", "node", "score", "place")
    for right, limit in ((items, 20), (other, 20), (other, 3)):
        every = [(*[r[c] for c in columns], *r["matched"]) for r in top_hits(bm25(rel, right, ranks), 1000).collect()]
        answers = {(r["query"], r["node"]) for r in right.collect()}
        down_to = {}
        for query, node, _, place, *_ in every:
            if (query, node) in answers:
                down_to[query] = min(place, down_to.get(query, place))
        expected = sorted(r for r in every if r[3] <= min(limit, down_to.get(r[0], 0)))
        assert sorted((*[r[c] for c in columns], *r["matched"]) for r in bm25_top(rel, right, limit, ranks).collect()) == expected
        assert not down_to.keys() >= {"zzz", "the"} and (limit > 3 or max(down_to.values()) > limit)
    assert ranked[0] < items.select("query").distinct().count() / 4


def test_long_lists_that_cannot_reach_the_least_score_are_left_out():
    import numpy as np

    long, middle, short = np.arange(90), np.arange(20), np.arange(3)
    assert [len(x) for x in search._needed([short, long, middle], [4.0, 1.0, 2.0], 3.5)] == [3]
    assert [len(x) for x in search._needed([short, long, middle], [4.0, 1.0, 2.0], 2.5)] == [20, 3]
    assert [len(x) for x in search._needed([short, long, middle], [4.0, 1.0, 2.0], 0.0)] == [90, 20, 3]


def test_completions_are_the_next_thirty_terms_of_the_prefix(spark):
    """Whether the asked word is a term itself or not, and without comparing it to all terms that begin alike."""
    terms = sorted({f"con{a}{b}" for a in "aemnz" for b in ["", *"abcdefghijk"]} | {"con", "co", "cop", "dog", "dogé", "dogs"})
    asked = ["con", "cona", "conb", "conm", "conzk", "conzz", "co", "dog", "dogé", "do", "zip"]
    rows = spark.createDataFrame([(f"q{i % 4}", w) for i, w in enumerate(asked)] + [("q9", "con")], "query string, term string")
    found = search.completions(rows, spark.createDataFrame([(t,) for t in terms], "term string"))
    expected = []
    for query, word in [(f"q{i % 4}", w) for i, w in enumerate(asked)] + [("q9", "con")]:
        longer = [t for t in terms if t > word and t.startswith(word)][:30] if len(word) >= 3 else []
        expected += [(query, word, word, 1.0)] * (word in terms) + [(query, word, t, 0.4) for t in longer]
    assert sorted(tuple(r) for r in found.select("query", "asked", "term", "factor").collect()) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower().split("\n")
    assert not [x for x in plan if "join" in x and "startswith" in x]
