"""Ranked search over symbols: weighted postings, prefix completion and BM25."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.functions.text import STOP_WORDS, is_test, terms, words
from codeskein.operators.skew import heavy_keys, skew_join
from codeskein.relations import Relations, is_type
from codeskein.session import materialize, shuffle_width

K1, B = 1.2, 0.75
COMPLETIONS, COMPLETION_FACTOR, LEAST_PREFIX = 30, 0.4, 3
TEST_WEIGHT, NAME_BOOST, RANK_BOOST = 0.8, 2.0, 0.5
#: Weight of a term by the field it stands in; the body is indexed for members, the members' names for types.
FIELD_WEIGHTS = {"name": 6.0, "container": 2.0, "namespace": 1.0, "signature": 1.0, "documentation": 2.0, "file": 1.0}
BODY_WEIGHT, MEMBER_WEIGHT = 1.0, 0.5
#: Scores are rounded to three places, so nodes this close to a limit may still change places.
ROUNDING = 0.002
#: Parts of symbols ranked by one task at most (about), and those that are worth a task; sets of words that meet them at once.
SHARD_ROWS, LEAST_SHARD_ROWS, CHUNK_SETS = 2_000_000, 50_000, 1_000_000
KINDS = [("set", pa.int64()), ("node", pa.int64()), ("score", pa.float64()), ("matched", pa.list_(pa.string()))]


def bodies(rel: Relations) -> DataFrame:
    """node, body: the code that was served last for a member."""
    items = rel.table("context_items").where("node IS NOT NULL AND code IS NOT NULL")
    newest = items.groupBy("node").agg(F.max_by("code", F.struct("served_at", "item_id")).alias("body"))
    return rel.symbols.where(~is_type(F.col("kind"))).select(F.col("seq").alias("node")).join(newest, "node")


def held_words(rel: Relations) -> DataFrame:
    """node, word, weight: the words of a symbol's fields as they are written, with the weights of all their places added up."""
    owner = rel.symbols.select(F.col("id").alias("container_id"), F.col("name").alias("container"))
    stem_of_file = F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)*$", 1)
    rows = rel.symbols.join(owner, "container_id", "left").withColumn("file", stem_of_file).withColumn("documentation", F.coalesce("summary", "documentation"))
    fields = F.array(*[F.struct(words(F.col(f)).alias("words"), F.lit(w).alias("weight")) for f, w in FIELD_WEIGHTS.items()])
    own = rows.select(F.col("seq").alias("node"), F.explode(fields).alias("f")).select("node", F.explode("f.words").alias("word"), "f.weight")
    body = bodies(rel).select("node", F.explode(words(F.col("body"))).alias("word"), F.lit(BODY_WEIGHT).alias("weight"))
    types = rel.symbols.where(is_type(F.col("kind"))).select(F.col("id").alias("container_id"), F.col("seq").alias("node"))
    members = rel.symbols.join(types, "container_id").select("node", F.explode(words(F.col("name"))).alias("word"), F.lit(MEMBER_WEIGHT).alias("weight"))
    # a stop word in small letters has no parts, so nothing of it is indexed
    return own.unionByName(body).unionByName(members).where(~F.col("word").isin(*STOP_WORDS)).groupBy("node", "word").agg(F.sum("weight").alias("weight"))


def word_terms(held: DataFrame) -> DataFrame:
    """word, term, times: the terms of every distinct word, worked out once for all symbols that hold it."""
    distinct = held.select("word").distinct().repartition(shuffle_width(held.sparkSession))
    return distinct.select("word", F.explode(terms(F.col("word"))).alias("term")).groupBy("word", "term").agg(F.count(F.lit(1)).alias("times"))


def postings(rel: Relations) -> DataFrame:
    """node, term, frequency: term occurrences weighted by field."""
    held = materialize(held_words(rel))
    return held.join(word_terms(held), "word").groupBy("node", "term").agg(F.sum(F.col("weight") * F.col("times")).alias("frequency"))


def lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("node").agg(F.sum("frequency").alias("length"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query, term: stemmed distinct terms, and the joined lower-case words of a query of several."""
    found = F.array_distinct(terms(F.col("query")))
    many = F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda x: x != "")) > 1
    joined = F.lower(F.regexp_replace("query", r"[^\p{L}\p{Nd}]", ""))
    every = F.when(many, F.array_distinct(F.concat(found, F.array(joined)))).otherwise(found)
    return queries.select("query").distinct().select("query", F.explode(every).alias("term"))


def completions(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query, asked, term, factor: each asked term and the next thirty terms it is a prefix of.

    Terms of one prefix stand behind it without a gap, so they are looked for among the next thirty only, in the order
    of the terms of the same first LEAST_PREFIX letters.
    """
    exact = asked.join(vocabulary.select("term"), "term", "left_semi").select("query", F.col("term").alias("asked"), "term", F.lit(1.0).alias("factor"))
    wanted = asked.where(F.length("term") >= LEAST_PREFIX).select("term", F.lit(False).alias("held"), F.lit(True).alias("wanted"))
    every = wanted.unionByName(vocabulary.select("term", F.lit(True).alias("held"), F.lit(False).alias("wanted"))).groupBy("term").agg(F.max("held").alias("held"), F.max("wanted").alias("wanted"))
    head = Window.partitionBy(F.substring("term", 1, LEAST_PREFIX))
    every = every.withColumn("n", F.count(F.when(F.col("held"), 1)).over(head.orderBy("term").rowsBetween(Window.unboundedPreceding, 0)))
    following = F.collect_list(F.when(F.col("held"), F.col("term"))).over(head.orderBy("n").rangeBetween(1, COMPLETIONS))
    longer = every.withColumn("following", following).where("wanted").select(F.col("term").alias("asked"), F.explode("following").alias("term"))
    longer = longer.where(F.col("term").startswith(F.col("asked")))
    more = asked.withColumnRenamed("term", "asked").join(longer, "asked").select("query", "asked", "term", F.lit(COMPLETION_FACTOR).alias("factor"))
    return exact.unionByName(more)


def _squeezed(query: str | Column) -> Column:
    return F.lower(F.regexp_replace(query, r"\s+", ""))


def word_parts(rel: Relations, words: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """asked, node, part: what each asked word (term) adds to the score of each symbol that holds it or a completion."""
    known = materialize(words.select(F.col("term").alias("asked")).distinct().withColumn("word", F.monotonically_increasing_id()))
    return _parts(rel, known, percentiles).join(known, "word").select("asked", "node", "part")


def _parts(rel: Relations, known: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """word, node, part: those parts by the number of the asked word. known: asked, word.

    It doesn't depend on the query, so it is worked out once for all; the symbol's own weight, lower in tests and raised
    by the percentile (node, percentile), is in it. Of all terms only those that are asked for are told by symbol; the
    others count in its length, which is the row without a term. A term that many words complete to, or many symbols
    hold, is joined as a heavy key.
    """
    held = materialize(held_words(rel))
    told = materialize(word_terms(held))
    spelled = completions(known.select(F.col("asked").alias("query"), F.col("asked").alias("term")), told.select("term").distinct())
    spelled = materialize(spelled.join(known, "asked").select("word", "term", "factor"))
    wanted = told.join(spelled.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left")
    each = F.collect_list(F.when(F.col("wanted"), F.struct("term", "times")))
    counted = wanted.groupBy("word").agg(F.concat(each, F.array(F.struct(F.lit(None).cast("string").alias("term"), F.sum("times").alias("times")))).alias("terms"))
    index = held.join(counted, "word").select("node", "weight", F.explode("terms").alias("t"))
    index = materialize(index.groupBy("node", F.col("t.term").alias("term")).agg(F.sum(F.col("weight") * F.col("t.times")).alias("frequency")))
    length = index.where("term IS NULL").select("node", F.col("frequency").alias("length"))
    index = index.where("term IS NOT NULL")
    n, mean = length.agg(F.count(F.lit(1)), F.greatest(F.lit(1.0), F.avg("length"))).first()
    idf = F.log(1 + (F.lit(float(n)) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    spelled = materialize(spelled.join(document_frequencies(index), "term").select("word", "term", "factor", idf.alias("idf")))
    node_weight = F.when(is_test(F.col("file")), TEST_WEIGHT).otherwise(1.0)
    nodes = rel.symbols.select(F.col("seq").alias("node"), "file").join(length, "node")
    if percentiles is not None:
        nodes = nodes.join(percentiles, "node", "left")
        node_weight = node_weight * (1 + RANK_BOOST * F.coalesce("percentile", F.lit(0.0)))
    nodes = materialize(nodes.select("node", "length", node_weight.alias("node_weight")))
    tf = F.col("frequency") * (K1 + 1) / (F.col("frequency") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0))))
    heavy = heavy_keys(index, "term")
    met = skew_join(index.join(nodes, "node").select("node", "term", tf.alias("tf"), "node_weight"), spelled, "term", "inner", heavy)
    return met.groupBy("word", "node").agg((F.max(F.col("factor") * F.col("idf") * F.col("tf")) * F.first("node_weight")).alias("part"))


def _scored(rel: Relations, parts: DataFrame) -> DataFrame:
    """parts: query, node, asked, part. Gives query, node, id, matched (asked words met, sorted), score, and name."""
    scores = parts.groupBy("query", "node").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("asked")).alias("matched"))
    return scores.join(rel.symbols.select(F.col("seq").alias("node"), "id", "name"), "node")


def _boosted(scores: DataFrame) -> DataFrame:
    boost = F.when(F.lower("name") == _squeezed("query"), NAME_BOOST).otherwise(1.0)
    return scores.select("query", "node", "id", "matched", F.bround(F.col("score") * boost, 3).alias("score"))


def bm25(rel: Relations, queries: DataFrame, percentiles: DataFrame | None = None) -> DataFrame:
    """query, node, id, matched, score of every symbol that holds a word of a query: meant for few queries."""
    asked = materialize(query_terms(queries)).withColumnRenamed("term", "asked")
    parts = word_parts(rel, asked.select(F.col("asked").alias("term")), percentiles)
    return _boosted(_scored(rel, asked.join(parts, "asked")))


def bm25_top(rel: Relations, queries: DataFrame, limit: int, percentiles: DataFrame | None = None) -> DataFrame:
    """query, node, id, matched, score, place: the ``limit`` best of every query, the same as ranking all.

    Queries that come down to the same held words are ranked once, by those words. Only the boost of a symbol of the
    queried name depends on the query itself: such symbols are scored besides, and as it only raises them, the best of a
    query are among them and the best of its words.

    queries: query, and node if right answers are known, a row for each. Then a query's hits are given down to its best
    right answer only, none if no right answer holds a word. Right answers are scored first; a set of words is ranked
    only if the best parts of its words add up to the score of one, and then with that score as the least.
    """
    right = queries.select("query", "node").distinct() if "node" in queries.columns else None
    asked = materialize(query_terms(queries).withColumnRenamed("term", "asked"))
    known = materialize(asked.select("asked").distinct().withColumn("word", F.monotonically_increasing_id()))
    parts = materialize(_parts(rel, known, percentiles))
    best = parts.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("part")))).where(F.col("n") <= limit)
    best = best.groupBy("word").agg(F.max(F.when(F.col("n") == limit, F.col("part"))).alias("reached"), F.max("part").alias("most"))
    held = skew_join(asked, materialize(known.join(best, "word")), "asked", "inner")
    of_query = held.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("asked", "word"))).alias("held"), F.coalesce(F.max("reached"), F.lit(0.0)).alias("reached"), F.sum("most").alias("most"))
    of_query = materialize(of_query.select("query", F.array_join("held.asked", " ").alias("words"), F.col("held.word").alias("numbers"), "reached", "most"))
    symbols = rel.symbols.select(F.col("seq").alias("node"), "id", "name")
    alone = _scored_alone(symbols, of_query, parts, right)
    if right is not None:
        alone = materialize(alone)
        least = alone.where("right").withColumn("score", _boosted_score(F.col("named"), F.col("score"))).groupBy("query").agg(F.min(_place()).alias("least"))
        of_query = materialize(of_query.join(least, "query").withColumn("reached", F.greatest("reached", -F.col("least.down"))))
    sets = of_query.where(F.col("most") >= F.col("reached") - ROUNDING).groupBy("words").agg(F.first("numbers").alias("numbers"), F.min("reached").alias("reached"))
    sets = materialize(sets.withColumn("set", F.monotonically_increasing_id()))
    by_set = materialize(skew_join(of_query.select("query", "words"), sets.select("words", "set"), "words", "inner").select("query", "set"))
    if right is not None:
        parts = materialize(parts.join(sets.select(F.explode("numbers").alias("word")).distinct(), "word", "left_semi"))
    order = Window.partitionBy("set").orderBy(F.desc("rounded"), "id")
    common = _best_of_sets(sets, parts, limit).withColumn("rounded", F.bround("score", 3)).join(symbols.select("node", "id"), "node")
    common = materialize(common.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("set", "node", "id", "matched", "score"))
    found = skew_join(by_set, common, "set", "inner").select("query", "node", F.struct(F.lit(False).alias("named"), "score", "id", "matched").alias("hit"))
    named = alone.select("query", "node", F.struct("named", "score", "id", "matched").alias("hit"))
    # one shuffle by query serves the choice between both and the ranking
    either = found.unionByName(named).repartition("query").groupBy("query", "node").agg(F.max("hit").alias("hit"))
    either = either.select("query", "node", "hit.id", "hit.matched", _boosted_score(F.col("hit.named"), F.col("hit.score")).alias("score"))
    if right is not None:
        either = either.join(of_query.select("query", "least"), "query").where(_place() <= F.col("least")).drop("least")
    return top_hits(either, limit)


def _scored_alone(symbols: DataFrame, of_query: DataFrame, parts: DataFrame, right: DataFrame | None) -> DataFrame:
    """query, node, id, matched, score, named, right: the symbols of a query's name, and its right answers (query, node) if given."""
    words_of = of_query.select("query", "words", "numbers", _squeezed("query").alias("squeezed"))
    alone = skew_join(words_of, symbols.select(F.lower("name").alias("squeezed"), "node"), "squeezed", "inner")
    alone = alone.select("query", "node", "words", "numbers", F.lit(True).alias("named"), F.lit(False).alias("right"))
    if right is not None:
        answers = right.join(words_of, "query").select("query", "node", "words", "numbers", F.lit(False).alias("named"), F.lit(True).alias("right"))
        once = [F.first("words").alias("words"), F.first("numbers").alias("numbers"), F.max("named").alias("named"), F.max("right").alias("right")]
        alone = alone.unionByName(answers).groupBy("query", "node").agg(*once)
    each = F.explode(F.arrays_zip(F.split("words", " ").alias("asked"), F.col("numbers").alias("word")))
    alone = alone.select("query", "node", "named", "right", each.alias("w")).select("query", "node", "named", "right", "w.asked", "w.word")
    scores = alone.join(parts, ["word", "node"]).groupBy("query", "node", "named", "right").agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("asked")).alias("matched"))
    return scores.join(symbols.select("node", "id"), "node")


def _boosted_score(named: Column, score: Column) -> Column:
    return F.bround(score * F.when(named, NAME_BOOST).otherwise(1.0), 3)


def _place() -> Column:
    """What hits of a query are ranked by, least first."""
    return F.struct((-F.col("score")).alias("down"), F.col("id"))


def _best_of_sets(sets: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """set, node, score, matched: the ``limit`` best symbols of every set of asked words, and some behind them.

    sets: set, words (joined by spaces), numbers (of the words, in their order), reached: a score that ``limit`` symbols
    reach, 0 if unknown. The symbols are dealt to shards; each ranks its own for all sets. Parts in a shard and sets
    that meet it at once are bounded, so that a task's memory is; what is left out lies below ``reached`` or below
    ``limit`` symbols of the shard by more than rounding can change.
    """
    rows, asked = parts.count(), sets.count()
    shards = max(math.ceil(rows / SHARD_ROWS), min(parts.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / LEAST_SHARD_ROWS)), 1)
    chunks = max(1, math.ceil(asked / CHUNK_SETS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).withColumn("chunk", each(chunks))
    given = sets.withColumn("chunk", F.pmod(F.xxhash64("set"), F.lit(chunks)).cast("int")).withColumn("shard", each(shards))
    kinds = "set long, node long, score double, matched array<string>"
    return dealt.groupBy("shard", "chunk").cogroup(given.groupBy("shard", "chunk")).applyInArrow(_best_of_shard(limit), kinds)


def _needed(lists: list[np.ndarray], most: list[float], floor: float) -> list[np.ndarray]:
    """The lists of which a symbol must be in one to reach ``floor``: long ones are left out as far as their best parts don't add up to it."""
    needed, without = [], 0.0
    for k in sorted(range(len(lists)), key=lambda k: -len(lists[k])):
        if without + most[k] < floor:
            without += most[k]
        else:
            needed.append(lists[k])
    return needed


def _best_of_shard(limit: int):
    def run(parts: pa.Table, sets: pa.Table) -> pa.Table:
        word, node, part = (parts[c].to_numpy() for c in ("word", "node", "part"))
        nodes, place = np.unique(node, return_inverse=True)
        order = np.lexsort((place, word))
        place, part = place[order], part[order]
        held, first = np.unique(word[order], return_index=True)
        ends = np.append(first[1:], len(order))
        numbers = sets["numbers"].combine_chunks()
        bounds = np.append(0, np.cumsum(pc.list_value_length(numbers).to_numpy())) if len(numbers) else np.zeros(1, int)
        wanted = numbers.flatten().to_numpy()
        at = np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))
        present = held[at] == wanted if len(held) else np.zeros(len(wanted), bool)
        low, high = (x[at] if len(held) else at for x in (first, ends))
        most = np.where(present, np.maximum.reduceat(part, first)[at], 0.0) if len(held) else np.zeros(len(wanted))
        least, up_to = sets["reached"].to_numpy() - ROUNDING, np.append(0.0, np.cumsum(most))
        met_sets = np.flatnonzero(up_to[bounds[1:]] - up_to[bounds[:-1]] >= least).tolist()
        low, high, most, present, bounds, least = low.tolist(), high.tolist(), most.tolist(), present.tolist(), bounds.tolist(), least.tolist()
        total = np.zeros(len(nodes))
        found: list[tuple] = []  # index of the set, places, scores
        met: list[tuple] = []  # matched words: how many for each place, and their indices
        for k in met_sets:
            floor = least[k]
            mine = [j for j in range(bounds[k], bounds[k + 1]) if present[j]]
            lists = [place[low[j] : high[j]] for j in mine]
            if len(mine) == 1:
                score = part[low[mine[0]] : high[mine[0]]]
                of = np.flatnonzero(score >= floor)
                of, score = lists[0][of], score[of]
            elif mine and 4 * sum(map(len, needed := _needed(lists, [most[j] for j in mine], floor))) < sum(map(len, lists)):
                of = np.unique(np.concatenate(needed)) if needed else np.zeros(0, int)
                score = np.zeros(len(of))
                for j, x in zip(mine, lists):
                    near = np.minimum(np.searchsorted(x, of), len(x) - 1)
                    score += np.where(x[near] == of, part[low[j] + near], 0.0)
                of, score = of[score >= floor], score[score >= floor]
            elif mine:
                for j, x in zip(mine, lists):
                    total[x] += part[low[j] : high[j]]
                of = np.concatenate([x[total[x] >= floor] for x in lists])
                of = np.unique(of) if len(of) else of
                score = total[of]
                for x in lists:
                    total[x] = 0.0
            if not mine or not len(of):
                continue
            if len(of) > limit:
                near = score >= np.partition(score, -limit)[-limit] - ROUNDING
                of, score = of[near], score[near]
            if len(mine) == 1:
                has, which = np.ones(len(of), int), np.full(len(of), mine[0])
            else:
                hit = np.array([x[np.minimum(np.searchsorted(x, of), len(x) - 1)] == of for x in lists]).T
                has, which = hit.sum(1), np.array(mine)[np.nonzero(hit)[1]]
            found.append((k, of, score))
            met.append((has, which))
        if not found:
            return pa.schema(KINDS).empty_table()
        several = np.repeat([k for k, _, _ in found], [len(x) for _, x, _ in found])
        texts = pc.split_pattern(sets["words"].combine_chunks(), " ").flatten()
        offsets = np.append(0, np.cumsum(np.concatenate([h for h, _ in met]))).astype(np.int32)
        matched = pa.ListArray.from_arrays(pa.array(offsets), texts.take(pa.array(np.concatenate([w for _, w in met]))))
        columns = [pa.array(sets["set"].to_numpy()[several]), pa.array(nodes[np.concatenate([x for _, x, _ in found])]), pa.array(np.concatenate([x for _, _, x in found])), matched]
        return pa.table(columns, schema=pa.schema(KINDS))

    return run


def top_hits(scores: DataFrame, limit: int = 20) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def reciprocal_ranks(rel: Relations, questions: DataFrame, percentiles: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """How right answers fare in this ranking, followed down to the best of them: questions, mean reciprocal rank of the best right answer within ``limit``,
    and the share of questions with one among the first five. questions: query, node, a row per right answer."""
    right = questions.select("query", "node").distinct()
    ranked = bm25_top(rel, right, limit, percentiles).select("query", "node", "place")
    best = right.join(ranked, ["query", "node"], "left").groupBy("query").agg(F.min("place").alias("place"))
    return best.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("place") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_at_5"))
