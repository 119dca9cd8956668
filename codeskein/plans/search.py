"""Queries of ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.functions.text import STOP_WORDS, parts, stem, terms, words
from codeskein.operators import search
from codeskein.plans.graph import RANK_SQL, rank_percentile
from codeskein.relations import SYM_SQL, TYPE_KINDS, Relations, is_type

_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_SPLIT = r"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'),
    '(\p{{Nd}})([^\p{{Nd}} ])', '\1 \2', 'g'), '([^\p{{Nd}} ])(\p{{Nd}})', '\1 \2', 'g'), ' '), lambda x: x <> '')"""


def _stem_sql(w: str) -> str:
    def trim(e: str) -> str:
        return f"(CASE WHEN {e} LIKE '%e' AND length({e}) > 3 THEN left({e}, length({e}) - 1) ELSE {e} END)"

    def cut(k: int) -> str:
        return f"left({w}, length({w}) - {k})"

    return f"""(CASE WHEN length({w}) <= 3 OR NOT regexp_matches({w}, '\\p{{L}}$') THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {cut(3)} || 'y' WHEN {w} LIKE '%sses' THEN {cut(2)}
        WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {trim(cut(3))} WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN {trim(cut(2))} WHEN regexp_matches({w}, '[sxzh]es$') AND length({w}) > 4 THEN {trim(cut(2))}
        WHEN regexp_matches({w}, '[^sui]s$') THEN {trim(cut(1))} ELSE {trim(w)} END)"""


def _terms_sql(source: str, key: str, text: str, extra: str = "") -> str:
    """Term rows of a text column: ``key``, term (and ``extra`` columns)."""
    more = f", {extra}" if extra else ""
    return f"""(WITH w AS (SELECT {key}{more}, unnest(regexp_extract_all(coalesce({text}, ''), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM {source}),
        n AS (SELECT row_number() OVER () AS r, * FROM w),
        p AS (SELECT r, {key}{more}, w, lower(unnest({_SPLIT.format('w')})) AS t FROM n),
        k AS (SELECT * FROM p WHERE length(t) <= 40 AND t NOT IN {_STOP} AND (length(t) > 1 OR regexp_matches(t, '^\\p{{Nd}}$')))
        SELECT {key}{more}, {_stem_sql('t')} AS term FROM k
        UNION ALL SELECT {key}{more}, lower(any_value(w)) FROM k GROUP BY r, {key}{more} HAVING count(*) > 1 AND length(any_value(w)) <= 40)"""


_INDEX_SQL = f"""{SYM_SQL}, rows AS (
      SELECT s.seq AS node, s.name, o.name AS container, s.namespace, s.signature, coalesce(s.summary, s.documentation) AS documentation, regexp_extract(s.file, '([^/\\\\]+?)(?:\\.[^./\\\\]*)*$', 1) AS file
      FROM sym s LEFT JOIN sym o ON o.id = s.container_id),
    fields AS (SELECT node, name AS text, 6.0 AS weight FROM rows UNION ALL SELECT node, container, 2.0 FROM rows UNION ALL SELECT node, namespace, 1.0 FROM rows
      UNION ALL SELECT node, signature, 1.0 FROM rows UNION ALL SELECT node, documentation, 2.0 FROM rows UNION ALL SELECT node, file, 1.0 FROM rows
      UNION ALL SELECT node, code, 1.0 FROM (SELECT * FROM context_items WHERE node IS NOT NULL AND code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY served_at DESC, item_id DESC) = 1) b JOIN sym ON seq = b.node WHERE kind NOT IN {TYPE_KINDS}
      UNION ALL SELECT o.seq, m.name, 0.5 FROM sym m JOIN sym o ON o.id = m.container_id WHERE o.kind IN {TYPE_KINDS}),
    idx AS (SELECT node, term, CAST(sum(weight) AS DOUBLE) AS frequency FROM {_terms_sql('fields', 'node', 'text', 'weight')} GROUP BY node, term),
    len AS (SELECT node, sum(frequency) AS length FROM idx GROUP BY node),
    df AS (SELECT term, count(*) AS holders FROM idx GROUP BY term)"""
_QUERY_SQL = f"""asked AS (
      SELECT DISTINCT query, term FROM {_terms_sql('(SELECT DISTINCT query FROM search_hits WHERE query IS NOT NULL)', 'query', 'query')}
      UNION SELECT DISTINCT query, lower(regexp_replace(query, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) FROM search_hits WHERE len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda x: x <> '')) > 1),
    longer AS (SELECT asked, term FROM (SELECT DISTINCT term AS asked FROM asked WHERE length(term) >= 3) q JOIN df ON df.term > asked AND starts_with(df.term, asked)
      QUALIFY row_number() OVER (PARTITION BY asked ORDER BY term) <= 30),
    complete AS (SELECT query, asked.term AS asked, asked.term, 1.0 AS factor FROM asked JOIN df USING (term) UNION ALL SELECT query, asked.term, longer.term, 0.4 FROM asked JOIN longer ON longer.asked = asked.term)"""
_SCORE_SQL = f"""{RANK_SQL},
    percentiles AS (SELECT node, round((row_number() OVER (ORDER BY rank, node) - 1) / (SELECT n - 1 FROM n), 6) AS percentile FROM ranked),
    {_INDEX_SQL.removeprefix(SYM_SQL + ", ")}, {_QUERY_SQL},
    parts AS (
      SELECT query, idx.node, asked, max(factor * ln(1 + ((SELECT count(*) FROM len) - holders + 0.5) / (holders + 0.5)) * frequency * 2.2
             / (frequency + 1.2 * (0.25 + 0.75 * length / (SELECT greatest(1.0, avg(length)) FROM len)))) AS part
      FROM complete JOIN df USING (term) JOIN idx USING (term) JOIN len ON len.node = idx.node GROUP BY ALL),
    scores AS (SELECT query, node, sum(part) AS score, array_to_string(list_sort(list(DISTINCT asked)), ' ') AS matched FROM parts GROUP BY ALL),
    boosted AS (SELECT query, node, id, matched, round_even(score * CASE WHEN regexp_matches(s.file, '(?i)(?:^|[\\\\/])[^\\\\/]*Tests?(?:[\\\\/.]|$)') THEN 0.8 ELSE 1.0 END * (1 + 0.5 * coalesce(percentile, 0))
      * CASE WHEN lower(s.name) = lower(regexp_replace(query, '\\s+', '', 'g')) THEN 2.0 ELSE 1.0 END, 3) AS score FROM scores JOIN sym s ON s.seq = node LEFT JOIN percentiles USING (node))"""


def queries_asked(rel: Relations) -> DataFrame:
    return rel.table("search_hits").where("query IS NOT NULL").select("query").distinct()


def tokenized(rel: Relations) -> DataFrame:
    return rel.symbols.select("seq", F.explode(terms(F.col("signature"))).alias("term")).groupBy("seq", "term").agg(F.count(F.lit(1)).alias("n"))


def stems(rel: Relations) -> DataFrame:
    words_of = rel.symbols.select(F.explode(words(F.col("summary"))).alias("w")).select(F.explode(parts(F.col("w"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words_of.select("word", stem(F.col("word")).alias("stem"))


def prefixes(rel: Relations) -> DataFrame:
    return search.completions(search.query_terms(queries_asked(rel)), search.document_frequencies(search.postings(rel))).groupBy("query").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("factor"), 6).alias("factors"))


def _percentiles(rel: Relations) -> DataFrame:
    return rank_percentile(rel).select("node", "percentile")


def top_five(rel: Relations) -> DataFrame:
    found = search.bm25_top(rel, queries_asked(rel), 5, _percentiles(rel))
    return found.select("query", "place", "score", F.array_join("matched", " ").alias("matched"))


def known_items(rel: Relations) -> DataFrame:
    """Every type is asked for by the words of its name; all types of that name are right answers."""
    named = rel.symbols.where(is_type(F.col("kind"))).select(F.array_join(parts(F.col("name")), " ").alias("query"), F.col("seq").alias("node"))
    return named.where("query <> ''")


def search_quality(rel: Relations) -> DataFrame:
    """The quality of the ranking with the boost by centrality, over all known items."""
    return search.reciprocal_ranks(rel, known_items(rel), _percentiles(rel))


_CALLS: dict[str, tuple] = {
    "tokenize": (tokenized, f"WITH {SYM_SQL} SELECT seq, term, count(*) AS n FROM {_terms_sql('sym', 'seq', 'signature')} GROUP BY ALL"),
    "stem": (
        stems,
        f"""WITH {SYM_SQL}, w AS (SELECT unnest(regexp_extract_all(coalesce(summary, ''), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM sym), p AS (SELECT DISTINCT lower(unnest({_SPLIT.format('w')})) AS word FROM w)
            SELECT word, {_stem_sql('word')} AS stem FROM p""",
    ),
    "term_frequencies": (search.postings, f"WITH {_INDEX_SQL} SELECT node, term, frequency FROM idx"),
    "doc_lengths": (lambda r: search.lengths(search.postings(r)), f"WITH {_INDEX_SQL} SELECT node, length FROM len"),
    "prefix_expansion": (prefixes, f"WITH {_INDEX_SQL}, {_QUERY_SQL} SELECT query, count(*) AS terms, round(CAST(sum(factor) AS DOUBLE), 6) AS factors FROM complete GROUP BY query"),
    "bm25_topk": (top_five, f"{_SCORE_SQL} SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place, score, matched FROM boosted QUALIFY place <= 5"),
    "search_quality": (search_quality, None),
}

QUERIES = {name: (lambda spark, folder, f=f: f(Relations(spark, folder))) for name, (f, _) in _CALLS.items()}
SQL = {name: sql for name, (_, sql) in _CALLS.items() if sql}
