"""Queries on term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.llm.terms import term_weights
from codeskein.session import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(read_table(spark, sf_dir, "search_hits")).where(F.col("holders").between(2, 8)).select("hit_id", "term")


def p6_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(read_table(spark, sf_dir, "search_hits")).select("hit_id", "term", "degree", "holders", F.round("rarity", 6).alias("rarity"), F.round("weight", 6).alias("weight"))


QUERIES = {"p6_found": p6_found, "p6_term_weights": p6_term_weights}

_WORDS = r"""
    words AS (
      SELECT DISTINCT hit_id, list_filter(list_transform(coalesce(terms, CAST([] AS VARCHAR[])), lambda t: lower(regexp_replace(t, '^\s+|\s+$', '', 'g'))),
             lambda t: t IS NOT NULL AND t <> '') AS w
      FROM search_hits WHERE hit_id IS NOT NULL),
    held AS (SELECT DISTINCT hit_id, unnest(w) AS term FROM words),
    df AS (SELECT term, count(*) AS holders FROM held GROUP BY term)"""

SQL = {
    "p6_found": f"WITH {_WORDS} SELECT hit_id, term FROM held JOIN df USING (term) WHERE holders BETWEEN 2 AND 8",
    "p6_term_weights": f"""
        WITH {_WORDS},
        places AS (SELECT hit_id, row_number() OVER () AS r, w FROM words),
        spots AS (SELECT hit_id, r, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM places),
        deg AS (
          SELECT a.hit_id, a.term, count(DISTINCT b.term) AS degree
          FROM spots a LEFT JOIN spots b ON a.r = b.r AND abs(a.i - b.i) BETWEEN 1 AND 2 AND a.term <> b.term GROUP BY ALL),
        len AS (SELECT hit_id, count(*) AS length FROM held GROUP BY hit_id),
        n AS (SELECT (SELECT count(DISTINCT hit_id) FROM search_hits) AS records, (SELECT avg(length) FROM len) AS mean),
        s AS (
          SELECT hit_id, term, degree, holders, CASE WHEN holders > 1 THEN ln((records + 1.0) / holders) ELSE 0.0 END AS rare,
                 1 - 0.003 + 0.003 * length / mean AS norm
          FROM deg JOIN df USING (term) JOIN len USING (hit_id), n)
        SELECT hit_id, term, degree, holders, round(rare, 6) AS rarity, round((1 + degree) / norm * rare, 6) AS weight FROM s""",
}
