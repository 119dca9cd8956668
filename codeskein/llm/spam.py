"""Keyword-stuffed pages and link lists, told from writing by their rank-frequency curves.

Per page the counts of its terms are ranked with a window and a line is fitted to log count over log rank. Each
page is also held against the prose of its language: how many bits its terms diverge from what pages of that
language hold, in all and in its two most divergent terms. Every figure is judged against the median and spread
of the pages of the same language and comparable length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.operators.skew import skew_join
from codeskein.session import materialize

LINK, TAG, NUMBER = "1link", "1tag", "1number"
#: Pages with fewer terms have no curve.
LEAST_TERMS = 5
#: A language has a reference when so many pages carry its label.
LEAST_PAGES = 8
#: So many of the most held terms of a language tell which pages may be in it.
PROFILE = 64
#: Spreads (1.4826 x median absolute deviation) beyond the median of comparable pages.
HEAD_SPREADS, CURVE_SPREADS, JOINT_SPREADS = 5.0, 5.0, 3.0
#: Least spread that is assumed, so that a uniform group doesn't flag its own noise.
LEAST_SPREAD = {"slope": 0.05, "residual": 0.03, "divergence": 0.1, "head": 0.05}
#: Groups with fewer pages are judged by all lengths of the language together.
LEAST_GROUP = 30


def page_terms(text: Column) -> Column:
    """Lower-cased terms of a page's prose: fenced code is left out; links, hash tags and numbers are one term each."""
    prose = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " ")
    prose = F.regexp_replace(prose, r"(?i)(?:https?://|www\.)[^\s)\]>]+", f" {LINK} ")
    prose = F.lower(F.regexp_replace(prose, r"#[\p{L}\p{N}_]+", f" {TAG} "))
    terms = F.regexp_extract_all(prose, F.lit(rf"{LINK}|{TAG}|\p{{L}}[\p{{L}}\p{{M}}]*|\p{{N}}+"), F.lit(0))
    return F.transform(terms, lambda t: F.when(t.rlike(r"^\p{N}+$"), NUMBER).otherwise(t))


def page_curves(pages: DataFrame) -> DataFrame:
    """Figures of every page: doc_id, n_terms, slope, residual, divergence, head, language, length_class, flagged.

    slope and residual (root mean square) are those of the line through (ln rank, ln count); 0 where a page has
    under three distinct terms. language is the one, of its own label's and the two whose most held terms it uses most, whose
    reference the page diverges least from; references hold, per labelled language, the pages holding each term. divergence is the
    Kullback-Leibler divergence in nats, head what its two largest summands give. length_class is the whole part
    of log2(n_terms), 4 to 10.

    flagged: head is extreme, or the divergence is high together with a high head or an extreme slope or residual. Null texts and pages
    under LEAST_TERMS terms have null figures and are not flagged. Rows of one ``doc_id`` are one page, their
    texts counted together. If no label has enough pages, all pages form one language, named "". Other columns
    are ignored.
    """
    one = pages.select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("label"), "text").where(F.col("doc_id").isNotNull())
    one = one.repartition("doc_id").select("doc_id", "label", F.explode_outer(page_terms(F.col("text"))).alias("t"))
    counts = one.groupBy("doc_id", F.xxhash64("t").alias("term"), F.col("t").isNull().alias("empty")).agg(F.count("t").alias("count"), F.max("label").alias("label"))
    by_page = Window.partitionBy("doc_id")
    counts = counts.where(~F.col("empty") | (F.col("count") == 0)).select(
        "doc_id", "label", "term", "count",
        F.row_number().over(by_page.orderBy(F.desc("count"), "term")).alias("rank"),
        F.sum("count").over(by_page).alias("n_terms"),
    )
    counts = materialize(counts)
    long_enough = counts.where(F.col("n_terms") >= LEAST_TERMS)

    labels = long_enough.where((F.col("rank") == 1) & (F.col("label") != "")).groupBy("label").agg(F.count(F.lit(1)).alias("pages"))
    languages = materialize(labels.where(F.col("pages") >= LEAST_PAGES))
    if languages.isEmpty():
        languages = materialize(long_enough.where(F.col("rank") == 1).select(F.lit("").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("pages")))
        long_enough = long_enough.withColumn("label", F.lit(""))
    nearest = _nearest(long_enough.select("doc_id", "label", "term", "count", "n_terms"), languages)

    x, y = F.log("rank"), F.log("count")
    fit = counts.groupBy("doc_id").agg(
        F.max("n_terms").alias("n_terms"),
        F.count(F.lit(1)).alias("distinct_terms"),
        F.regr_slope(y, x).alias("b"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )
    curved = (F.col("n_terms") >= LEAST_TERMS) & (F.col("distinct_terms") >= 3)
    fit = fit.select(
        "doc_id",
        "n_terms",
        F.when(curved, F.col("b")).when(F.col("n_terms") >= LEAST_TERMS, 0.0).alias("slope"),
        F.when(curved, F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")) / F.col("distinct_terms"))).when(F.col("n_terms") >= LEAST_TERMS, 0.0).alias("residual"),
        F.least(F.lit(10), F.greatest(F.lit(4), F.floor(F.log2(F.greatest(F.col("n_terms"), F.lit(1)))))).cast("int").alias("length_class"),
    )
    return _judged(materialize(fit.join(nearest, "doc_id", "left")))


def _candidates(terms: DataFrame, languages: DataFrame, holders: DataFrame) -> DataFrame:
    """doc_id, languages: up to three (language, log of its size) a page may be in: its label's, the two whose PROFILE
    most held terms make up most of it, and the largest where it has none of them, by name.

    Profiles are cut per language before anything meets them, and pages before they are brought together.
    """
    vocabulary = holders.select("term").distinct().count()
    sizes = holders.groupBy("label").agg(F.log(F.sum("holders") + F.lit(0.5 * vocabulary + 1)).alias("whole"))
    sizes = materialize(languages.join(sizes, "label"))
    most = Window.partitionBy("label").orderBy(F.desc("holders"), "term")
    profile = holders.withColumn("n", F.row_number().over(most)).where(F.col("n") <= PROFILE)
    profile = materialize(profile.groupBy("term").agg(F.collect_list("label").alias("languages")))
    met = skew_join(terms.select("doc_id", "term", "count"), profile, "term", "inner")
    shares = met.select("doc_id", F.explode("languages").alias("label"), "count").groupBy("doc_id", "label").agg(F.sum("count").alias("share"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("share"), "label")
    alike = shares.withColumn("n", F.row_number().over(best)).where("n <= 2").select("doc_id", "label")
    pages = terms.groupBy("doc_id").agg(F.max("label").alias("label"))
    found = skew_join(pages.unionByName(alike), sizes.select("label", "whole"), "label", "inner")
    found = found.groupBy("doc_id").agg(F.collect_set(F.struct("label", "whole")).alias("languages"))
    largest = sizes.orderBy(F.desc("pages"), "label").limit(1).select(F.array(F.struct("label", "whole")).alias("largest"))
    return pages.select("doc_id").join(found, "doc_id", "left").join(F.broadcast(largest)).select("doc_id", F.sort_array(F.coalesce("languages", "largest")).alias("languages"))


def _nearest(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """doc_id, divergence, language, head of the candidate language a page diverges least from.

    terms: doc_id, label, term, count, n_terms; languages: label, pages. The reference has an entry per term and
    language that holds it, however many languages there are; a page's terms take only those of its candidates.
    """
    known = skew_join(terms.select("label", "term"), languages.select("label"), "label", "inner")
    holders = materialize(known.groupBy("label", "term").agg(F.count(F.lit(1)).alias("holders")))
    candidates = materialize(_candidates(terms, languages, holders))
    reference = materialize(holders.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "holders"))).alias("held")))
    placed = terms.select("doc_id", "term", (F.col("count") / F.col("n_terms")).alias("p")).join(candidates, "doc_id")

    def summand(k: int) -> Column:
        g = F.get("languages", k)
        return (F.col("p") * (F.log("p") - F.log(F.coalesce(F.try_element_at("held", g["label"]), F.lit(0)) + 0.5) + g["whole"])).cast("float")

    met = skew_join(placed, reference, "term", "left").select("doc_id", *[summand(k).alias(f"d{k}") for k in range(3)])
    total = met.groupBy("doc_id").agg(*[F.sum(f"d{k}").alias(f"s{k}") for k in range(3)], *[F.slice(F.sort_array(F.collect_list(f"d{k}"), asc=False), 1, 2).alias(f"top{k}") for k in range(3)])
    each = [F.when(F.col(f"s{k}").isNotNull(), F.struct(F.col(f"s{k}").alias("divergence"), F.get("languages", k)["label"].alias("language"), F.aggregate(f"top{k}", F.lit(0.0), lambda a, x: a + x).alias("head"))) for k in range(3)]
    return total.join(candidates, "doc_id").select("doc_id", F.least(*each).alias("x")).select("doc_id", "x.*")


def _judged(figures: DataFrame) -> DataFrame:
    """Adds ``flagged``. Medians and spreads come from mergeable quantile summaries, one row per language and length."""
    names = list(LEAST_SPREAD)
    figures = figures.withColumn("wide", F.col("language")).withColumn("close", F.concat_ws("\n", "language", "length_class"))
    usable = figures.where(F.col("language").isNotNull())

    def middles(key: str) -> DataFrame:
        mid = materialize(usable.groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_pages"), *[F.percentile_approx(c, 0.5, 10000).alias(f"{c}_{key}_mid") for c in names]))
        off = skew_join(usable, mid, key, "inner").groupBy(key).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_{key}_mid")), 0.5, 10000).alias(f"{c}_{key}_mad") for c in names])
        return materialize(mid.join(off, key))

    both = skew_join(skew_join(figures, middles("close"), "close"), middles("wide"), "wide")
    few = F.coalesce(F.col("close_pages"), F.lit(0)) < LEAST_GROUP

    def spreads(c: str) -> Column:
        mid, mad = (F.when(few, F.col(f"{c}_wide_{k}")).otherwise(F.col(f"{c}_close_{k}")) for k in ("mid", "mad"))
        return (F.col(c) - mid) / F.greatest(F.lit(LEAST_SPREAD[c]), 1.4826 * mad)

    curve = (F.abs(spreads("slope")) > CURVE_SPREADS) | (spreads("residual") > CURVE_SPREADS)
    joint = (curve | (spreads("head") > JOINT_SPREADS)) & (spreads("divergence") > JOINT_SPREADS)
    flagged = (spreads("head") > HEAD_SPREADS) | joint
    return both.select("doc_id", "n_terms", "slope", "residual", "divergence", "head", "language", "length_class", F.coalesce(flagged, F.lit(False)).alias("flagged"))
