import random

from codeskein.llm.spam import page_curves
from compare import FOLDER

PAGES = "doc_id long, lang string, text string, term string, rank int"


def pages(n=90):
    rng = random.Random(2)
    nouns, verbs = ["node", "tree", "file", "graph", "edge", "list", "page", "row"], ["reads", "keeps", "writes", "moves"]
    out = []
    for i in range(n):
        prose = " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} its {rng.choice(nouns)} and then it is given to the {rng.choice(nouns)} in line." for _ in range(rng.randint(4, 12)))
        out.append((i, rng.choice(["en", "EN ", None]), prose))
    out.append((1000, "en", "\n".join(f"{rng.choice(['buy', 'cheap', 'best', 'free'])} lens-kit {rng.choice(['online', 'sale', ''])}" for _ in range(40))))
    out.append((1001, "en", "\n".join(f"https://a.example/{i}" for i in range(40))))
    out.append((1002, None, " ".join(f"#buy{i}Lens" for i in range(40))))
    out.append((1003, "en", None))
    out.append((1004, "en", ""))
    out.append((1005, "en", "too short"))
    out.append((None, "en", "x " * 50))
    return [(*r, "x", 1) for r in out]


def test_lists_stand_out_from_prose(spark):
    rows = pages()
    got = {r["doc_id"]: r for r in page_curves(spark.createDataFrame(rows, PAGES)).collect()}
    assert {d for d, r in got.items() if r["flagged"]} == {1000, 1001, 1002}
    assert got[1004]["slope"] is None and not got[1003]["flagged"] and got[1005]["n_terms"] == 2
    assert set(got) == {r[0] for r in rows if r[0] is not None}


def test_repeated_rows_are_one_page(spark):
    rows = pages()
    once = {r["doc_id"] for r in page_curves(spark.createDataFrame(rows, PAGES)).where("flagged").collect()}
    twice = {r["doc_id"] for r in page_curves(spark.createDataFrame(rows + [rows[90]], PAGES)).where("flagged").collect()}
    assert once == twice


def test_unlabelled_and_empty(spark):
    df = spark.createDataFrame([(i, None, "a b c d e f a a") for i in range(3)], "doc_id long, lang string, text string")
    assert page_curves(df).count() == 3
    assert page_curves(df.limit(0)).count() == 0


def test_pages_of_the_small_tables(spark):
    from codeskein.llm.spam_queries import p9_found

    assert p9_found(spark, FOLDER).columns == ["doc_id"]
