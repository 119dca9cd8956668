import re

from codeskein.functions.text import glob_regex, is_test, name_regex, stem, terms
from pyspark.sql import functions as F


def _terms(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(terms(F.col("t"))).first()[0]


def test_terms_of_names_and_sentences(spark):
    assert _terms(spark, "ParseHTTPRequest2") == ["pars", "http", "request", "2", "parsehttprequest2"]
    assert _terms(spark, "the parser parses files") == ["parser", "pars", "fil"]
    assert _terms(spark, None) == [] and _terms(spark, "") == []


def test_stems_meet(spark):
    got = [r[0] for r in spark.createDataFrame([(w,) for w in ("entries", "entry", "cached", "cache", "pass", "status")], "w string").select(stem(F.col("w"))).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "pass" and got[5] == "status"


def test_patterns():
    assert re.match(glob_regex("src/**/*.cs"), "src/a/b/C.cs") and re.match(glob_regex("src/**/*.cs"), "src/C.cs")
    assert not re.match(glob_regex("*.cs"), "a/C.cs") and re.match(glob_regex("a?.cs"), "ab.CS")
    assert re.match(name_regex("Try*"), "tryparse") and not re.match(name_regex("Try*"), "Retry")


def test_test_paths(spark):
    paths = ["src/Tests/A.cs", "src/MyTest.cs", "src/Contest/A.cs", "src/Testing/A.cs", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(is_test(F.col("p"))).collect()]
    assert got == [True, True, True, False, False]
