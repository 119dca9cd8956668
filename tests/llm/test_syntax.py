from codeskein.llm import syntax
from codeskein.llm.syntax import error_of, error_rates, syntax_errors

SOURCES = "path string, doc_id long, language string, failure string, errors array<struct<start_pos:int,end_pos:int,message:string>>, loaded_at timestamp, text string"
DOCS = "doc_id long, path string, repo string, text string, language string"


def tables(spark):
    good, bad = "class A { int F() { return 1; } }", "class A { int F() { return 1; }"
    docs = [(1, "a/x.cs", "r", good, "zz"), (2, "a/y.cs", "r", bad, "zz"), (3, "a/z.h", "r", "int f(", None), (4, "a/w.js", "r", "{{{", None), (5, "a/e.cs", None, "", None), (6, "a/n.cs", "r", None, None), (7, "b/odd.txt", "r", "int f(", None), (None, "a/q.cs", "r", bad, None)]
    src = [(p, d, lang, None, None, None, "t") for d, p, lang in ((1, "a/x.cs", "CSharp"), (2, "a/y.cs", "CSharp"), (2, "a/y.cs", "CSharp"), (3, "a/z.h", "Cpp"), (4, "a/w.js", None), (5, "a/e.cs", "CSharp"), (6, "a/n.cs", "CSharp"), (7, "b/odd.cc", "Cpp"), (None, "a/q.cs", "CSharp"), (99, "a/gone.cs", "CSharp"))]
    return spark.createDataFrame(src, SOURCES), spark.createDataFrame(docs, DOCS)


def test_found_whatever_the_suffix(spark, monkeypatch):
    src, docs = tables(spark)
    expected = {(2, "CSharp"), (3, "Cpp"), (7, "Cpp")}
    assert {(r["doc_id"], r["language"]) for r in syntax_errors(src, docs).collect()} == expected
    monkeypatch.setattr(syntax, "MOST_SUFFIXES", 0)
    assert {(r["doc_id"], r["language"]) for r in syntax_errors(src, docs).collect()} == expected


def test_rates(spark):
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid_files"]) for r in error_rates(*tables(spark)).collect()}
    assert rates == {("r", "CSharp"): (3, 1), (None, "CSharp"): (1, 0), ("r", "Cpp"): (2, 2)}


def test_places_of_errors():
    assert error_of("class A {\n  int x = ;\n}", "CSharp") == (2, 11, ";")
    assert error_of("void f() {", "Cpp") == (1, 11, "")
    assert error_of("#if A\nvoid f() {\n#else\nvoid f(int) {\n#endif\n}", "Cpp") is None
    assert error_of("#if A\nvoid f(\n#else\nvoid f(int) {}\n#endif\n", "Cpp") is None
    assert error_of("#if A\nvoid f() {}\n", "Cpp") is not None
    assert error_of('class A { string s = @"\n<<<<<<< x {\n"; /* } */ }', "CSharp") is None


def test_empty_tables(spark):
    src, docs = tables(spark)
    assert syntax_errors(src.limit(0), docs).count() == 0 and syntax_errors(src, docs.limit(0)).count() == 0
    assert error_rates(src.limit(0), docs).count() == 0


def test_the_token_of_an_error_is_whole():
    text = '"' + "x" * 100 + '"'
    assert error_of(f"class A {{ {text} }}", "CSharp")[2] == text
