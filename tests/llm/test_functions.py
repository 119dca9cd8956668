import random
import re
import time

import pandas as pd
import pytest

from codeskein.lang import grammars
from codeskein.llm import functions
from codeskein.llm.functions import description, documented_functions, says_nothing

DOCS = "doc_id long, path string, text string, name string, language string"
SHARP = """namespace A
{
    /// <summary>
    /// Counts what is left, see <see cref="T:A.Other"/>.
    /// </summary>
    /// <param name="a">A number.</param>
    [Obsolete("x")]
    public static int Left(ref int a, string b = "x, y") { return a; }

    /// <summary>Left of B.</summary>
    int _field;
    int Undocumented() { return 1; }

    /// <summary>TODO</summary>
    int Planned() => 1;

    /// <summary>Gives the other half.</summary>
    int Half<T>(T x) where T : class => 2;

    // Not a documentation comment.
    int Plain() { return 1; }

    /// <summary>Has no body.</summary>
    abstract int None();

    string s = "/// <summary>no</summary> int F() { }";
    /** <summary>Builds it from nothing at all.</summary> */
    public A(int x) : base(x) { }
}
"""
SHARP = SHARP.replace("namespace A\n{", "class A\n{")
PLUS = """namespace n {
/// \\brief Adds two numbers and rounds.
/// \\param a first
template <typename T>
[[nodiscard]] T Box<T>::add(const T& a, int b = f(1, 2)) const noexcept
{ return a; }
//! Attaches the fence.
void AttachFence() { }
/*! Reads all rows. */
Box::Box(int a) : a_(a), b_{2} { }
/// Only declared here.
int later(int);
/// Left before a statement.
int counter = 3;
int after() { return 1; }
}
"""


def rows(spark, texts):
    df = spark.createDataFrame([(i, p, t, "n", "l") for i, (p, t) in enumerate(texts)], DOCS)
    return documented_functions(df).collect()


def test_pairs_of_both_languages(spark):
    got = rows(spark, [("a.cs", SHARP), ("b.hpp", PLUS), ("c.js", SHARP), (None, SHARP), ("d.cs", None), ("e.cs", ""), ("f.cs", SHARP[:-5]), ("g.cs", SHARP.replace("\n", "\r\n"))])
    by = {(r["doc_id"], r["name"]): r for r in got}
    assert {k[1] for k in by if k[0] == 0} == {"Left", "Half", "A"} == {k[1] for k in by if k[0] == 7}
    assert {k[1] for k in by if k[0] == 1} == {"add", "Box"}
    assert {k[0] for k in by} == {0, 1, 7}
    left = by[0, "Left"]
    assert left["line_no"] == 8 and left["description"] == "Counts what is left, see Other." and by[7, "Left"]["line_no"] == 8
    assert left["signature"] == 'int Left(ref int a, string b = "x, y")'
    assert [tuple(p) for p in left["parameters"]] == [("a", "int", "ref", None), ("b", "string", None, '"x, y"')]
    assert left["code"].startswith("[Obsolete") and left["code"].endswith("return a; }")
    add = by[1, "add"]
    assert add["description"] == "Adds two numbers and rounds." and add["signature"] == "T add(const T& a, int b = f(1, 2)) const" and add["line_no"] == 5


@pytest.mark.parametrize("text,name,empty", [
    ("", "F", True), ("...", "F", True), ("n/a", "F", True), ("TODO: describe", "F", True), ("No description.", "F", True), ("Attaches the fences.", "AttachFence", True),
    ("attach_fence method.", "AttachFence", True), ("AttachFence", "attach_fence", True), ("Attaches the fence to the wall.", "AttachFence", False), ("Returns one.", "F", False), ("Die Beschreibung folgt aus dem Namen.", "F", False),
])
def test_what_says_nothing(text, name, empty):
    assert says_nothing(text, name) is empty


def test_descriptions():
    assert description("/// <inheritdoc/>") == ""
    assert description("/// <param name='a'>A.</param>\n/// <returns>B</returns>") == ""
    assert description("/**\n * @brief One\n * two.\n *\n * @param a x\n * @return y\n */") == "One two."
    assert description("//! One.\n//! Two.") == "One. Two."


def test_empty_table(spark):
    assert rows(spark, [("x.txt", "a")]) == []
    assert documented_functions(spark.createDataFrame([], DOCS)).count() == 0


def test_local_functions_branches_and_tight_comments(spark):
    sharp = """class A {
    ///<summary>Counts what is left.</summary>
    int Tight() {
        if (x) {
            /// <summary>Adds the tax to it.</summary>
            static int Taxed(int a) { return a; }
            /// <summary>Gives the sum of both.</summary>
            int Both(int a, int b) => a + b;
            Run(() => { /** <summary>Lies in a lambda.</summary> */ List<int> Deep(int y) { return null; } });
        }
        /// <summary>No function at all.</summary>
        return new B(1) { C = 2 };
    }
#if X
    /// <summary>Works on the first system.</summary>
    int First() { return 1; }
#elif Y
    #if Z
    /// <summary>Works on the second system.</summary>
    int Second() { return 1; }
    #else
    /// <summary>Works on the third system.</summary>
    int Third() { return 1; }
    #endif
#else
    /// <summary>Works on all others.</summary>
    int Other() { return 1; }
#endif
    int P { get {
        /// <summary>Helps the property out.</summary>
        int Helper() { return 1; }
        return Helper(); } }
}
"""
    plus = """///< Trailing mark of a member.
int f() {
    if (a) { struct L {
        /// Compares by weight only.
        bool operator()(int a, int b) const { return a < b; }
    }; }
    /// Says what follows.
    for (int i = 0; i < 2; i++) { g(i); }
    return 1;
}
"""
    got = rows(spark, [("a.cs", sharp), ("b.cpp", plus)])
    assert sorted(r["name"] for r in got if r["doc_id"] == 0) == ["Both", "Deep", "First", "Helper", "Other", "Second", "Taxed", "Third", "Tight"]
    assert [r["name"] for r in got if r["doc_id"] == 1] == ["operator()"]
    by = {r["name"]: r for r in got}
    assert by["Tight"]["description"] == "Counts what is left." and by["Taxed"]["code"] == "static int Taxed(int a) { return a; }"


def test_names_take_no_work_for_other_columns(spark, monkeypatch):
    texts = [("a.cs", SHARP), ("b.hpp", PLUS), ("c.js", SHARP), (None, SHARP), ("d.cs", None), ("e.cs", ""), ("f.cs", SHARP[:-5]), ("g.cs", SHARP.replace("\n", "\r\n"))]
    df = spark.createDataFrame([(i, p, t, "n", "l") for i, (p, t) in enumerate(texts)], DOCS)
    want = sorted((r["doc_id"], r["line_no"], r["name"]) for r in documented_functions(df).collect())
    assert sorted(tuple(r) for r in functions.documented_names(df).collect()) == want and len(want) == 8

    def fail(*_):
        raise AssertionError

    for part in ("_parameters", "_result_type", "_spaced"):
        monkeypatch.setattr(functions, part, fail)
    batch = pd.DataFrame([(1, PLUS, "Cpp")], columns=["doc_id", "text", "language"])
    assert [tuple(r) for d in functions._names(iter([batch])) for r in d.itertuples(index=False)] == [(1, 5, "add"), (1, 10, "Box")]
    monkeypatch.setattr(functions, "readings", fail)  # nothing is parsed without a documentation comment
    bare = pd.DataFrame([(1, "int f() { return 1; } // plain", "Cpp"), (2, 'class A { string s = "/// no"; }', "CSharp")], columns=batch.columns)
    assert list(functions._names(iter([bare]))) == list(functions._pairs(iter([bare]))) == []


@pytest.mark.parametrize("language", ["CSharp", "Cpp"])
def test_rules_match_only_where_their_needs_are(language):
    pick = random.Random(5)
    matches = 0
    for pattern, _, needs in [r for rules in grammars._FOLDS[language] for r in rules]:
        marks = re.sub(r"\\[AZ]|[\\|]|\(\?<?[:=!]", "", pattern.pattern) + "N()"
        for _ in range(400):
            kinds = "".join(pick.choices(marks, k=9)) if pick.random() < 0.5 else "".join(pick.choices(marks, k=3)) + needs + "".join(pick.choices(marks, k=3))
            found = pattern.search(kinds)
            matches += found is not None
            assert found is None or needs in kinds, (pattern.pattern, needs, kinds)
    assert matches > 1000


def test_spans_in_linear_time():
    start = time.process_time()
    n = 20_000
    assert functions.function_spans("NN(){" * n + "}" * n, "Cpp") == [(0, 1, 2, 3, 4, 6 * n - 1)]
    assert functions.function_spans("N=N(N(N(N)));" * n + "NN()AN(N(N));" + "N(()A{N();});" * 10, "CSharp") == [(13 * n, 13 * n + 1, 13 * n + 2, 13 * n + 3, 13 * n + 4, 13 * n + 12)]
    assert time.process_time() - start < 5


def test_nearest_of_several_comments():
    text = "/// Says the first thing.\n\n/** Says the second thing. */ // plain\n#define X 1\nint f() { return 1; }\n/// Closes the text.\n"
    assert [r[:3] for r in functions._documented(text, "Cpp")] == [(5, "f", "Says the second thing.")]
    assert [r[:3] for r in functions._documented("/// Runs it all.\n" * 3 + "int f() { return 1; }", "Cpp")] == [(4, "f", "Runs it all. Runs it all. Runs it all.")]
