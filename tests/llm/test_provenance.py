import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from codeskein.llm.evidence import traits
from codeskein.llm.provenance import COMPATIBLE, LABELS, ROOT, SIBLING, plain_path, source_labels, tree_beliefs

U = ", ".join(f"u{k} double" for k in range(5))


def brute(leaves):
    """Marginals by enumerating all labellings of directories and sibling groups; names without evidence. leaves: path,
    log-likelihoods."""
    above = {}
    for p, _ in leaves:
        d = p.rpartition("/")[0]
        above[d, p.rpartition(".")[2]] = d
        while d:
            above[d] = d = d.rpartition("/")[0]
    inner = ["", *above]
    group = [(p.rpartition("/")[0], p.rpartition(".")[2]) for p, _ in leaves]
    total = [[0.0] * 5 for _ in leaves]
    for labels in itertools.product(range(5), repeat=len(inner)):
        of = dict(zip(inner, labels))
        w = ROOT[of[""]] * math.prod(COMPATIBLE[of[up]][of[n]] for n, up in above.items())
        sums = [sum(SIBLING[of[g]][j] * math.exp(u[j]) for j in range(5)) for g, (_, u) in zip(group, leaves)]
        whole = math.prod(sums)
        for i, (g, (_, u)) in enumerate(zip(group, leaves)):
            for j in range(5):
                total[i][j] += w * whole / sums[i] * SIBLING[of[g]][j] * math.exp(u[j])
    return [[x / sum(t) for x in t] for t in total]


def test_beliefs_are_exact_marginals(spark):
    rng = random.Random(1)
    leaves = [(p, [0.0] + [rng.uniform(-3, 3) for _ in range(4)]) for p in ("x/a.cs", "x/b.cs", "x/c.h", "x/y/c.cs", "e.cs")]
    rows = [(r, p, *u) for r in ("one", "two/three", None) for p, u in leaves]
    df = spark.createDataFrame(rows, f"repo string, path string, {U}")
    got = {(r["repo"], r["path"]): [r[f"b{k}"] for k in range(5)] for r in tree_beliefs(df).collect()}
    assert len(got) == 15
    for (p, _), expected in zip(leaves, brute(leaves)):
        for repo in ("one", "two/three", None):
            weights = [math.exp(b - max(got[repo, p])) for b in got[repo, p]]
            assert [w / sum(weights) for w in weights] == pytest.approx(expected, abs=1e-9)


def test_neighbours_decide_what_a_file_leaves_open(spark):
    """The same weak sign is overruled among hand-written siblings and upheld among copied ones or below their
    directory; the same path in another repository has no part in it."""
    weak, strong, none = [0.0, -3.0, -6.0, 3.4, -5.0], [0.0, -3.0, -6.0, 9.0, -5.0], [0.0, -3.0, -6.0, -2.5, -5.0]
    rows = [("a", f"lone/K{i}.cs", *none) for i in range(5)] + [("a", "lone/Weak.cs", *weak)]
    rows += [("a", f"kin/C{i}.cs", *strong) for i in range(4)] + [("a", "kin/Weak.cs", *weak), ("a", "vendor/Weak.cs", *weak)]
    rows += [("b", f"kin/K{i}.cs", *none) for i in range(4)] + [("b", "kin/Weak.cs", *weak)]
    got = tree_beliefs(spark.createDataFrame(rows, f"repo string, path string, {U}")).where(F.col("path").endswith("Weak.cs")).collect()
    vendored = {(r["repo"], r["path"]) for r in got if r["b3"] > r["b0"]}
    assert vendored == {("a", "kin/Weak.cs"), ("a", "vendor/Weak.cs")}


def test_paths(spark):
    written = ["./a//b.cs", "a\\b.cs", "a/x/../b.cs", "/a/b.cs", " a/b.cs", "a/./b.cs", "a/1/2/3/4/5/6/../../../../../../b.cs"]
    got = spark.createDataFrame([(p,) for p in written], "p string").select(plain_path(F.col("p"))).distinct().collect()
    assert [r[0] for r in got] == ["a/b.cs"]
    above = spark.createDataFrame([("../a/../../b.cs",), (None,)], "p string").select(plain_path(F.col("p"))).collect()
    assert [r[0] for r in above] == ["../../b.cs", None]


HAND = "using System;\n\nnamespace Mine.App\n{\n    /// <summary>Adds.</summary>\n    class K%d\n    {\n        // why\n        int F(int a) { return a + %d; }\n        void G() { if (x) { Run(); } else { Stop(); } }\n    }\n}\n"
COPY = "using System;\nusing System.IO;\n\nnamespace Theirs.Core\n{\n    class Z\n    {\n        // why not\n        int F(int a) { return a + 1; }\n        int G(int a) { while (a > 1) { a--; } return a; }\n        int H(string s) { return s.Length; }\n    }\n}\n"


def test_labels(spark):
    docs = [(i, f"r/Mine/src/K{i}.cs", "r", HAND % (i, i)) for i in range(12)]
    docs += [
        (100, "r/Mine/src/Form.Designer.cs", "r", "namespace Mine { partial class F { void Init() {\n" + "\n".join(f"this.button{i} = new Button();\nthis.button{i}.Text = \"b\";" for i in range(1, 12)) + "\n} } }"),
        (101, "r/Mine/src/Gen.cs", "r", "// <auto-generated>\n// by a tool\n// </auto-generated>\nnamespace Mine { class A { } }"),
        (102, "r/Mine/src/Trap.cs", "r", "// What it writes starts with <auto-generated> and must not be edited.\n" + HAND % (1, 1)),
        (103, "r/Mine/web/app.min.js", "r", "!function(a,b){" + "".join(f"if(!a)return b({i});a.c=function(d){{e=a+{i}}};" for i in range(40)) + "}();"),
        (104, "r/Mine/src/Z.cs", "r", COPY), (105, "s/Other/vendor/theirs/Z.cs", "s", COPY.replace("\n", "\r\n")),
        (106, "r/Mine/src/Data.cs", "r", "namespace Mine;\nstatic class D {\n static readonly byte[] Bytes = {\n" + "\n".join("0x1f, 0x2e, 0x3d, 0x4c, 0x5b, 0x6a," for _ in range(40)) + "\n};\n}\n"),
        (107, "r/Mine/src/Rows.cs", "r", "id,a,b\n" + "\n".join(f"{i},x,{i * 7}" for i in range(50))),
        (108, "r/Mine/src/Empty.cs", "r", ""), (109, None, None, None), (0, "r/Mine/src/K0.cs", "r", HAND % (0, 0)), (None, "r/x.cs", "r", "x"),
    ]
    d = spark.createDataFrame([(*x, "t", 1.0) for x in docs], "doc_id long, path string, repo string, text string, label string, u0 double")
    s = spark.createDataFrame([(x[0], "Mine" if x[2] == "r" else "Other") for x in docs if x[0] is not None], "doc_id long, project string")
    p = spark.createDataFrame([(["r\\Mine\\src\\Gen.cs", "./r/Mine/Page.xaml", None],), (None,)], "generated_sources array<string>")
    got = {r["doc_id"]: r["label"] for r in source_labels(d, s, p).collect()}
    assert {k for k, v in got.items() if v != "handwritten"} == {100, 101, 103, 104, 105, 106, 107}
    assert got[103] == "minified" and got[104] == "vendored" == got[105] and got[106] == "blob" == got[107] and got[101] == "generated"
    assert set(got) == {x[0] for x in docs if x[0] is not None} and set(got.values()) <= set(LABELS)
    assert source_labels(d.limit(0), s, p).count() == 0


def test_traits_of_nothing():
    t = traits("")
    assert t.size == 0 and not t.markup and t.namespace == ""
