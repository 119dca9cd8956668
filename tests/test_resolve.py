from types import SimpleNamespace

from codeskein.operators.resolve import resolve_symbols


def relations(spark):
    symbols = [
        (1, "T:App.Core.Loader", "Class", "Loader", None, "App.Core", "a/Loader.cs"),
        (2, "M:App.Core.Loader.#ctor(System.Int32)", "Constructor", "Loader", "T:App.Core.Loader", "App.Core", "a/Loader.cs"),
        (3, "M:App.Core.Loader.Read(System.String,System.Collections.Generic.List{System.Int32})", "Method", "Read", "T:App.Core.Loader", "App.Core", "a/Loader.cs"),
        (4, "M:App.Core.Loader.op_Implicit(App.Core.Loader)~System.Int32", "Method", "op_Implicit", "T:App.Core.Loader", "App.Core", "a/Loader.cs"),
        (5, "T:Other.Reader", "Class", "Reader", None, "Other", "b/Reader.cs"),
        (6, "M:Other.Reader.Read", "Method", "Read", "T:Other.Reader", "Other", "b/Reader.cs"),
        (7, "M:Other.Reader.Gen``1(``0)", "Method", "Gen", "T:Other.Reader", "Other", "b/Reader.cs"),
    ]
    symbols = spark.createDataFrame(symbols, "seq long, id string, kind string, name string, container_id string, namespace string, file string")
    items = spark.createDataFrame([(1, "class Loader\n{\n  Read\n  x\n}\n", 10), (3, "Read\nx\n", 12), (5, None, 1)], "node long, code string, code_line int")
    edges = spark.createDataFrame([(1, 3, 6, 2, 13), (2, 3, 5, 0, 13), (3, 3, None, 0, 14), (4, 1, 6, 0, 12)], "edge_id long, from_node long, to_node long, confidence int, first_line int")
    return SimpleNamespace(symbols=symbols, references=edges, externals=spark.createDataFrame([(70, "M:Lib.X.Save", "Save")], "node long, id string, name string"), table=lambda name: {"context_items": items}[name])


def test_every_form(spark):
    asked = {
        "T:App.Core.Loader": ("id", 1, 1),
        "M:App.Core.Loader.op_Implicit(App.Core.Loader)": ("id without return type", 1, 4),
        "M:App.Core.Loader.Read": ("start of id", 1, 3),
        "M:Other.Reader.Gen": ("start of id", 1, 7),
        "M:App.Core.Loader.Read(String,List{Int32})": ("simplified parameters", 1, 3),
        "loader": ("name", 1, 1),
        "Read": ("name", 2, 3),
        "Reader.Read": ("name", 1, 6),
        "other::reader.read": ("name", 1, 6),
        "Core.Reader.Read": None,
        "Load": ("part of name", 1, 1),
        "oade": ("part of name", 1, 1),
        "Save": ("external", 1, 70),
        "a/Loader.cs:10": ("declared here", 1, 1),
        "a/Loader.cs:12:3": ("declared here", 1, 3),
        "a/Loader.cs:13": ("referenced here", 1, 5),
        "a/Loader.cs:14:1": ("enclosing", 1, 1),
        "a/Loader.cs:99": None,
        "nothing": None,
        "": None,
        None: None,
        " Save ": None,
    }
    rows = spark.createDataFrame([(q,) for q in asked] * 2, "query string")
    got = {r["query"]: (r["stage"], r["candidates"], r["node"]) for r in resolve_symbols(relations(spark), rows).collect()}
    assert got == {q: x for q, x in asked.items() if x}
    assert resolve_symbols(relations(spark), rows.limit(0)).count() == 0
