import pytest
from compare import FOLDER

from codeskein.engine import Ambiguous, CodeGraph


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return CodeGraph(spark, FOLDER, str(tmp_path_factory.mktemp("notes") / "n.json"))


def test_every_question_has_an_answer(graph):
    top = graph.rel.edges.where("edge_kind = 'Calls'").groupBy("to_node").count().orderBy("count", ascending=False).first()["to_node"]
    name = graph.rel.symbols.where(f"seq = {top}").first()["id"]
    kind = graph.rel.symbols.where("kind = 'Class'").orderBy("seq").first()["id"]
    assert graph.workspace_status().first()["symbols"] > 0
    assert graph.diagnostics().columns and graph.find_symbol("a").count() > 0
    assert graph.symbol_info(name).first()["incoming"] > 0 and graph.go_to_definition(name).count() == 1
    assert graph.type_members(kind, inherited=True).columns and graph.type_hierarchy(kind, True).columns
    assert graph.find_references(name).count() > 0 and graph.find_callers(name).count() > 0 and graph.find_implementations(name).columns
    assert graph.find_callees(name).columns and graph.impact_analysis(name).count() > 0
    context = graph.get_context(name, 1, 200).collect()
    assert context and sum(r["tokens"] for r in context) <= 200
    caller = graph.rel.edges.where(f"to_node = {top} AND edge_kind = 'Calls' AND coalesce(confidence, 0) <> 2").orderBy("from_node").first()["from_node"]
    path = graph.find_path(graph.rel.symbols.where(f"seq = {caller}").first()["id"], name).collect()
    assert [r["step"] for r in path] == list(range(len(path))) and path[-1]["id"] == name and len(path) == 2
    assert graph.search_code("shared").columns and set(graph.module_map()) >= {"communities", "entry_points"}
    assert graph.file_outline(graph.rel.symbols.first()["file"]).columns


def test_names_that_fail(graph):
    with pytest.raises(KeyError):
        graph.resolve("NoSuchThing")
    symbols = graph.rel.symbols
    same = symbols.where("kind = 'Method'").groupBy("name").count().where("count > 1").first()
    if same:
        with pytest.raises(Ambiguous):
            graph.resolve(same["name"])
    built = symbols.where("kind = 'Constructor'").select("name").join(symbols.where("kind = 'Class'").groupBy("name").count().where("count = 1"), "name").first()
    if built:  # a type goes before its own constructors
        assert graph.resolve(built["name"]) == symbols.where((symbols["name"] == built["name"]) & (symbols["kind"] == "Class")).first()["seq"]


def test_notes(graph):
    assert graph.annotate("T:x") is None
    assert graph.annotate("T:x", "hello") == "hello" == graph.annotate("T:x")
    assert graph.annotate("T:x", "") is None
