from codeskein.engine import CodeGraph

FILES = {
    "Demo.slnx": '<Solution><Project Path="Lib/Lib.csproj" /><Project Path="App/App.csproj" /></Solution>',
    "Lib/Lib.csproj": '<Project Sdk="X"><PropertyGroup><TargetFramework>net10.0</TargetFramework></PropertyGroup></Project>',
    "Lib/Shapes.cs": """namespace Demo.Shapes
{
    public interface IDrawable
    {
        void Draw(int scale);
    }
    public abstract class Shape : IDrawable
    {
        public virtual int Area(int unit) { return unit; }
        public int Area(string unit) { return 0; }
        public void Draw(int scale) { Area(scale); }
    }
    public class Square : Shape
    {
        public override int Area(int unit)
        {
            return unit * unit;
        }
    }
}
""",
    "App/App.csproj": '<Project Sdk="X"><ItemGroup><ProjectReference Include="..\\\\Lib\\\\Lib.csproj" /><ProjectReference Include="..\\\\Gone\\\\Gone.csproj" /></ItemGroup></Project>',
    "App/Main.cs": """namespace Demo.App
{
    public static class Program
    {
        public static void Main()
        {
            Render(new Square());
        }
        static void Render(Shape shape) { }
    }
}
""",
}


def test_a_folder_becomes_a_graph(spark, tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    graph, report = CodeGraph.workspace_load(spark, str(tmp_path / "src"), str(tmp_path / "tables"))
    rows = {r["project"]: r for r in report.collect()}
    assert rows["Lib"]["document_count"] == 1 and rows["Lib"]["symbol_count"] == 8 and rows["App"]["symbol_count"] == 3
    assert any("Gone" in p for p in rows["App"]["problems"])
    assert graph.workspace_status().first()["symbols"] == 11
    assert {r["id"] for r in graph.type_hierarchy("Square", True).collect()} == {"T:Demo.Shapes.Shape", "T:Demo.Shapes.IDrawable"}
    found = {r["id"] for r in graph.find_implementations("IDrawable.Draw").collect()}
    assert found == {"M:Demo.Shapes.Shape.Draw(int)"}
    assert {r["id"] for r in graph.find_implementations("M:Demo.Shapes.Shape.Area(int)").collect()} == {"M:Demo.Shapes.Square.Area(int)"}
    assert {r["caller"] for r in graph.find_references("Render").collect()} == {"M:Demo.App.Program.Main"}
    place = f"{tmp_path}/src/App/Main.cs:7"
    assert graph.resolve("Demo.App.Program") == graph.resolve(f"{tmp_path}/src/App/Main.cs:3") and graph.resolve(place)
