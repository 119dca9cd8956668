import json

import pytest

from codeskein.sources.compilation import entries, parse_options, read_database
from codeskein.sources.files import Annotations, SnapshotStore, newest_assemblies, read_sources
from codeskein.sources.projects import _Condition, discover, projects_of, read_project, read_workspace


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_default_items_leave_out_build_output(tmp_path):
    put(tmp_path, {"A.csproj": '<Project Sdk="X"><PropertyGroup><TargetFramework>net10.0</TargetFramework></PropertyGroup></Project>', "Program.cs": "", "Sub/Helper.cs": "", "bin/B.cs": "", "obj/O.cs": "", ".hidden/H.cs": "", "readme.txt": ""})
    p = read_project(str(tmp_path / "A.csproj"))
    assert [s[len(str(tmp_path)) + 1 :] for s in p.sources] == ["Program.cs", "Sub/Helper.cs"] and p.target_framework == "net10.0"


def test_wildcards_and_explicit_items(tmp_path):
    put(tmp_path, {"P/P.csproj": '<Project Sdk="X"><ItemGroup><Compile Remove="Legacy/**" /><Compile Include="../Shared/**/*.cs" /></ItemGroup></Project>', "P/Program.cs": "", "P/Legacy/Old.cs": "", "Shared/Deep/Common.cs": ""})
    assert [s.rpartition("/")[2] for s in read_project(str(tmp_path / "P/P.csproj")).sources] == ["Program.cs", "Common.cs"]
    put(tmp_path, {"Q/Q.csproj": '<Project Sdk="X"><PropertyGroup><EnableDefaultCompileItems>false</EnableDefaultCompileItems></PropertyGroup><ItemGroup><Compile Include="A.cs" /></ItemGroup></Project>', "Q/A.cs": "", "Q/B.cs": ""})
    assert [s.rpartition("/")[2] for s in read_project(str(tmp_path / "Q/Q.csproj")).sources] == ["A.cs"]


def test_properties_conditions_and_choices(tmp_path):
    put(tmp_path, {"C.csproj": """<Project Sdk="X"><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks><V>1</V><V Condition="'$(V)' == '1' and !('$(Configuration)' == 'Release')">2</V><ImplicitUsings>enable</ImplicitUsings></PropertyGroup>
      <Choose><When Condition="'$(V)' == '2'"><PropertyGroup><DefineConstants>A;B_$(V)</DefineConstants></PropertyGroup></When><Otherwise><PropertyGroup><DefineConstants>NO</DefineConstants></PropertyGroup></Otherwise></Choose>
      <ItemGroup><ProjectReference Include="..\\D\\D.csproj" /><PackageReference Include="P" Version="$(V).0" /><Using Include="Own" /><Using Remove="System.IO" /></ItemGroup></Project>"""})
    p = read_project(str(tmp_path / "C.csproj"))
    assert p.target_framework == "net8.0" and p.preprocessor_symbols == ["A", "B_2"] and p.package_references == [("P", "2.0")]
    assert "Own" in p.usings and "System.Linq" in p.usings and "System.IO" not in p.usings
    found, problems = read_workspace(str(tmp_path))
    assert [x.name for x in found] == ["C"] and len(problems) == 1 and "not found" in problems[0]


@pytest.mark.parametrize("text,value", [("'a' == 'A'", True), ("'a' != 'b' or false", True), ("!('1' == '1')", False), ("Exists('nothing.here')", False), ("true And ('x' == 'y' Or true)", True), ("3 > 2", True)])
def test_conditions(text, value, tmp_path):
    assert _Condition(text, str(tmp_path)).value() is value


def test_bad_condition(tmp_path):
    with pytest.raises(ValueError):
        _Condition("'a' ~ 'b'", str(tmp_path)).value()


def test_solutions(tmp_path):
    put(tmp_path, {"S.slnx": '<Solution><Project Path="App/App.csproj" /><Folder Name="x"><Project Path="Lib\\Lib.csproj" /></Folder></Solution>', "S.sln": 'Project("{X}") = "App", "App\\App.csproj", "{1}"\nEndProject\n'})
    assert [p.rpartition("/")[2] for p in projects_of(str(tmp_path / "S.slnx"))] == ["App.csproj", "Lib.csproj"]
    assert [p.rpartition("/")[2] for p in projects_of(str(tmp_path / "S.sln"))] == ["App.csproj"]
    assert discover(str(tmp_path))[0].endswith("S.slnx")
    (tmp_path / "empty").mkdir()
    assert discover(str(tmp_path / "empty"))[2]


def test_compilation_database(tmp_path, spark):
    rows = [{"directory": "/w", "file": "a.cc", "command": "g++ -std=c++20 -DX=1 -D Y -Iinc 'a b.cc'"}, {"directory": "/w", "file": "a.cc", "command": "g++ -DZ"}, {"directory": "/w", "file": "b.cc", "arguments": ["cl", "/std:c++17", "/DQ"]}, {"directory": "/w", "file": "c.cc", "arguments": ["cl", "/std:c++17", "/DQ"]}]
    (tmp_path / "compile_commands.json").write_text(json.dumps(rows))
    files, common = read_database(str(tmp_path / "compile_commands.json"))
    assert files["/w/a.cc"].defines == ("X=1", "Y") and files["/w/a.cc"].includes == ("/w/inc",) and common.standard == "c++17"
    assert parse_options(["-DA", "-UA"], "/").defines == ()
    assert sorted(r["file"] for r in entries(spark, str(tmp_path / "compile_commands.json")).collect()) == ["a.cc", "b.cc", "c.cc"]


def test_files_and_hashes(tmp_path, spark):
    (tmp_path / "a.cs").write_bytes(b"\xef\xbb\xbfclass A { }")
    (tmp_path / "b.txt").write_text("x")
    rows = read_sources(spark, str(tmp_path), "*.cs").collect()
    import hashlib

    assert [(r["path"], r["text"]) for r in rows] == [(str(tmp_path / "a.cs"), "class A { }")]
    assert rows[0]["hash"] == hashlib.sha256(b"\xef\xbb\xbfclass A { }").hexdigest().upper()


def test_snapshots(tmp_path, spark):
    store = SnapshotStore(str(tmp_path / "s"))
    assert store.load(spark) == (None, "no snapshot")
    store.save({"files": spark.createDataFrame([("a", 1)], "path string, n long")})
    store.save({"files": spark.createDataFrame([("b", 2)], "path string, n long")})
    assert store.load(spark)[0]["files"].first()["path"] == "b"
    assert SnapshotStore(str(tmp_path / "s"), "Release").load(spark)[1] == "other configuration"
    (tmp_path / "s/current.json").write_text("{")
    assert store.load(spark) == (None, "damaged snapshot")


def test_annotations(tmp_path, spark):
    notes = Annotations(str(tmp_path / "n.json"))
    notes.set("b", "second")
    notes.set("a", "first")
    assert [n["target"] for n in json.loads((tmp_path / "n.json").read_text())] == ["a", "b"]
    notes.set("b", " ")
    assert Annotations(str(tmp_path / "n.json")).get("b") is None and notes.rows(spark).count() == 1
    (tmp_path / "n.json").write_text("nonsense")
    assert Annotations(str(tmp_path / "n.json")).notes == {}


def test_newest_assembly(spark):
    df = spark.createDataFrame([("A", "1.9.0", "x"), ("A", "1.10.0", "z"), ("A", "1.10.0", "y"), ("B", "2.0", "b")], "name string, version string, path string")
    assert sorted(map(tuple, newest_assemblies(df).collect())) == [("A", "1.10.0", "y"), ("B", "2.0", "b")]
