import pytest

from codeskein.lang.declarations import declarations, extract_declarations, name_references
from codeskein.lang.grammars import analyse, tokens_of
from codeskein.lang.lalr import Parser, build

SHARP = """using System;
namespace A.B;
/// <summary>x</summary>
[Obsolete("old")]
public partial class P<T> : Base, IFoo<int> where T : class, new()
{
    private readonly Dictionary<string, List<int>> _m = new() { ["a"] = new List<int> { 1 } };
    public string? Name { get; private set; } = null;
    public int this[int i] => _m.Count + i;
    public static implicit operator int(P<T> p) => 1;
    public P(int a, string b = "x") : base(a) { }
    ~P() { }
    public async Task<int> RunAsync<U>(Func<U, int> f, params int[] rest) where U : struct
    {
        var x = (int)f(default) + (a < b ? 1 : 2) * rest[^1];
        foreach (var (k, v) in _m) { if (v is { Count: > 0 } l && k is not null) Console.WriteLine($"{k,-3}: {v.Count:D2} {{x}}"); }
        var y = x switch { > 0 and < 10 => "a", 11 or 12 => "b", _ => throw new Exception() };
        await using var z = Open(); for (int i = 0, j = 1; i < j; i++, j--) { continue; }
        var q = from c in list where c.A > 1 orderby c.B descending select new { c.A, c.B };
        try { lock (_m) { goto end; } } catch (IOException e) when (e.X != 0) { throw; } finally { }
        end: return await Task.FromResult<int>(0);
    }
    public delegate void D<in X>(X x);
    enum E : byte { A = 1, B, }
}
public record Point(int X, int Y) { public double Length => Math.Sqrt(X * X + Y * Y); }
"""
PLUS = """#pragma once
#include <vector>
#define MAX(a, b) ((a) > (b) ? (a) : (b))
namespace geo::detail {
template <typename T, int N = 3> class Box final : public Shape<T>, private X {
public:
    explicit Box(int a) noexcept : a_(a), b_{2} {}
    ~Box() override = default;
    Box& operator=(const Box&) = delete;
    bool operator==(const Box& o) const { return a_ == o.a_; }
    [[nodiscard]] virtual std::map<std::string, std::vector<T>> get(const char* p[], T&& x = T{}) const&;
    operator bool() const { return a_ != 0; }
private:
    int a_ = 0, *q_ = nullptr; unsigned long long c_[4] = {1, 2}; T* p_{nullptr}; int flag : 3;
};
enum class Color : int { Red = 1, Green };
struct { int x; } anonymous;
using Fn = void (*)(int);
typedef struct S { int a; } S;
extern "C" { int c_api(void); }
}
static int f(int n, ...) {
    auto g = [&, n](auto a) mutable -> int { return a << n; };
    for (const auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) { delete[] it->second; } }
    int* p = new int[10]; double d = static_cast<double>(n) / 2.0f + (double)n; unsigned u = 1'000u;
    switch (n) { case 1: case 'a': break; default: return sizeof(int) > 4 ? g(1) : -1; }
    const char* raw = R"x(}{ ")x"; do { --n; } while (n > 0 && a < b);
    try { throw std::runtime_error("x" "y"); } catch (const std::exception& e) { } catch (...) { }
#ifdef A
    if (n) {
#else
    if (!n) {
#endif
        return 1; }
    return {};
}
"""


@pytest.mark.parametrize("text,language", [(SHARP, "CSharp"), (PLUS, "Cpp")])
def test_broad_samples_parse_and_tokens_join(text, language):
    tokens, _, error = analyse(text, language)
    assert error is None, "".join(tokens[max(0, error - 20) : error + 5])
    assert "".join(tokens_of(text, language)) == text


@pytest.mark.parametrize("language,text", [(n, t) for n, t in (("CSharp", SHARP), ("Cpp", PLUS))])
def test_damage_is_found(language, text):
    body = text.replace("\n", " \n")
    for broken in (body[: len(body) // 2], body + "}", body.replace("return", "return return", 1), body.replace("= 0", "= ", 1) if "= 0" in body else body + "(", "<<<<<<< HEAD\n" + body, body.replace(";", " ", 3).replace("{", "{ int = 3;", 1), body + '"', body + "/* open"):
        assert analyse(broken, language)[2] is not None


def test_empty_text_is_valid():
    assert analyse("", "CSharp")[2] is None and analyse(" \n// x\n", "Cpp")[2] is None


def test_lalr_against_brute_force():
    tables = build("expr : expr + term | term\nterm : term * atom | atom\natom : a | ( expr )")
    assert not tables.conflicts
    parser = Parser(tables)

    def valid(s):
        try:
            eval(s.replace("a", "1"), {})
        except Exception:
            return False
        return "()" not in s and "**" not in s and "++" not in s and not s.startswith(("+", "*"))

    import itertools

    for n in range(1, 6):
        for s in map("".join, itertools.product("a+*()", repeat=n)):
            if "(+" in s or "*+" in s or ")(" in s or "a(" in s or ")a" in s or "aa" in s:
                assert parser.error_at(s) >= 0
            else:
                assert (parser.error_at(s) < 0) == valid(s), s


def test_declarations_of_both_languages():
    found = {(d["kind"], d["name"], d["container"]) for d in declarations(SHARP, "CSharp")}
    assert {("Class", "P", None), ("Constructor", "P", "A.B.P"), ("Method", "RunAsync", "A.B.P"), ("Property", "Name", "A.B.P"), ("Enum", "E", "A.B.P"), ("Record", "Point", None)} <= found
    found = {(d["kind"], d["name"]) for d in declarations(PLUS, "Cpp")}
    assert {("Class", "Box"), ("Constructor", "Box"), ("Method", "get"), ("Enum", "Color"), ("Function", "f")} <= found


def test_extraction_is_null_safe(spark):
    files = spark.createDataFrame([("a.cs", "CSharp", SHARP), ("b.h", "Cpp", None), ("c.js", None, "x"), (None, "Cpp", "int f() { return 1; }")], "path string, language string, text string")
    rows = extract_declarations(files).collect()
    assert any(r["name"] == "RunAsync" and r["line"] == 13 for r in rows) and any(r["name"] == "f" for r in rows)
    symbols = spark.createDataFrame([(f"M:x{i}", "Open", "CSharp") for i in range(30)], "id string, name string, language string")
    refs = name_references(files, symbols).collect()
    assert len(refs) == 20 and {r["candidates"] for r in refs} == {30}


def test_signatures_are_whole():
    many = ", ".join(f"int parameter{i}" for i in range(40))
    found = [d["signature"] for d in declarations(f"class A {{ void F({many}, int x) {{ }} void F({many}, string x) {{ }} }}", "CSharp") if d["name"] == "F"]
    assert len(set(found)) == 2 and all("parameter39" in x for x in found)
