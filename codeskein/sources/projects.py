"""Solution and project files: discovery, property and condition evaluation, items and globs."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

from codeskein.functions.text import glob_regex

SOLUTIONS = (".slnx", ".sln", ".csproj", ".vcxproj")
CPP_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inl", ".ipp")
#: Directories that default items and folder scans leave out, besides hidden ones.
LEFT_OUT = ("bin", "obj", "build", "out", "node_modules", "CMakeFiles")
_PROPERTY = re.compile(r"\$\(([\w.]+)\)")


@dataclass
class Project:
    path: str
    name: str
    language: str
    sdk: str | None = None
    target_framework: str | None = None
    language_version: str | None = None
    preprocessor_symbols: list[str] = field(default_factory=list)
    project_references: list[str] = field(default_factory=list)
    package_references: list[tuple[str, str | None]] = field(default_factory=list)
    usings: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)


def discover(directory: str) -> tuple[str, list[str], list[str]]:
    """(root file or folder, project files, problems): the first solution or project by kind and name, else a
    compilation database, else the folder itself as a C++ project."""
    at = Path(directory)
    if at.is_file():
        return str(at), projects_of(str(at)), []
    for suffix in SOLUTIONS:
        found = sorted(p for p in at.iterdir() if p.suffix.lower() == suffix)
        if found:
            problems = [f"several {suffix} files, {found[0].name} is taken"] if len(found) > 1 else []
            return str(found[0]), projects_of(str(found[0])), problems
    for place in (at, at / "build", at / "out"):
        if (place / "compile_commands.json").is_file():
            return str(place / "compile_commands.json"), [], []
    if any(p.suffix.lower() in CPP_SUFFIXES for p in at.rglob("*")):
        return str(at), [], []
    return str(at), [], ["no solution, project or source file"]


def projects_of(path: str) -> list[str]:
    """Project files that a solution names, in order and with slashes; a project names itself."""
    text, base = Path(path).read_text(encoding="utf-8-sig"), Path(path).parent
    if path.endswith(".slnx"):
        named = [e.get("Path", "") for e in ET.fromstring(text).iter() if e.tag.rpartition("}")[2] == "Project"]
    elif path.endswith(".sln"):
        named = re.findall(r'^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"', text, re.M)
    else:
        return [path]
    return [os.path.normpath(base / n.replace("\\", "/")) for n in named if n.lower().endswith(("proj",))]


class _Condition:
    """or / and / ! / parentheses / Exists('x') / 'a' == 'b' / 'a' != 'b' / booleans."""

    def __init__(self, text: str, directory: str):
        self.tokens = re.findall(r"'[^']*'|==|!=|<=|>=|[()!<>]|[^\s()!=<>']+", text)
        self.at, self.directory = 0, directory

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def value(self) -> bool:
        result = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r} in condition")
        return result

    def either(self) -> bool:
        result = self.both()
        while self.peek().lower() == "or":
            self.take()
            result = self.both() or result
        return result

    def both(self) -> bool:
        result = self.one()
        while self.peek().lower() == "and":
            self.take()
            result = self.one() and result
        return result

    def one(self) -> bool:
        t = self.take()
        if t == "!":
            return not self.one()
        if t == "(":
            result = self.either()
            if self.take() != ")":
                raise ValueError("unbalanced condition")
            return result
        if t.lower() == "exists":
            self.take()
            path = self.take().strip("'")
            self.take()
            return os.path.exists(os.path.join(self.directory, path.replace("\\", "/")))
        if self.peek() in ("==", "!=", "<", ">", "<=", ">="):
            op, a, b = self.take(), t.strip("'"), self.take().strip("'")
            if op in ("==", "!="):
                return (a.lower() == b.lower()) == (op == "==")
            x, y = float(a), float(b)
            return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if t.strip("'").lower() in ("true", "false"):
            return t.strip("'").lower() == "true"
        raise ValueError(f"unsupported condition at {t!r}")


class _Evaluation:
    def __init__(self, path: str, configuration: str, platform: str):
        self.path, self.directory = path, os.path.dirname(os.path.abspath(path))
        name = Path(path).stem
        self.properties = {"configuration": configuration, "platform": platform, "msbuildprojectname": name, "msbuildprojectdirectory": self.directory, "msbuildthisfiledirectory": self.directory + "/", "projectdir": self.directory + "/", "os": "Unix"}
        self.items: dict[str, list[str]] = {}
        self.usings: list[str] = []
        self.removed_usings: set[str] = set()
        self.packages: list[tuple[str, str | None]] = []
        self.problems: list[str] = []

    def expand(self, text: str | None) -> str:
        return _PROPERTY.sub(lambda m: self.properties.get(m[1].lower(), ""), text or "")

    def holds(self, e: ET.Element) -> bool:
        condition = e.get("Condition")
        if not condition:
            return True
        try:
            return _Condition(self.expand(condition), self.directory).value()
        except ValueError as x:
            self.problems.append(str(x))
            return False

    def run(self, root: ET.Element) -> None:
        for e in root:
            tag = e.tag.rpartition("}")[2]
            if not self.holds(e):
                continue
            if tag == "PropertyGroup":
                for p in e:
                    if self.holds(p):
                        self.properties[p.tag.rpartition("}")[2].lower()] = self.expand("".join(p.itertext()).strip())
            elif tag == "ItemGroup":
                for item in e:
                    if self.holds(item):
                        self.item(item)
            elif tag == "Choose":
                for branch in e:
                    if branch.tag.rpartition("}")[2] == "Otherwise" or self.holds(branch):
                        self.run(branch)
                        break
            elif tag == "Import":
                target = os.path.join(self.directory, self.expand(e.get("Project")).replace("\\", "/"))
                if os.path.isfile(target):
                    self.run(ET.fromstring(Path(target).read_text(encoding="utf-8-sig")))
                elif "Sdk" not in e.attrib and "$(" not in (e.get("Project") or ""):
                    self.problems.append(f"import not found: {e.get('Project')}")

    def item(self, e: ET.Element) -> None:
        kind = e.tag.rpartition("}")[2]
        include, remove = self.expand(e.get("Include")), self.expand(e.get("Remove"))
        values = [v.strip().replace("\\", "/") for v in include.split(";") if v.strip()]
        if kind == "Using":
            self.removed_usings |= {v.strip() for v in remove.split(";") if v.strip()}
            self.usings += [v for v in values]
            return
        if kind == "PackageReference":
            version = e.get("Version") or next((c.text for c in e if c.tag.rpartition("}")[2] == "Version"), None)
            self.packages += [(v, self.expand(version) or None) for v in values]
            return
        have = self.items.setdefault(kind, [])
        if kind in ("ProjectReference", "Reference", "FrameworkReference"):
            have += values
            return
        excluded = {f for v in self.expand(e.get("Exclude")).split(";") if v.strip() for f in self.files(v.strip().replace("\\", "/"))}
        for v in values:
            have += [f for f in self.files(v) if f not in have and f not in excluded]
        gone = {f for v in remove.split(";") if v.strip() for f in self.files(v.strip().replace("\\", "/"))}
        if gone:
            self.items[kind] = [f for f in have if f not in gone]

    def files(self, pattern: str) -> list[str]:
        """Matching files in ordinal order; a plain name stands for itself."""
        whole = os.path.normpath(os.path.join(self.directory, pattern))
        if "*" not in pattern and "?" not in pattern:
            return [whole]
        fixed = re.split(r"[*?]", whole, maxsplit=1)[0].rpartition("/")[0]
        matches = re.compile(glob_regex(whole))
        return sorted(str(f) for f in Path(fixed).rglob("*") if f.is_file() and matches.match(str(f))) if os.path.isdir(fixed) else []


def default_sources(directory: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files below a directory, without build output and hidden directories, in ordinal order."""
    found = []
    for at, folders, files in os.walk(directory):
        folders[:] = [f for f in folders if not f.startswith(".") and f not in LEFT_OUT]
        found += [os.path.join(at, f) for f in files if f.lower().endswith(suffixes)]
    return sorted(found)


def read_project(path: str, configuration: str = "Debug", platform: str = "AnyCPU") -> Project:
    """Evaluates a project file; several target frameworks stand for the first of them."""
    root = ET.fromstring(Path(path).read_text(encoding="utf-8-sig"))
    cpp = path.lower().endswith(".vcxproj")
    e = _Evaluation(path, configuration, platform)
    sdk = root.get("Sdk")
    e.run(root)
    many = e.properties.get("targetframeworks")
    if many and "targetframework" not in e.properties:
        first = many.split(";")[0].strip()
        e = _Evaluation(path, configuration, platform)
        e.properties["targetframework"] = first
        e.run(root)
    compiled = [f for k in (("ClCompile", "ClInclude") if cpp else ("Compile",)) for f in e.items.get(k, [])]
    if sdk and not cpp and e.properties.get("enabledefaultcompileitems", "true").lower() != "false":
        removed = _removed(root, e)
        compiled = sorted({f for f in default_sources(e.directory, (".cs",)) if f not in removed} | set(compiled))
    symbols = [s for s in re.split(r"[;,\s]+", e.properties.get("defineconstants", "")) if s]
    if cpp:
        symbols += ["_DEBUG"] if configuration.lower() == "debug" else ["NDEBUG"]
    usings = [u for u in dict.fromkeys(e.usings) if u not in e.removed_usings]
    if sdk and e.properties.get("implicitusings", "").lower() in ("enable", "true"):
        usings = [u for u in dict.fromkeys([*IMPLICIT_USINGS, *usings]) if u not in e.removed_usings]
    return Project(
        path, e.properties.get("assemblyname") or Path(path).stem, "Cpp" if cpp else "CSharp", sdk, e.properties.get("targetframework"),
        e.properties.get("langversion") or ("Cpp20" if cpp else None), symbols,
        [os.path.normpath(os.path.join(e.directory, p)) for p in e.items.get("ProjectReference", [])], e.packages, usings, compiled, e.problems,
    )


def _removed(root: ET.Element, e: _Evaluation) -> set[str]:
    out: set[str] = set()
    for item in root.iter():
        if item.tag.rpartition("}")[2] == "Compile" and item.get("Remove"):
            for v in e.expand(item.get("Remove")).split(";"):
                out |= set(e.files(v.strip().replace("\\", "/")))
    return out


# Namespaces an SDK project imports by itself.
IMPLICIT_USINGS = ("System", "System.Collections.Generic", "System.IO", "System.Linq", "System.Net.Http", "System.Threading", "System.Threading.Tasks")


def read_workspace(root: str, configuration: str = "Debug", platform: str = "AnyCPU") -> tuple[list[Project], list[str]]:
    """The projects of a workspace and all they refer to, breadth first; missing ones are reported."""
    _, queue, problems = discover(root)
    seen: dict[str, Project] = {}
    while queue:
        path = queue.pop(0)
        if path in seen:
            continue
        if not os.path.isfile(path):
            problems.append(f"project not found: {path}")
            continue
        seen[path] = read_project(path, configuration, platform)
        queue += seen[path].project_references
    return list(seen.values()), problems
