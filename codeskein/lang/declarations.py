"""Declarations and identifier uses of C# and C++ files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeskein.lang.grammars import DROPPED, FOLDED, analyse

_STOP = re.compile("[;{}]")
_BRACE = re.compile("[{}]")
_LABELS = re.compile("(?:pN?:)+")
_NAMES = frozenset("N0123456789T")
_ACCESS = ("public", "private", "protected", "internal")
_TYPE_WORDS = ("class", "struct", "interface", "record", "enum", "union", "delegate")
#: Candidates kept per name when references are bound by name alone.
NAME_CANDIDATES = 20


def _close(kinds: str, at: int) -> int:
    depth = 0
    for m in _BRACE.finditer(kinds, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(kinds) - 1


def _flat(kinds: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Kinds outside parentheses and brackets; a parenthesis stands for its group."""
    out, i = [], a
    while i < b:
        j = i
        if kinds[i] in "([":
            depth = 0
            while j < b:
                depth += (kinds[j] in "([") - (kinds[j] in ")]")
                if not depth:
                    break
                j += 1
            if kinds[i] == "(":
                out.append(("(", i, j))
        else:
            out.append((kinds[i], i, i))
        i = j + 1
    return out


def _before_arguments(kinds: str, at: int, low: int) -> int:
    """Place of the name that ends at ``at``, type arguments left out."""
    depth = 0
    while at > low:
        depth += (kinds[at] == ">") - (kinds[at] == "<")
        if not depth and kinds[at] in _NAMES:
            break
        at -= 1
    return at


class _File:
    def __init__(self, text: str, language: str):
        self.sharp = language == "CSharp"
        self.tokens, kinds, self.error = analyse(text, language)
        self.ends = list(accumulate(map(len, self.tokens)))
        self.places = [i for i, k in enumerate(kinds) if k not in (FOLDED, DROPPED)]
        self.kinds = "".join(kinds[i] for i in self.places)
        self.found: list[dict] = []

    def words(self, a: int, b: int) -> list[str]:
        """Tokens from place a up to place b, folded ones too."""
        if a >= b:
            return []
        first = self.places[a - 1] + 1 if a else 0
        last = self.places[b] if b < len(self.places) else len(self.tokens)
        return [t for t in self.tokens[first:last] if not t.isspace() and t[:2] not in ("//", "/*") and t[0] != "#"]

    def add(self, kind: str, name: int, a: int, b: int, last: int, scope: list[tuple[str, str]], extra: dict) -> str:
        token = self.places[name]
        text = self.tokens[token]
        words = self.words(a, b)
        joint = "." if self.sharp else "::"
        spaces = [n for k, n in scope if k == "N"]
        types = [n for k, n in scope if k == "T"]
        start = self.ends[token] - len(text)
        shown = [w for w in words if w not in _ACCESS]
        self.found.append({
            "kind": kind, "name": text, "namespace": joint.join(spaces), "container": joint.join(spaces + types) if types else None, "signature": " ".join(shown),
            "accessibility": next((w for w in words if w in _ACCESS), None), "start": start, "stop": self.ends[self.places[last]], **extra,
        })
        return text


def declarations(text: str, language: str) -> list[dict]:
    """Namespaces' types and their members: kind, name, namespace, container, signature, accessibility, base_types,
    start (offset of the name) and stop. What follows a syntax error may be missing."""
    f = _File(text, language)
    kinds, scope, closes = f.kinds, [], []
    start = pos = 0
    while m := _STOP.search(kinds, pos):
        p, c = m.start(), m[0]
        if kinds.count("(", start, p) > kinds.count(")", start, p):
            pos = (_close(kinds, p) if c == "{" else p) + 1
            continue
        if c == "}":
            while closes and closes[-1][0] <= p:
                del scope[closes.pop()[1] :]
            start = pos = p + 1
            continue
        a = start
        if not f.sharp:
            if label := _LABELS.match(kinds, a, p):
                a = label.end()
            while kinds[a : a + 2] == "X<":
                depth, i = 0, a + 1
                while i < p:
                    depth += (kinds[i] == "<") - (kinds[i] == ">")
                    i += 1
                    if not depth:
                        break
                a = i
        top = _flat(kinds, a, p)
        flat = "".join(k for k, _, _ in top)
        plain = flat.split("H")[0] if f.sharp else flat
        group = next((x for n, x in enumerate(top) if x[0] == "(" and n and (top[n - 1][0] in _NAMES or top[n - 1][0] == ">")), None)
        assigned = "=" in flat[: flat.index("(")] if "(" in flat else "=" in flat
        if "Z" in plain:
            names = [f.tokens[f.places[i]] for k, i, _ in top if k in _NAMES]
            depth = len(scope)
            scope += [("N", n) for n in names]
            if c == "{":
                closes.append((_close(kinds, p), depth))
            start = pos = p + 1
            continue
        word = re.search("[KEG]|1(?=[N0-9K])", plain)
        if word and (c == "{" or f.sharp) and (f.sharp or group is None):
            after = [x for x in top[word.end() :] if x[0] in _NAMES]
            if after:
                kind = next((w for w in f.words(top[word.start()][1], top[word.start()][1] + 1) if w in _TYPE_WORDS), "class").capitalize()
                last = _close(kinds, p) if c == "{" else p
                colon = plain.find(":", word.end())
                bases = [f.tokens[f.places[i]] for k, i, _ in top[colon:] if k in _NAMES] if colon >= 0 else []
                name = after[0][1] if kind != "Delegate" or group is None else group[1] - 1
                text_name = f.add(kind, name, a, p, last, scope, {"base_types": bases})
                if c == "{" and "E" not in plain:
                    closes.append((last, len(scope)))
                    scope.append(("T", text_name))
                    start = pos = p + 1
                else:
                    start = pos = last + 1
                continue
        if group is not None and not assigned:
            body = c == "{" or "A" in flat
            last = _close(kinds, p) if c == "{" else p
            owner = next((n for k, n in reversed(scope) if k == "T"), None)
            name = _before_arguments(kinds, group[1] - 1, a)
            inside = any(k == "T" for k, _ in scope)
            label = f.tokens[f.places[name]]
            kind = "Constructor" if inside and label == owner else "Method" if inside or "x" in kinds[a:name] else "Function"
            if inside or body or not f.sharp:
                f.add(kind, name, a, group[2] + 1, last, scope, {"base_types": []})
            start = pos = last + 1
            continue
        if scope and any(k == "T" for k, _ in scope) or not f.sharp:
            names = [i for k, i, _ in top if k in _NAMES]
            before = flat.split("=")[0].split("A")[0]
            count = sum(k in _NAMES for k in before)
            if count > 1 and not word:
                prop = f.sharp and (c == "{" and "=" not in flat or "A" in flat)
                f.add("Property" if prop else "Field", names[count - 1], a, p, _close(kinds, p) if c == "{" else p, scope, {"base_types": []})
        start = pos = (_close(kinds, p) if c == "{" else p) + 1
    return f.found


_ROWS = "path string, language string, id string, kind string, name string, namespace string, container string, signature string, accessibility string, base_types array<string>, line int, stop_line int"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = {"Field": "F", "Property": "P", "Method": "M", "Constructor": "M", "Function": "M"}
    for pdf in batches:
        rows = []
        for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"]):
            text = text or ""
            for d in declarations(text, language):
                joint = "." if language == "CSharp" else "::"
                owner = d["container"] or d["namespace"]
                own = "#ctor" if d["kind"] == "Constructor" and language == "CSharp" else d["name"]
                rows.append((
                    path, language, f"{letters.get(d['kind'], 'T')}:{owner + joint if owner else ''}{own}", d["kind"], d["name"], d["namespace"], d["container"], d["signature"], d["accessibility"],
                    d["base_types"], text.count("\n", 0, d["start"]) + 1, text.count("\n", 0, d["stop"]) + 1,
                ))
        yield pd.DataFrame(rows, columns=["path", "language", "id", "kind", "name", "namespace", "container", "signature", "accessibility", "base_types", "line", "stop_line"])


def extract_declarations(files: DataFrame) -> DataFrame:
    """Declarations of files (path, language, text), read in place; null texts have none."""
    return files.select("path", "language", "text").where(F.col("language").isin("CSharp", "Cpp")).mapInPandas(_extract, _ROWS)


_USES = "path string, language string, name string, line int"


def _identifiers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = set()
        for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"]):
            tokens, kinds, _ = analyse(text or "", language)
            line = 1
            for t, k in zip(tokens, kinds):
                if k == "N" and len(t) > 1:
                    rows.add((path, language, t, line))
                line += t.count("\n")
        yield pd.DataFrame(sorted(rows), columns=["path", "language", "name", "line"])


def name_references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """References bound by name alone: path, line, name, target (an id), candidates.

    symbols: id, name, language. A name with more than NAME_CANDIDATES declarations keeps its first ones by id, as
    the reference records do; ``candidates`` tells how many there are.
    """
    uses = files.select("path", "language", "text").where(F.col("language").isin("CSharp", "Cpp")).mapInPandas(_identifiers, _USES)
    order = Window.partitionBy("name", "language").orderBy("id")
    targets = symbols.select("id", "name", "language").distinct().withColumn("n", F.row_number().over(order)).withColumn("candidates", F.max("n").over(Window.partitionBy("name", "language"))).where(F.col("n") <= NAME_CANDIDATES)
    return uses.join(targets, ["name", "language"]).select("path", "line", "name", F.col("id").alias("target"), "candidates")
