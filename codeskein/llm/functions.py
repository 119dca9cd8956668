"""Functions paired with the descriptions in their documentation comments.

Comment spans and function spans are found independently of each other and joined on the token after the comment,
which must be the function's first: anything else in between, a statement or another declaration, breaks the pair. Of
several comments in front of a token the nearest counts. Attributes, template heads and specifiers belong to the
function. Texts without a documentation comment are not parsed, for they have no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeskein.lang.grammars import DROPPED, FOLDED, readings, tokens_of
from codeskein.llm.syntax import suffix

# File suffixes of the two languages.
SUFFIXES = {"cs": "CSharp", "c": "Cpp", "cc": "Cpp", "cpp": "Cpp", "cxx": "Cpp", "h": "Cpp", "hh": "Cpp", "hpp": "Cpp", "hxx": "Cpp", "inl": "Cpp", "ipp": "Cpp"}

_BRACE = re.compile("[{}]")
_STOP = re.compile("[;{}]")
#: Statements and ends of blocks that hold no function: no arrow, and parentheses, if any, closed before the end.
_PLAIN = re.compile(r"(?:(?:[^;{}A()]|\((?:[^;{}A()]|\([^;{}A()]*+\))*+\))*+[;}])++")
_LABELS = re.compile("(?:p[N]?:)+")
#: What stands before a local function's name: attributes, modifiers, and its result's type.
_LOCAL = re.compile(r"(?:\[[^;{}]*?\])*[M7]*[N(][N0-9.,?*<>()\[\]]*")
#: Kinds that a name can have before a lexer's rules settle them.
_NAMES = frozenset("N0123456789T")


def _closings(kinds: str) -> dict[int, int]:
    """Place of the brace that closes the one at a place, the last place of all if none does."""
    closing, opened = {}, []
    for m in _BRACE.finditer(kinds):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closing[opened.pop()] = m.start()
    return closing | dict.fromkeys(opened, len(kinds) - 1)


def _angle_start(kinds: str, at: int, low: int) -> int:
    """Place of the ``<`` that the ``>`` at ``at`` closes, or -1."""
    depth = 0
    for i in range(at, low - 1, -1):
        depth += (kinds[i] == ">") - (kinds[i] == "<")
        if not depth:
            return i
    return -1


def _top_level(kinds: str, start: int, stop: int) -> list[tuple[str, int, int]]:
    """(kind, first, last place) outside parentheses and brackets; a parenthesis stands with its whole group."""
    out, i = [], start
    while i < stop:
        k = kinds[i]
        if k in "([":
            depth, j = 1, i + 1
            while j < stop and depth:
                depth += (kinds[j] in "([") - (kinds[j] in ")]")
                j += 1
            if k == "(":
                out.append((k, i, j - 1))
            i = j
        else:
            out.append((k, i, i))
            i += 1
    return out


def _header(top: list[tuple[str, int, int]], kinds: str, start: int) -> tuple[int, int, int] | None:
    """(name, opening, closing place) of a function's name and parameters, if the declaration has them."""
    operator = -1
    for n, (k, i, j) in enumerate(top):
        if k == "O":
            operator = i
        elif k == "=" and operator < 0:
            return None
        elif k == "H" and kinds[i : i + 3] == "HN:":
            return None
        elif k == "(":
            if operator >= 0:
                if i == operator + 1 and n + 1 < len(top) and top[n + 1][0] == "(":
                    continue
                return operator, i, j
            before = kinds[i - 1] if i > start else ""
            if before in _NAMES and before:
                return i - 1, i, j
            if before == ">":
                a = _angle_start(kinds, i - 1, start)
                if a > start and kinds[a - 1] in _NAMES:
                    return a - 1, i, j
    return None


def function_spans(kinds: str, language: str) -> list[tuple[int, int, int, int, int, int]]:
    """(first, name, opening, closing, body, last place) of every function with a body, those inside other bodies too."""
    sharp = language == "CSharp"
    found, start, pos = [], 0, 0
    closing = _closings(kinds)
    scopes: list[tuple[int, bool]] = []  # closing place of what is open, and whether it is a body
    while True:
        if start == pos and (m := _PLAIN.match(kinds, pos)):
            start = pos = m.end()
        if not (m := _STOP.search(kinds, pos)):
            break
        p, c = m.start(), m[0]
        while scopes and scopes[-1][0] < p:
            scopes.pop()
        body = bool(scopes) and scopes[-1][1]
        if kinds.count("(", start, p) > kinds.count(")", start, p):
            if c == "{" and body:
                scopes.append((closing[p], True))
                start = pos = p + 1
            else:
                pos = (closing[p] if c == "{" else p) + 1
            continue
        if c == "}" or (c == ";" and not (sharp and "A" in kinds[start:p])):
            start = pos = p + 1
            continue
        first = start
        if not sharp:
            if label := _LABELS.match(kinds, first, p):
                first = label.end()
            body_from = first
            while kinds[body_from : body_from + 2] == "X<":  # template heads
                depth = 0
                for i in range(body_from + 1, p):
                    depth += (kinds[i] == "<") - (kinds[i] == ">")
                    if not depth:
                        break
                body_from = i + 1
        else:
            body_from = first
        flat, top = kinds[body_from:p], []
        if "(" in flat or "[" in flat:  # else nothing is grouped and there is no header
            top = _top_level(kinds, body_from, p)
            flat = "".join([k for k, _, _ in top])
        if c == ";":
            arrow = flat.find("A")
            if arrow > 0 and (head := _header(top[:arrow], kinds, body_from)) and (not body or _LOCAL.fullmatch(kinds, first, head[0])):
                found.append((first, *head, top[arrow][1], p))
            start = pos = p + 1
            continue
        head = _header(top, kinds, body_from)
        if sharp:
            flat = flat.split("H")[0]
            inside = "Z" in flat or "K" in flat or re.search("1[N0-9K]", flat) is not None
        else:
            head = None if head and kinds[head[0] - 1 : head[0]] in ("J", "j", "9") else head
            inside = flat in ("S", "L") or "Z" in flat or ("K" in flat and head is None)
        if head and body and not (sharp and _LOCAL.fullmatch(kinds, first, head[0])):
            head = None
        if "E" in flat:
            start = pos = closing[p] + 1
        elif inside or head is None:
            scopes.append((closing[p], not inside))
            start = pos = p + 1
        elif not sharp and ":" in kinds[head[2] : p] and kinds[p - 1] in "N>":
            pos = closing[p] + 1  # a member's initialiser in braces
        else:
            last = closing[p]
            found.append((first, *head, p, last))
            scopes.append((last, True))
            start = pos = p + 1
    return found


_MARKS = re.compile(r"^[ \t]*(?://[/!]|/\*[*!]+|\*(?!/))(?:<(?![A-Za-z/]))?|\*/[ \t]*$", re.M)
_DOC = {"Cpp": re.compile(r"///(?![/<])|//!(?!<)|/\*\*(?![*/<])|/\*!(?!<)"), "CSharp": re.compile(r"///(?!/)|//!|/\*\*(?![*/])|/\*!")}  # '<' is a mark of Doxygen
_DOC_START = re.compile(r"//[/!]|/\*[*!]")  # in every text that has a match of the above
_UNSAID = re.compile(r"<(param|typeparam|returns|exception|value|permission|example|code|seealso)\b[^>]*?(?:/>|>.*?(?:</\1>|\Z))", re.S | re.I)
_SUMMARY = re.compile(r"<summary\s*>(.*?)(?:</summary\s*>|\Z)", re.S | re.I)
_NAMED = re.compile(r"<(?:see|paramref|typeparamref)\b[^>]*?\b(?:cref|name|langword)\s*=\s*[\"'](?:\w:)?([^\"']*)[\"'][^>]*>", re.I)
_SECTION = re.compile(r"[\\@](?:param|tparam|returns?|retval|throws?|exception|pre|post|sa|see|since|author|date|version|ingroup|defgroup|addtogroup|file|fn|todo|bug|test|copydoc|copybrief)\b.*?(?=\n[ \t]*\n|[\\@][a-z]+\b|\Z)", re.S)
_COMMAND = re.compile(r"[\\@](?:brief|short|details?|remarks?|note|warning|attention|par|internal|c|p|a|e|em|b|ref|li)\b")
_PLACEHOLDER = re.compile(
    r"""(?:todo|fixme|tbd|tba|xxx|wip)\b.*
    |(?:to\ be|needs\ to\ be|not\ yet|yet\ to\ be)\ (?:written|done|documented|described|determined|defined|added|completed|filled\ in)
    |(?:no|missing|undocumented|insert|add|enter|write|empty|some|your)?\s*(?:the\s+|a\s+)?(?:description|documentation|summary|comment|comments|docs?|text)(?:\s+(?:here|available|missing|provided|needed|yet|goes\ here|to\ come))*
    |undocumented|n\s*a|none|null|nil|nothing|unknown|placeholder|lorem\ ipsum.*|see\ above|same\ as\ above|as\ above|dito|ditto|inheritdoc""",
    re.X,
)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")
# Words that say nothing beside a name.
_ARTICLES = frozenset("a an the this that of for its method function constructor ctor member operator".split())


def description(comment: str) -> str:
    """What a documentation comment says of the function itself, on one line: the summary, else what stands outside
    the elements and sections for parameters, results and the like."""
    text = _MARKS.sub("", comment.replace("\r", "")).replace("*/", "")
    said = _SUMMARY.search(text)
    for part in ([said[1]] if said else []) + [text]:
        part = _UNSAID.sub(" ", part)
        part = _NAMED.sub(lambda m: m[1].rpartition(".")[2], part)
        part = re.sub(r"</?[A-Za-z][^<>]*>", " ", part)
        part = _COMMAND.sub(" ", _SECTION.sub(" ", part))
        part = " ".join(part.split())
        if part:
            return part
    return ""


@lru_cache(maxsize=50_000)
def _stem(word: str) -> str:
    w = word.lower()
    for end, new in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) + len(new) > 2:
            w = w[: -len(end)] + new
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


def says_nothing(text: str, name: str) -> bool:
    """Whether a description is empty, a placeholder, or only the name in other spelling or inflection."""
    words = re.findall(r"[^\W_]+", text)
    if not words or _PLACEHOLDER.fullmatch(" ".join(words).lower()):
        return True
    own = {_stem(w) for w in _WORD.findall(name)} | {_stem("".join(_WORD.findall(name)))}
    rest = [w for x in words if x.lower() not in _ARTICLES for w in ([x] if _stem(x) in own else _WORD.findall(x))]
    return all(_stem(w) in own or w.lower() in _ARTICLES for w in rest)


# Words before a type that a signature leaves out, and those that modify a parameter.
_MODIFIERS = frozenset("public private protected internal static readonly sealed abstract virtual override async extern unsafe partial new inline constexpr consteval explicit friend volatile required".split())
_PARAMETER_MODIFIERS = frozenset("ref out in params this scoped".split())
_OPENING, _CLOSING = frozenset("([{<"), frozenset(")]}>")


def _spaced(tokens: list[str]) -> str:
    return " ".join("".join(t if not t.isspace() and t[:2] not in ("//", "/*") else " " for t in tokens).split())


def _parameters(tokens: list[str], language: str) -> list[dict]:
    """Name, type, modifier and default value of the parameters between parentheses."""
    parts: list[list[str]] = [[]]
    depth = 0
    for t in tokens:
        if t in _OPENING:
            depth += 1
        elif t in _CLOSING:
            depth -= 1
        if t == "," and not depth:
            parts.append([])
        elif not t.isspace() and t[:2] not in ("//", "/*"):
            parts[-1].append(t)
        elif parts[-1]:
            parts[-1].append(" ")
    out = []
    for part in parts:
        text = [t for t in part]
        while text and text[-1] == " ":
            text.pop()
        if not text or text == ["void"]:
            continue
        default = None
        if "=" in text:
            k = text.index("=")
            default, text = "".join(text[k + 1 :]).strip(), text[:k]
            while text and text[-1] == " ":
                text.pop()
        modifier = []
        while language == "CSharp" and text and (text[0] in _PARAMETER_MODIFIERS or text[0] == " "):
            modifier.append(text.pop(0))
        named = [k for k, t in enumerate(text) if t[0].isalpha() or t[0] in "_@"]
        name, kind = None, text
        if len(named) > 1 and not any(t in (")", ">") for t in text[named[-1] + 1 :]):
            name, kind = text[named[-1]], text[: named[-1]] + text[named[-1] + 1 :]
        out.append({"name": name, "type": "".join(kind).strip(), "modifier": " ".join("".join(modifier).split()) or None, "default_value": default})
    return out


def _after(tokens: list[str], kinds: list[str], at: int) -> int:
    """The first place from ``at`` on of a token that is neither space, comment nor directive, nor left out."""
    n = len(tokens)
    while at < n and (kinds[at] == DROPPED or tokens[at].isspace() or tokens[at][:2] in ("//", "/*") or tokens[at][0] == "#"):
        at += 1
    return at


def _comments(tokens: list[str], kinds: list[str], starts: list[int]) -> dict[int, tuple[int, int]]:
    """First and last token of the nearest documentation comment before a token, by that token's place."""
    found: dict[int, tuple[int, int]] = {}
    past = follows = 0
    known, n = set(starts), len(tokens)
    for i in starts:
        if i < past or kinds[i] != FOLDED:
            continue
        last = i
        if tokens[i][1] == "/":  # line comments in a row are one
            while last + 2 in known and tokens[last + 1].isspace() and tokens[last + 1].count("\n") == 1 and tokens[last + 2][1] == "/" and kinds[last + 2] == FOLDED:
                last += 2
        past = last + 1
        if past > follows:
            follows = _after(tokens, kinds, past)
        if follows < n:
            found[follows] = i, last
    return found


def _documented(text: str, language: str) -> Iterator[tuple]:
    """(line of the name, name, description, tokens, places of the function's first token, name, parentheses, body and
    last token) of the functions whose comment says something."""
    if not _DOC_START.search(text):
        return
    doc = _DOC[language]
    tokens = tokens_of(text, language)
    starts = [i for i, t in enumerate(tokens) if t[0] == "/" and doc.match(t)]
    if not starts:
        return
    seen = set()
    for kinds in readings(tokens, language):
        comments = _comments(tokens, kinds, starts)
        if not comments:
            continue
        flat = "".join(kinds)
        codes = np.frombuffer(flat.encode("ascii"), np.uint8)
        real = np.flatnonzero((codes != ord(FOLDED)) & (codes != ord(DROPPED))).tolist()
        line, counted = 1, 0
        for first, name, opening, closing, body, last in function_spans(flat.replace(FOLDED, "").replace(DROPPED, ""), language):
            a = _after(tokens, kinds, real[first - 1] + 1 if first else 0)
            at = real[name]
            if a not in comments or at in seen:
                continue
            seen.add(at)
            label = tokens[at]
            if kinds[at] == "O":
                label = "".join(tokens[at : real[opening]]).replace(" ", "")
            elif name and kinds[real[name - 1]] == "P" and tokens[real[name - 1]] == "~":
                label = "~" + label
            i, j = comments[a]
            said = description("".join(tokens[i : j + 1]))
            if says_nothing(said, label.lstrip("~")):
                continue
            line += "".join(tokens[counted:at]).count("\n")
            counted = at
            yield line, label, said, tokens, (a, at, real[opening], real[closing], real[body], real[last])


def _result_type(before: list[str]) -> str:
    """What stands before a function's name, without attributes, template heads, modifiers and qualification."""
    out: list[str] = []
    depth, i = 0, 0
    words = [t for t in before if not t.isspace() and t[:2] not in ("//", "/*") and t[0] != "#"]
    while i < len(words):
        t = words[i]
        if t == "template" and words[i + 1 : i + 2] == ["<"]:
            depth, i = 0, i + 1
            while i < len(words):
                depth += (words[i] == "<") - (words[i] == ">")
                i += 1
                if not depth:
                    break
            continue
        if t == "[" and not out:
            while i < len(words):
                depth += (words[i] == "[") - (words[i] == "]")
                i += 1
                if not depth:
                    break
            continue
        if t not in _MODIFIERS:
            out.append(t)
        i += 1
    while out and out[-1] in ("::", ".", "~"):  # Scope::name
        out.pop()
        if out and out[-1] == ">":
            depth = 0
            while out:
                t = out.pop()
                depth += (t == ">") - (t == "<")
                if not depth:
                    break
        if out and (out[-1][0].isalpha() or out[-1][0] == "_"):
            out.pop()
    text = ""
    for t in out:
        text += (" " if text and (text[-1].isalnum() or text[-1] in "_>*&,]?") and (t[0].isalnum() or t[0] == "_") else "") + t
    return text


_PAIRS = "doc_id long, line_no int, name string, language string, signature string, parameters array<struct<name:string,type:string,modifier:string,default_value:string>>, description string, code string"


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, language in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["language"].tolist()):
            for line, name, said, tokens, (first, at, opening, closing, body, last) in _documented(text, language):
                inside, generic = tokens[opening + 1 : closing], tokens[at + 1 : opening]
                kind = _result_type(tokens[first:at])
                typed = _spaced(generic) if "<" in generic else ""
                signature = f"{kind + ' ' if kind else ''}{name}{typed}({_spaced(inside)})" + "".join(f" {t}" for t in tokens[closing + 1 : body] if t in ("const", "&&"))
                rows.append((doc, line, name, language, signature, _parameters(inside, language), said, "".join(tokens[first : last + 1])))
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "name", "language", "signature", "parameters", "description", "code"])


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, text, language in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["language"].tolist()):
            rows += [(doc, found[0], found[1]) for found in _documented(text, language)]
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "name"])


def _files(docs: DataFrame) -> DataFrame:
    of = F.create_map(*[F.lit(x) for pair in sorted(SUFFIXES.items()) for x in pair])
    return docs.select("doc_id", of[suffix(F.col("path"))].alias("language"), "text").where(F.col("doc_id").isNotNull() & F.col("language").isNotNull() & (F.length("text") > 0))


def documented_functions(docs: DataFrame) -> DataFrame:
    """Code and description pairs: doc_id, line_no, name, language, signature, parameters, description, code.

    One row per function with a body in the C# and C++ files among ``docs`` (by the suffix of ``path``) that
    parse, whose documentation comment, XML or Doxygen, says something (see ``says_nothing``). line_no is the
    1-based line of the bare name. Functions inside other bodies and in any branch of conditional directives count, each once. Null and empty texts,
    null ids and paths, other files and files that don't parse give none; repeated rows repeat theirs. Other
    columns are ignored. Texts are read in place and not shuffled.
    """
    return _files(docs).mapInPandas(_pairs, _PAIRS)


def documented_names(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and name of ``documented_functions``, without the work for its other columns."""
    return _files(docs).mapInPandas(_names, "doc_id long, line_no int, name string")
