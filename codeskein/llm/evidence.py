"""What a file's own text and name say about who wrote it: measurable traits, no verdict."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import astuple, dataclass, fields

import xxhash

_HEAD_COMMENT = re.compile(r"\A﻿?(?:\s+|//[^\n]*(?:\n|\Z)|/\*.*?\*/|#!?(?![ \t]*(?:include|pragma|if|define|import|error|undef|line))[^\n]*\n)*", re.S)
_LEAD = r"^[ \t]*(?:///?!?|/\*+!?|\*+|\#|;|--|<!--)?[-=*# \t]*"
# How tools open what they write, in English, German and Spanish. Each must open its comment line;
# a sentence that only mentions such a line doesn't.
_TOOL_LINE = re.compile(
    _LEAD
    + r"""(?:<auto-?\s?generated|@generated\b
    |(?:warning[:!]?\s+)?(?:this\s+(?:code|file|source(?:\s+file)?|class|module|document)\s+(?:was|is|has\s+been)\s+)?(?:auto(?:matically)?[-\s]?|machine[-\s])?(?:code\s+)?(?:re)?(?:generated|produced)\s+(?:automatically\s+)?(?:by|from|with|using)\s
    |(?:auto|machine)[-\s]?(?:generated|written)\b|automatically\s+(?:generated|produced|created)|(?:begin|start)\s+of\s+generated\b
    |(?:dieser?\s+\S+\s+(?:wurde|ist)\s+)?(?:automatisch|maschinell)\s+(?:erzeugt|generiert|erstellt)|(?:generado|creado|producido)\s+autom[aá]ticamente|(?:archivo|c[oó]digo)\s+generado)""",
    re.I | re.M | re.X,
)
# How copied files name where they come from.
_FOREIGN_LINE = re.compile(
    _LEAD
    + r"""(?:copyright\s+(?:\(c\)\s*|©\s*)?(?:[\d,\s-]+\s+)?(?:by\s+)?the\s+(\w+)\s+(?:contributors|authors|developers|project|team)
    |(?:imported|copied|taken|adapted|vendored|mirrored|synced)\s+from\s+(?:upstream\s+)?(\w+)
    |(?:this\s+is\s+)?a?\s*(?:verbatim|unmodified|vendored)\s+copy
    |lib\w+\s+v?\d+[.\d]*\s*$|\w+\s+v?\d+(?:\.\d+)+\s*(?:\*/)?\s*$)""",
    re.I | re.M | re.X,
)
_NAMESPACE = re.compile(r"^[ \t]*(?:inline[ \t]+)?namespace[ \t]+([^\W\d]\w*)", re.M)
_DEFINED = re.compile(r"\bnamespace\s+([^\W\d]\w*)")
_IMPORT = re.compile(r"^\W*(?:\d+\s+)?(?:(?:global\s+)?using\s+(?:static\s+)?[\w.]+\s*[;=]|#\s*include\b|import\s|from\s+\S+\s+import\b)|^using\s[\w.]+;|\brequire\(|^\W*'use strict'", re.M)
_WORD = re.compile(r"[^\W\d]\w*")
_NUMBERED = re.compile(r"\b([^\W\d]\w*?)(\d+)\b")
_NUMBER = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfFdDmM]*\b")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")


@dataclass
class Traits:
    """imports: it has a using, include or import line. tool_line, foreign_line: the leading comment holds such a line. code_share: of what is no white space or
    comment, the part in words and punctuation rather than literals and encoded runs. record_share: lines of the
    commonest field count above one among all, for text without statements. markup: it opens as JSON. line_chars: mean length of a line. space_share: white space among all characters. short_names:
    names of one letter among all names. numbered: names that end in running numbers among all names. alike:
    lines whose shape, names and numbers blanked, occurs at least four times. remark_share: characters in
    comments. namespace: the first one's root, lower case, or "". statements: lines that end in ;, { or }. body: a hash of all after the leading comment, white space folded.
    """

    size: int
    imports: bool
    tool_line: bool
    foreign_line: bool
    code_share: float
    record_share: float
    markup: bool
    line_chars: float
    space_share: float
    short_names: float
    numbered: float
    alike: float
    remark_share: float
    statements: float
    namespace: str
    body: int


SCHEMA = "size long, imports boolean, tool_line boolean, foreign_line boolean, code_share double, record_share double, markup boolean, line_chars double, space_share double, short_names double, numbered double, alike double, remark_share double, statements double, namespace string, body long"


def traits(text: str) -> Traits:
    text = text.replace("\r\n", "\n")
    head = _HEAD_COMMENT.match(text)[0]
    rest = text[len(head) :]
    bare = _COMMENT.sub(" ", rest)
    remarks = len(rest) - len(bare)
    n = max(1, len(text))
    spaces = n - len("".join(text.split())) if text else 0
    lines = [x for x in bare.split("\n") if x.strip()]
    names = _WORD.findall(bare)
    count = max(1, len(names))
    stripped = _STRING.sub('""', bare)
    solid = max(1, len("".join(bare.split())))
    strings = len(bare) - len(stripped)
    numbers = sum(len(x) for x in _NUMBER.findall(stripped))
    encoded = sum(len(x) for x in _ENCODED.findall(stripped) if sum(map(str.isdigit, x)) > 1 and not x.isupper() and not x.islower() and "_" not in x.strip("_"))
    numbered: dict[str, set[int]] = {}
    for stem, digits in _NUMBERED.findall(stripped):
        if len(digits) < 7:
            numbered.setdefault(digits, set()).add(hash(stem))
    running = 0
    while str(running) in numbered or (running == 0 and "1" in numbered):
        running += 1
    in_run = sum(1 for _, d in _NUMBERED.findall(stripped) if len(d) < 7 and int(d) < running) if running > 3 else 0
    shapes = Counter(re.sub(r"\s+", "", re.sub(r"\d+", "0", re.sub(r"[^\W\d]\w*", "w", x))) for x in _STRING.sub('""', bare).split("\n") if len(x.strip()) > 4)
    alike = sum(c for s, c in shapes.items() if c > 3) / max(1, sum(shapes.values()))
    fields_per_line = Counter(x.count(",") for x in lines)
    common = max(((c, k) for k, c in fields_per_line.items() if k > 0), default=(0, 0))[0]
    endings = sum(x.rstrip()[-1] in ";{}" for x in lines)
    opening = rest.lstrip()[:1]
    space = _NAMESPACE.search(bare) or _DEFINED.search(bare)
    return Traits(
        size=len(text),
        imports=_IMPORT.search(bare) is not None,
        tool_line=_TOOL_LINE.search(head) is not None,
        foreign_line=_FOREIGN_LINE.search(head) is not None,
        code_share=max(0.0, 1 - (numbers + encoded + strings) / solid),
        record_share=common / len(lines) if lines and not endings else 0.0,
        markup=opening in ("[", "{") and re.match(r"[\[{]\s*(?:[\[{\"\d-]|\]|\})", rest.lstrip()) is not None,
        line_chars=len(bare.strip()) / max(1, len(lines)),
        space_share=spaces / n,
        short_names=sum(len(x) == 1 for x in names) / count,
        numbered=in_run / count,
        alike=alike,
        remark_share=remarks / max(1, len(rest)),
        statements=endings / max(1, len(lines)),
        namespace=space[1].lower() if space else "",
        body=xxhash.xxh64_intdigest(" ".join(rest.split())) - (1 << 63),
    )


NAMES = [f.name for f in fields(Traits)]


def row(text: str | None) -> tuple:
    return astuple(traits(text or ""))
