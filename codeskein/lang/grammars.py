"""Grammars and lexers of C# and C++, over one-character token kinds.

The grammars describe what is left after a lexer has settled, as the languages' own rules do by looking ahead,
which angle brackets enclose type arguments and which parentheses are casts, and has folded qualified and generic
names, array ranks, attributes and specifiers into the tokens they belong to.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codeskein.lang.lalr import Parser, Tables, build

#: Stands for a token that is part of its neighbour; the parser doesn't see it.
FOLDED = "_"
#: Stands for a token of a branch of a conditional directive that isn't taken.
DROPPED = "\x02"

CSHARP = """
unit      : item*
item      : typedecl | namespace | stmt | attr
namespace : Z N ; | Z N { item* }
attr      : [ args ]
typedecl  : M* K N parens? bases? where* typebody | M* E N bases? { enumlist? } ;? | M* G type N parens where* ;
bases     : ':' base | bases , base
base      : N | N parens
where     : H N ':' limit | where , limit
limit     : N | K | E | D | W parens
typebody  : { member* } ;? | ;
enumlist  : enumitem | enumlist , enumitem | enumlist ,
enumitem  : attr* N | attr* N = expr
member    : attr | typedecl | M* method
method    : decl ; | type N parens where* body | N parens chain? body | P N parens body
          | type N accessors | type N accessors = value ; | type N A expr ; | type N index accessors | type N index A expr ;
index     : [ args ]
chain     : ':' N parens
body      : block | A expr ; | ;
accessors : { accessor+ }
accessor  : attr* M* N body
type      : N | parens
block     : { stmt* }
stmt      : block | ; | expr ; | decl ; | M+ decl ; | function
          | i parens stmt | i parens stmt e stmt | w parens stmt | d stmt w parens ;
          | f ( forinit? ; expr? ; exprs? ) stmt | F ( type N n expr ) stmt | F ( expr n expr ) stmt
          | s parens { section* } | N ':' stmt | r ; | r expr ; | b ; | g N ; | g c expr ; | g D ; | h ;
          | t block catch+ | t block catch* y block | u parens stmt | u expr ; | u M expr ; | u decl ; | k parens stmt | k block
section   : c pattern ':' | c pattern Q expr ':' | D ':' | stmt
catch     : C block | C parens block | C parens Q parens block | C Q parens block
forinit   : exprs | decl
exprs     : expr | exprs , expr
decl      : type N | type N = value | decl , N | decl , N = value
function  : M* type N parens where* block | M* type N parens where* A expr ;
value     : expr | init
expr      : tern | tern = value | tern A expr | tern A block | query
tern      : bin | bin ? expr ':' expr
bin       : unary | bin op unary | bin z pattern | bin Y unary | bin Y | Y unary | Y
op        : + | * | & | B | R
unary     : postfix | prefix unary
prefix    : + | * | & | P | I | h
postfix   : primary | postfix . N | postfix parens | postfix [ args ] | postfix I | postfix s { arms } | postfix s { } | postfix v init
primary   : N | L | parens | D | [ args ] | [ ] | G block | G parens block
          | W N parens | W N parens init | W N init | W N [ args ] | W N [ args ] init | W parens | W parens init | W [ ] init | W init | W [ args ] init
parens    : ( ) | ( args )
args      : arg | args , arg
arg       : expr | type N | type N = expr | N ':' expr
init      : { } | { inits } | { inits , }
inits     : value | inits , value
arms      : arm | arms , arm | arms ,
arm       : pattern A expr | pattern Q expr A expr
pattern   : patterm | pattern a patterm
patterm   : unary | unary N | R unary | l patterm | props | props N | unary props | unary props N | unary op unary
props     : { } | { proplist } | { proplist , }
proplist  : N ':' pattern | proplist , N ':' pattern
query     : q clause | query q clause
clause    : exprs | N n expr | N N n expr
"""

CPP = """
unit      : item*
item      : member | Z N? { item* } | Z N = N ; | L { item* } | L member
member    : ; | class ; | class declarators ; | enum ; | enum declarators ; | u expr ; | u Z N ; | u N = value ;
          | p ':' | func | dtype declarators ; | macro ;
class     : K N? bases? { member* } | K N
enum      : E K? N? { enumlist? } | E K? N? ':' N { enumlist? } | E K? N ':' N | E K? N
bases     : ':' base | bases , base
base      : p? N
enumlist  : enumitem | enumlist , enumitem | enumlist ,
enumitem  : N | N = expr
bits      : ':' expr
dtype     : N | N ptrs
ptrs      : ptr+
ptr       : * | & | V
declarators : declarator | declarators , ptrs? declarator
declarator  : N | N = value | N init | N index+ | N index+ = value | N index+ init | N bits | N bits = value | N bits init
          | N parens | N parens suffix | N parens = value | N parens suffix = value | N parens parens
macro     : N parens | N parens suffix | N parens = value | N parens parens | N parens parens = value | P N parens | P N parens = value | N
index     : [ ] | [ expr ]
suffix    : . dtype | & | V
func      : dtype N parens suffix? block | N parens suffix? minits? block | P N parens block | N parens parens block
minits    : ':' minit | minits , minit
minit     : N parens | N init
block     : { stmt* }
stmt      : block | ; | exprs ; | decl ; | i cond stmt | i cond stmt e stmt | w cond stmt | d stmt w parens ;
          | f ( forinit? ; expr? ; exprs? ) stmt | f ( range ':' value ) stmt | f ( forinit ; range ':' value ) stmt | s cond stmt | c expr ':' | D ':' | N ':' stmt
          | r ; | r value ; | b ; | g N ; | t block catch+ | class ; | class declarators ; | enum ; | enum declarators ; | u expr ; | u Z N ; | u N = value ; | Z N = N ;
catch     : C parens block
cond      : parens | ( forinit? ; arg )
forinit   : exprs | decl
range     : N N | bin
exprs     : expr | exprs , expr
decl      : N N | N N = value | N N init | N N parens | N N index+ | N N index+ = value | N N index+ init | N N parens parens
          | decl , ptrs? N | decl , ptrs? N = value | decl , ptrs? N init | decl , ptrs? N parens | decl , ptrs? N index+ | decl , ptrs? N index+ = value
value     : expr | init
expr      : tern | tern = value | h
tern      : bin | bin ? expr ':' expr
bin       : unary | bin op unary
op        : + | * | & | V | B | R
unary     : postfix | prefix unary
prefix    : + | * | & | V | P | I | h | W
postfix   : primary | postfix . N | postfix parens | postfix [ args ] | postfix I
primary   : N | L | parens | N init | lambda
lambda    : lamhead block | lamhead parens block | lamhead parens . dtype block
lamhead   : [ ] | [ args ]
parens    : ( ) | ( args )
args      : arg | args , arg
arg       : value | N N | N N = value | N N index+
init      : { } | { inits } | { inits , }
inits     : value | . N = value | inits , value | inits , . N = value
"""

# The words and operators of the two languages, by token kind. Words that are only sometimes keywords
# have digits as kinds, which the rules below settle.
_CSHARP_WORDS = {
    "M": "public private protected internal static readonly sealed abstract virtual override extern unsafe const volatile event implicit explicit",
    "K": "class struct interface", "E": "enum", "Z": "namespace", "W": "new stackalloc", "G": "delegate", "O": "operator",
    FOLDED: "ref out params", "n": "in", "i": "if", "e": "else", "w": "while", "f": "for", "F": "foreach", "d": "do", "s": "switch", "c": "case",
    "D": "default", "r": "return", "b": "break continue", "g": "goto", "h": "throw", "t": "try", "C": "catch", "y": "finally", "u": "using", "k": "lock fixed",
    "L": "true false null", "z": "is", "B": "as", "H": "where",
    "0": "this", "1": "record", "2": "partial required", "3": "when", "4": "with", "5": "and or", "6": "not", "7": "async", "8": "await", "9": "yield", "!": "checked unchecked",
}
_CPP_WORDS = {
    FOLDED: "const volatile static inline constexpr virtual explicit extern mutable friend typename register thread_local constinit consteval typedef override final",
    "T": "int long short char unsigned signed double float bool void wchar_t char8_t char16_t char32_t",
    "K": "class struct union", "E": "enum", "Z": "namespace", "W": "new", "O": "operator", "p": "public private protected", "X": "template",
    "i": "if", "e": "else", "w": "while", "f": "for", "d": "do", "s": "switch", "c": "case", "D": "default", "r": "return co_return", "b": "break continue", "g": "goto",
    "h": "throw", "t": "try", "C": "catch", "u": "using", "L": "true false nullptr", "P": "delete sizeof co_await co_yield alignof", "B": "and or xor bitand bitor",
    "J": "alignas __declspec __attribute__", "j": "decltype", "9": "noexcept",
}
_OPERATORS = {
    "+": "+ -", "*": "*", "&": "&", "B": "/ % == != || | ^ <<", "<": "<", ">": ">", "R": "<= >=", "I": "++ --", "=": "= += -= *= /= %= &= |= ^= <<=",
    "?": "?", ":": ":", ",": ",", ";": ";", ".": ". ->", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
_CSHARP_OPERATORS = _OPERATORS | {"B": _OPERATORS["B"].replace("^ ", "") + " && ??", "U": "^", "=": _OPERATORS["="] + " ??=", "A": "=>", "Y": "..", ".": ". -> ?. ::", "P": "~", "X": "!"}
_CPP_OPERATORS = _OPERATORS | {"B": _OPERATORS["B"] + " <=> .* ->*", "P": "~ !", "V": "&&", "x": "::", "Y": "..."}
#: Words of query expressions, kind q inside a query.
_QUERY_WORDS = frozenset("from where select orderby let join on equals into group by".split())
_QUERY = re.compile(r"\bfrom\s+\w+(?:\s+\w+)?\s+in\b")

_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_CSHARP_TOKEN = re.compile(
    rf"""\s+|[^\W\d]\w*|[;,(){{}}\[\]]|{_COMMENT}|\#[^\n]*
    |(?:\$+@?|@\$?)?"{{3,}}(?:[^"]|"{{1,2}}(?!"))*"{{3,}}
    |(?:\$@|@\$|@)"(?:[^"]|"")*"
    |\$"(?:[^"\\\n{{]|\\.|\{{\{{|\{{(?:[^{{}}"\n]|"(?:[^"\\\n]|\\.)*"|\{{[^{{}}]*\}})*\}})*"
    |"(?:[^"\\\n]|\\.)*"(?:u8)?|'(?:[^'\\\n]|\\[^\n][^'\n]*)'
    |@[^\W\d]\w*|\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?|\.\d\w*
    |\?\?=?|\?\.(?!\d)|=>|::|->|\.\.|\+\+|--|<<=|<<|[-+*/%&|^!=<>]=|&&|\|\||[\s\S]""",
    re.X,
)
_CPP_RAW = r"""(?:u8|[uUL])?R"([^()\s\\]{0,16})\([\s\S]*?\)\1"|"""
_CPP_REST = rf"""(?:u8|[uUL])(?:"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\.[^'\n]*)')|[^\W\d]\w*|[;,(){{}}\[\]]|{_COMMENT}
    |\#(?:[^\n\\/]|\\\r?\n|\\[^\n]|/(?!\*)|/\*[\s\S]*?\*/)*
    |"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\.[^'\n]*)'
    |\.?\d(?:[eEpP][+-]|'?[\w.])*
    |<=>|->\*?|::|\.\.\.|\.\*|\+\+|--|<<=|<<|[-+*/%&|^!=<>]=|&&|\|\||[\s\S]"""
_CPP_TOKEN = re.compile(rf"\s+|{_CPP_REST}", re.X)
_CPP_RAW_TOKEN = re.compile(rf"\s+|{_CPP_RAW}{_CPP_REST}", re.X)


def tokens_of(text: str, language: str) -> list[str]:
    """The text cut into tokens, comments and runs of white space; joined they are the text again."""
    if language == "CSharp":
        return _CSHARP_TOKEN.findall(text)
    return [m.group() for m in _CPP_RAW_TOKEN.finditer(text)] if 'R"' in text else _CPP_TOKEN.findall(text)


#: Names that may stand for a macro that decorates a declaration.
_MACRO = re.compile(r"[A-Z]_[A-Z]|(?:EXPORT|IMPORT|API|INLINE|NOEXCEPT|DEPRECATED)$")


class _Kinds(dict):
    """Kind of a token by its text; what isn't a known word is classified by its first characters."""

    macros = False

    def __missing__(self, token: str) -> str:
        c = token[0]
        if c.isspace() or token[:2] in ("//", "/*"):
            kind = FOLDED if token != "/*" else "\x01"
        elif c == "#":
            kind = "#"
        elif c in "\"'$@" or (token[-1] in "\"'" and len(token) > 2):
            kind = "S" if len(token) > 1 and (token[-1] in "\"'" or token.endswith('"u8')) else "N" if c == "@" and len(token) > 1 else "\x01"
        elif c.isalpha() or c == "_":
            kind = "m" if self.macros and token.isupper() and _MACRO.search(token) else "N"
        elif c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
            kind = "L"
        else:
            kind = "\x01"  # belongs to no token
        if len(self) < 200_000 and len(token) < 60:
            self[token] = kind
        return kind


def _table(words: dict[str, str], operators: dict[str, str]) -> _Kinds:
    return _Kinds({w: k for group in (words, operators) for k, text in group.items() for w in text.split()})


_KINDS = {"CSharp": _table(_CSHARP_WORDS, _CSHARP_OPERATORS), "Cpp": _table(_CPP_WORDS, _CPP_OPERATORS)}
_KINDS["Cpp"].macros = True
_DIRECTIVE = re.compile(r"#\s*(\w*)")


def _branches(kinds: list[str], tokens: list[str], last: bool) -> bool:
    """Folds directives and drops all branches of conditionals but the first, or the last; False if they don't match up."""
    at: list[list] = []  # per open conditional its branch's number and whether #else was seen
    spans: list[tuple[int, int, list]] = []
    opened = -1
    for i in [i for i, k in enumerate(kinds) if k == "#"]:
        kinds[i] = FOLDED
        word = _DIRECTIVE.match(tokens[i])[1]
        if word not in ("if", "ifdef", "ifndef", "else", "elif", "elifdef", "elifndef", "endif"):
            continue
        spans.append((opened, i, [(x, x[0]) for x in at]))
        opened = i
        if word.startswith("if"):
            at.append([0, False])
        elif not at or (word != "endif" and at[-1][1]):
            return False
        elif word == "endif":
            at.pop()
        else:
            at[-1][0] += 1
            at[-1][1] = word == "else"
    if at:
        return False
    for a, b, inside in spans:
        if any(branch != (x[0] if last else 0) for x, branch in inside):
            kinds[a + 1 : b] = DROPPED * (b - a - 1)
    return True


def readings(tokens: list[str], language: str) -> list[list[str]]:
    """The tokens' kinds in every reading that parses, the one of ``analyse`` first; none if that doesn't.

    Each branch of each conditional directive is in one of the readings: reading r takes the r-th way through every
    conditional, nested ones within their branch.
    """
    plain = _plain(tokens, language)
    kinds, error = _judged(tokens, plain, language, placed=False)
    if error is not None:
        return []
    out = [kinds]
    if DROPPED not in kinds:
        return out
    directives = [i for i, k in enumerate(plain) if k == "#"]
    # a part is a list of conditionals, a conditional a list of branches (first token, end, part)
    root: list = []
    parts, opened = [root], []
    for i in directives:
        word = _DIRECTIVE.match(tokens[i])[1]
        if word.startswith("if") and word in ("if", "ifdef", "ifndef"):
            parts[-1].append([])
            opened.append(i)
            parts.append([])
        elif word == "endif" or word in ("else", "elif", "elifdef", "elifndef"):
            parts[-2][-1].append((opened[-1] + 1, i, parts.pop()))
            if word == "endif":
                opened.pop()
            else:
                opened[-1] = i
                parts.append([])

    def ways(part: list) -> int:
        return max((sum(ways(inner) for _, _, inner in branches) for branches in part), default=1)

    def take(part: list, r: int, kinds: list[str]) -> None:
        for branches in part:
            left, taken = min(r, sum(ways(inner) for _, _, inner in branches) - 1), False
            for a, b, inner in branches:
                n = ways(inner)
                if not taken and left < n:
                    take(inner, left, kinds)
                    taken = True
                else:
                    kinds[a:b] = DROPPED * (b - a)
                left -= n

    for r in range(ways(root)):
        other = list(plain)
        for i in directives:
            other[i] = kinds[i]
        take(root, r, other)
        if other not in out and parser(language).error_at(_folded("".join(other).replace(FOLDED, "").replace(DROPPED, ""), language)) < 0:
            out.append(other)
    return out


def _query_kinds(kinds: list[str], tokens: list[str]) -> None:
    inside = False
    for i, t in enumerate(tokens):
        if t == "from" and kinds[i] == "N":
            rest = [k for k in kinds[i + 1 : i + 9] if k != FOLDED]
            inside = inside or rest[:2] == ["N", "n"] or rest[:3] == ["N", "N", "n"]
        elif t == ";":
            inside = False
        if inside and t in _QUERY_WORDS:
            kinds[i] = "q"
        elif inside and t in ("ascending", "descending"):
            kinds[i] = FOLDED


_GROUP = r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_CS_TYPE = r"n?(?:N|\(NN?(?:,NN?)+\))[?*]*"
_CPP_ARGUMENT = r"(?:[NLK,Y?]|[*&V]+(?=[,>)Y])|\[L?\]|N?\((?:[NLK,Y]|[*&V]+(?=[,)N]))*\))"

Folds = list[tuple[re.Pattern, str, str]]


def _folds(*rules: tuple[str, ...]) -> Folds:
    return [(re.compile(rule[0]), rule[1], rule[2] if len(rule) > 2 else "") for rule in rules]


#: Rules in order; each rule's match becomes its right side. The middle ones are repeated until nothing changes.
#: A third part is what every match holds or stands in: without it in the text a rule isn't tried.
_CS_FIRST = _folds(
    ("S", "L"), (r"(?<=\()0(?=N)", "", "(0N"), ("0", "N", "0"), (r"1(?=K?N[<({:;])", "K", "1"), ("1", "N", "1"), ("KK", "K", "KK"),
    (r"9(?=[rb])", "", "9"), (r"8(?=[Fu])", "", "8"), (r"8(?=[NLW(])", "P", "8"), (r"7(?=NA|G)", "", "7"), (rf"7(?={_GROUP}A)", "", "7("), (r"[27](?=[MNKE27(])", "M"), (r"!(?=\()", "N", "!("), ("!", "k", "!"),
    (r"H(?!N:)", "N", "H"), (r"(?<=[NL)}\]C])3(?=[NL(P+XI])", "Q", "3"), (r"(?<=[N)\]])4(?=\{)", "v", "4{"), (r"(?<=[NL)}\]])5(?=[NL<>R(6{P+\[])", "a", "5"), (r"(?<=[za(,c])6(?=[NL<>R{(])", "l", "6"), ("[2-9]", "N"),
    (r"(?<=[(,])n", "", "n"), (r"M(?=\{)", "k", "M{"), (r"(?<=M)W|W(?=M)", "M", "W"), (r"(?:^|(?<=;))N(?=u)", "", "Nu"),
)
_CS_LOOP = _folds(
    (r"N(?:\.N)+", "N", "N.N"), (r"(?<=[N?)>])(?:\[,*\])+", "", "["), (rf"N<(?:{_CS_TYPE}(?:,{_CS_TYPE})*|,*)>(?=[()\]}}:;,.?B&>\[{{A=N*YHzaQsvnX]|\Z)", "N", "N<"),
    (r"(?<=[N)])\?(?=[),>\[\].]|N[=;,){A:n](?<!:))", "", "?"), (r"(?<=[M;{}\]]N)\?(?=N\()", "", "N?N("),
)
_CS_LAST = _folds(
    (r"(?<=[\[,Y])U", "P", "U"), ("U", "B", "U"), (r">>", "B", ">>"), (r">R", "=", ">R"), (r"(?<=[N)])O[^(]+(?=\()", "N", "O"), (r"O(?=N\()", "", "ON("), (r"(?<=[(,])(?:\[[^\[\]]*\])+(?=[N(])", "", "["),
    (r"(?<=[NL)\]])X(?=[.;,)\]}?:=\[BRA<>&*+])", "", "X"), ("X", "P", "X"), (r"(?<![N)\]iwfFsukCGH])\(N\**\)(?=[NLWDP])", "P", "(N"), ("[<>]", "R"),
)
_CPP_FIRST = _folds(
    (rf"(?:(?<=[;{{}}])|\A)(?:m{_GROUP})+(?=[mNKTXxE}}]|\Z)", "", "m("), (rf"m{_GROUP}(?=[NT]N)", "", "m("), (r"m(?=[NKTxPX])", "", "m"), (r"(?<=[KN>*&])m(?=[NxO])", "", "m"), ("m", "N", "m"),
    ("S+", "L"), ("T+", "N"), (r"\[\[[^\[\]]*\]\]", "", "[["), (rf"J{_GROUP}", "", "J("), (rf"j{_GROUP}", "N", "j("), (rf"9(?:{_GROUP})?", "", "9"), (r"\.X", ".", ".X"),
    (r"X<(?:[^<>;{}]|<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>)*>", "", "X<"), ("X", "", "X"), (r"P\[\]", "P", "P[]"), (r"(?<=[N)>&*VP])Y", "", "Y"), (r"(?<=[\[,])[&=](?=[,\]])", "N"),
)
_CPP_LOOP = _folds((r"(?<![N>])x(?=[NWPO])", "", "x"), (rf"N<{_CPP_ARGUMENT}*>(?=[^L+P]|\Z)", "N", "N<"), (r"N(?:xP?N)+", "N", "Nx"), (r"Nx(?=\*)", "", "Nx*"), (r"(?:Nx)?O(?:\(\)|\[\]|[WP]|L|[-+*&VBRI=P<>.,]+|N[*&]*)(?=\()", "N", "O"))
_CPP_LAST = _folds(
    (r">>", "B", ">>"), (r">R", "=", ">R"), ("Y", "L", "Y"), (r"=[DP](?=;)", "=L"), (r"N\([*&]\)(?=\()", "N", "N("), (r"(?<=N)[*&V]+(?=[,)])", ""), (r"(?<=uN=N)[*&V]+(?=;)", "", "uN=N"), (r"(?<=[(,]N)[*&V]+(?==)", ""), (r"(?<=[(,])E(?=N)", "", "EN"), (r"(?<=N)\[\](?=[,)=])", "", "N[]"), (r"(?<=N)[&V](?=\[N(?:,N)*\][=:])", "", "[N"), (r"pN:", "p:", "pN:"), (r"KN(?=N[{:])", "K", "KNN"), (r"K(?=N[N*&,)>(=])", "", "KN"), (r"W\([^()]*\)(?=N)", "W", "W("),
    (r"(?<![N)\]iwfsCj])\(N[*&V]*\)(?=[NLWP])", "P", "(N"), ("[<>]", "R"),
)
_FOLDS = {"CSharp": (_CS_FIRST, _CS_LOOP, _CS_LAST), "Cpp": (_CPP_FIRST, _CPP_LOOP, _CPP_LAST)}


def _folded(kinds: str, language: str, places: list[int] | None = None) -> str:
    """The kinds after all rules; ``places``, if given, is kept in step with them."""

    def run(rule: tuple[re.Pattern, str, str], kinds: str) -> str:
        pattern, new, needs = rule
        if needs not in kinds:
            return kinds
        if places is not None:
            gone = {i for m in pattern.finditer(kinds) for i in range(m.start() + len(new), m.end())}
            if gone:
                places[:] = [x for i, x in enumerate(places) if i not in gone]
        return pattern.sub(new, kinds)

    first, loop, last = _FOLDS[language]
    for rule in first:
        kinds = run(rule, kinds)
    while True:
        before = kinds
        for rule in loop:
            kinds = run(rule, kinds)
        if kinds == before:
            break
    for rule in last:
        kinds = run(rule, kinds)
    return kinds


@lru_cache(maxsize=2)
def tables(language: str) -> Tables:
    return build(CSHARP if language == "CSharp" else CPP)


@lru_cache(maxsize=2)
def parser(language: str) -> Parser:
    return Parser(tables(language))


def _plain(tokens: list[str], language: str) -> list[str]:
    kinds = list(map(_KINDS[language].__getitem__, tokens))
    if language == "CSharp" and "from" in tokens and "in" in tokens:
        _query_kinds(kinds, tokens)
    return kinds


def analyse(text: str, language: str) -> tuple[list[str], list[str], int | None]:
    """Tokens, their kinds, and the index of the first token at which the text can't go on as ``language``
    (``len(tokens)`` for an early end, None if it is valid).

    Of conditional directives the first branches are taken, else the last ones; tokens of other branches are dropped.
    """
    tokens = tokens_of(text, language)
    return tokens, *_judged(tokens, _plain(tokens, language), language)


def _judged(tokens: list[str], plain: list[str], language: str, placed: bool = True) -> tuple[list[str], int | None]:
    """Kinds and place of ``analyse``; without ``placed`` the place of an error is any number."""
    found = first = None
    for last in (False, True):
        kinds = list(plain)
        if "#" in plain:
            if not _branches(kinds, tokens, last):
                return kinds, plain.index("#")
        elif last:
            break
        bare = "".join(kinds).replace(FOLDED, "").replace(DROPPED, "")
        at = parser(language).error_at(_folded(bare, language))
        if at < 0:
            return kinds, None
        if found is None and not placed:
            found, first = at, kinds
        elif found is None:
            places = [i for i, k in enumerate(kinds) if k not in (FOLDED, DROPPED)]
            _folded(bare, language, places)
            found, first = places[at] if at < len(places) else len(tokens), kinds
    return first, found
