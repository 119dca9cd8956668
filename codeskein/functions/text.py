"""Text functions of name search and ranked search, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the search leaves out; English, then C#, then C++ and Doxygen.
STOP_WORDS = tuple(dict.fromkeys("""
    a an the of to in on at by for from with and or not is are be
    it its this that as if when which what where how do does can into than
    then so no all any each one there they we you i
    public private protected internal static readonly sealed abstract virtual override
    partial const void var return new null true false class struct interface
    record enum namespace using else int bool string object out ref in params
    async await task get set init value see cref summary param name returns
    langword paramref typeparam remarks c para system collections generic linq
    auto const constexpr unsigned signed char long short double float inline extern
    template typename typedef std nullptr noexcept explicit friend operator union
    brief tparam t
""".split()))
LONGEST_TERM = 40

_PARTS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?!\p{Nd})|(?<!\p{Nd})(?=\p{Nd})"


def words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def parts(word: Column) -> Column:
    """A word cut at lower-upper, acronym-word and digit boundaries."""
    return F.filter(F.split(word, _PARTS), lambda x: x != "")


def kept(term: Column) -> Column:
    """Whether a part is indexed: not too long, no stop word, no single letter."""
    return (F.length(term) <= LONGEST_TERM) & ~term.isin(*STOP_WORDS) & ((F.length(term) > 1) | term.rlike(r"^\p{Nd}$"))


def stem(term: Column) -> Column:
    """Light stemmer: plural, -ing and -ed endings, then one final e."""
    n = F.length(term)

    def cut(k: int) -> Column:
        return F.substring(term, F.lit(1), n - k)

    def ends(s: str) -> Column:
        return term.endswith(s)

    def trim(c: Column) -> Column:
        return F.when(c.endswith("e") & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)

    return (
        F.when((n <= 3) | ~term.rlike(r"\p{L}$"), term)
        .when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(ends("sses"), cut(2))
        .when(ends("ing") & (n > 5), trim(cut(3)))
        .when(ends("ed") & (n > 4), trim(cut(2)))
        .when(term.rlike("[sxzh]es$") & (n > 4), trim(cut(2)))
        .when(term.rlike("[^sui]s$"), trim(cut(1)))
        .otherwise(trim(term))
    )


def terms(text: Column) -> Column:
    """All search terms of a text: stemmed parts of its words, and each word of several kept parts as a whole."""
    def of(word: Column) -> Column:
        pieces = F.filter(F.transform(parts(word), F.lower), kept)
        whole = F.lower(word)
        return F.when((F.size(pieces) > 1) & (F.length(whole) <= LONGEST_TERM), F.concat(F.transform(pieces, stem), F.array(whole))).otherwise(F.transform(pieces, stem))

    return F.flatten(F.transform(words(text), of))


def glob_regex(pattern: str) -> str:
    """``**/`` any directories, ``*`` and ``?`` within one, anchored, case ignored."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c) if not c.isalnum() and c not in "/_" else c), i + 1
    return f"(?i)^{out}$"


def name_regex(pattern: str) -> str:
    """A name pattern with ``*`` and ``?``, anchored, case ignored."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


#: Paths of tests: a segment that ends in Test or Tests.
TEST_PATH = r"(?i)(?:^|[\\/])[^\\/]*Tests?(?:[\\/.]|$)"


def is_test(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_PATH)
