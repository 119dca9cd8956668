"""Generated, minified, vendored and blob files, told from hand-written ones by belief propagation.

Files are leaves and directories inner nodes of one tree per repository; every node has one of LABELS. A file's
evidence, its own text, its name, what projects list, and where else it occurs, gives it a log-likelihood per label; a
directory's name gives it a weak one. Files of one suffix in one directory are siblings: they meet in a node of their
own, to which each is tied by SIBLING, and which is tied to the directory, as directories are to theirs, by COMPATIBLE.
A single sign, such as a namespace of another name, is too weak to decide against a hand-written neighbourhood; it is
enough among siblings or below a directory that speaks for it. As the graph is a tree, one pass of messages up, a
grouped sum per level, and one down, a join per level, give the exact marginals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm.evidence import NAMES, SCHEMA, row
from codeskein.operators.skew import skew_join
from codeskein.session import materialize

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: P(label of a directory or of a group of siblings | label of the directory above), rows and columns as LABELS.
COMPATIBLE = (
    (0.955, 0.015, 0.010, 0.010, 0.010),
    (0.100, 0.840, 0.020, 0.020, 0.020),
    (0.150, 0.020, 0.790, 0.020, 0.020),
    (0.080, 0.020, 0.020, 0.860, 0.020),
    (0.250, 0.020, 0.020, 0.020, 0.690),
)
#: P(label of a file | label of its group of siblings).
SIBLING = (
    (0.940, 0.015, 0.015, 0.015, 0.015),
    (0.080, 0.890, 0.010, 0.010, 0.010),
    (0.080, 0.010, 0.890, 0.010, 0.010),
    (0.060, 0.010, 0.010, 0.910, 0.010),
    (0.120, 0.010, 0.010, 0.010, 0.850),
)
#: P(label of the topmost directory).
ROOT = (0.96, 0.01, 0.01, 0.01, 0.01)

# Directory and file names by convention, with the log-likelihood they add to a label.
GENERATED_DIRECTORIES = ("obj", "gen", "generated", "Generated", "autogen", "codegen", "__generated__")
MINIFIED_DIRECTORIES = ("dist",)
VENDORED_DIRECTORIES = ("third_party", "third-party", "thirdparty", "3rdparty", "vendor", "vendored", "external", "extern", "deps", "lib", "contrib", "packages", "node_modules", "bower_components", "subprojects")
GENERATED_FILE = r"(?i)\.(?:designer|g|g\.i|generated|gen)\.(?:cs|h|cc|cpp|hpp|js)$|[._-]generated\.\w+$|\.pb\.(?:h|cc|cs)$|(?:^|/)(?:moc_|ui_|qrc_)[^/]*$|(?:Model)?Snapshot\.cs$"
MINIFIED_FILE = r"(?i)[._-](?:min|bundle|packed)\.js$"
SAYS = {"tool_line": 4.5, "file_name": 3.5, "listed": 3.0, "numbered": 2.5, "alike": 4.3, "minified": 8.0, "foreign_line": 4.0, "namespace": 3.6, "copies": 4.0, "blob": 7.0, "imports": -2.0, "remarks": -1.5, "directory": 2.0}
#: What it adds to a label's log-likelihood if a file has none of the label's traits.
ABSENT = {"generated": -3.0, "minified": -6.0, "vendored": -2.5, "blob": -5.0}
#: What a namespace adds to "vendored" if it is the project's or the repository's own.
OWN_NAMESPACE = -2.0
#: Texts shorter than this are not looked for in other repositories.
LEAST_COPY = 200


def plain_path(path: Column) -> Column:
    """Slashes for backslashes, without empty and ``.`` segments, each ``..`` taking away the segment before it."""
    segments = F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/")

    def step(kept: Column, s: Column) -> Column:
        above = (s == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
        return F.when(s.isin("", "."), kept).when(above, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def _traits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pd.DataFrame([row(t) for t in pdf["text"]], columns=NAMES)
        for c in ("doc_id", "repo", "path"):
            out[c] = pdf[c].to_numpy()
        yield out


def _message(state: list[Column], table: tuple[tuple[float, ...], ...]) -> list[Column]:
    """log sum over j of exp(state_j) * table[k][j], for every k."""
    out = []
    for line in table:
        terms = [s + F.lit(math.log(p)) for s, p in zip(state, line)]
        top = F.greatest(*terms)
        total = F.exp(terms[0] - top)
        for t in terms[1:]:
            total = total + F.exp(t - top)
        out.append(top + F.log(total))
    return out


_U, _S, _M, _B = ([f"{c}{k}" for k in range(len(LABELS))] for c in "usmb")


def _columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _above(directory: str) -> Column:
    return F.regexp_extract(directory, r"(?s)^(.*)/[^/]*$", 1)


def tree_beliefs(leaves: DataFrame) -> DataFrame:
    """Marginals of the leaves of directory trees: the rows of ``leaves`` with b0.. (log, up to a constant).

    leaves: repo, path (plain) and u0.., a log-likelihood per label. Every repository has a tree of its own, files
    without one share one. A directory is named by its repository, a line break, and its path with a slash before every
    segment. Every level of directories is one grouped sum up and one join down; heavy directories' beliefs are
    broadcast, so a directory with a third of all files is no hot spot.
    """
    parent = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    home = F.concat(F.coalesce("repo", F.lit("")), F.lit("\n"), F.when(parent == "", "").otherwise(F.concat(F.lit("/"), parent)))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    leaves = leaves.withColumn("dir", home).withColumn("group", F.concat("dir", F.lit("\n"), suffix))
    leaves = materialize(leaves.select("*", *[m.alias(n) for n, m in zip(_M, _message(_columns(_U), SIBLING))]))
    sums = [F.sum(m).alias(s) for m, s in zip(_M, _S)]
    groups = leaves.groupBy("group", "dir").agg(*sums)
    groups = materialize(groups.select("*", *[m.alias(n) for n, m in zip(_M, _message(_columns(_S), COMPATIBLE))]))
    own = groups.groupBy("dir").agg(*sums)

    at = F.substring_index("dir", "\n", -1)
    segments = F.filter(F.split(at, "/"), lambda x: x != "")
    repo = F.concat(F.substring_index("dir", "\n", 1), F.lit("\n"))
    above = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda n: F.concat(repo, F.array_join(F.transform(F.slice(segments, F.lit(1), n), lambda x: F.concat(F.lit("/"), x)), "")))
    name = F.regexp_extract(at, r"([^/]*)$", 1)
    says = [F.lit(0.0)] + [F.when(name.isin(*names), SAYS["directory"]).otherwise(0.0) for names in (GENERATED_DIRECTORIES, MINIFIED_DIRECTORIES, VENDORED_DIRECTORIES)] + [F.lit(0.0)]
    prior = own.select(F.explode(above).alias("dir")).distinct().select("dir", *[x.alias(s) for x, s in zip(says, _S)])
    depth = F.size(segments).alias("depth")
    parts = materialize(own.unionByName(prior).groupBy("dir").agg(*[F.sum(s).alias(s) for s in _S]).select("*", depth))
    deepest = parts.agg(F.max("depth")).first()[0]
    kept = [c for c in leaves.columns if c not in ("dir", "group", *_M)]
    if deepest is None:
        return leaves.select(*kept, *[F.col(u).alias(b) for u, b in zip(_U, _B)])

    levels, below = [], None
    for d in range(deepest, -1, -1):
        level = parts.where(F.col("depth") == d).drop("depth")
        if below is not None:
            level = level.unionByName(below).groupBy("dir").agg(*[F.sum(s).alias(s) for s in _S])
        level = materialize(level)
        levels.append(level)
        if d:
            up = _message(_columns(_S), COMPATIBLE)
            below = level.select(_above("dir").alias("dir"), *[m.alias(s) for s, m in zip(_S, up)])

    down = _message([F.col(b) - F.col(m) for b, m in zip(_B, _M)], tuple(zip(*COMPATIBLE)))
    beliefs = [levels.pop().select("dir", *[(F.col(s) + F.lit(math.log(p))).alias(b) for s, b, p in zip(_S, _B, ROOT)])]
    for level in reversed(levels):
        child = level.select("*", *[m.alias(n) for n, m in zip(_M, _message(_columns(_S), COMPATIBLE))]).withColumnRenamed("dir", "child").withColumn("dir", _above("child"))
        told = skew_join(child, beliefs[-1], "dir", "inner")
        beliefs.append(materialize(told.select(F.col("child").alias("dir"), *[(F.col(s) + t).alias(b) for s, t, b in zip(_S, down, _B)])))
    every = beliefs[0]
    for b in beliefs[1:]:
        every = every.unionByName(b)
    told = skew_join(groups, every, "dir", "inner").select("group", *[(F.col(s) + t).alias(b) for s, t, b in zip(_S, down, _B)])
    told = skew_join(leaves, materialize(told), "group", "inner")
    down = _message([F.col(b) - F.col(m) for b, m in zip(_B, _M)], tuple(zip(*SIBLING)))
    return told.select(*kept, *[(F.col(u) + t).alias(b) for u, t, b in zip(_U, down, _B)])


def source_labels(docs: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """The most likely label of every source file's document: doc_id, path, label, probability, p_handwritten, and
    alone, the label that its own evidence would give it in hand-written surroundings.

    docs: doc_id, path, repo, text, holding source files only. sources: doc_id, project (whose name, like the
    repository's, a hand-written file's namespace is expected to start with). projects: generated_sources.
    Null texts count as empty, null paths as "", null ids are left out; empty texts have no evidence of their own.
    Of several rows of a document the longest
    text stands, of as long ones that with the greatest traits. Paths are compared without regard to their style of writing; entries
    of generated_sources that name no document say nothing. Ties go to the earlier of LABELS. Other columns are
    ignored.
    """
    read = docs.select("doc_id", "repo", plain_path(F.coalesce("path", F.lit(""))).alias("path"), "text").where(F.col("doc_id").isNotNull())
    read = read.mapInPandas(_traits, f"{SCHEMA}, doc_id long, repo string, path string")
    seen = materialize(read.groupBy("doc_id").agg(F.max(F.struct(*[c for c in read.columns if c != "doc_id"])).alias("x")).select("doc_id", "x.*"))

    listed = projects.select(F.explode("generated_sources").alias("p")).select(plain_path(F.col("p")).alias("path")).where(F.col("path").isNotNull()).distinct().withColumn("listed", F.lit(True))
    owner = sources.where(F.col("doc_id").isNotNull() & F.col("project").isNotNull()).groupBy("doc_id").agg(F.collect_set(F.lower("project")).alias("owners"))
    big = seen.where((F.col("size") >= LEAST_COPY) & F.col("repo").isNotNull())
    copied = big.groupBy("body", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("body").agg(F.count(F.lit(1)).alias("repos")).where("repos > 1")
    known = skew_join(skew_join(seen.join(owner, "doc_id", "left"), listed, "path", "left"), copied, "body", "left")

    def when(condition: Column, what: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), SAYS[what]).otherwise(0.0)

    script = F.col("path").rlike(r"(?i)\.[cm]?jsx?$")
    silent = ~F.col("imports") & (F.col("remark_share") < 0.01) & ~script & (F.col("size") > 0)
    expected = F.concat(F.coalesce("owners", F.split(F.lower("path"), "/")), F.array(F.lower(F.coalesce("repo", F.lit("")))))
    foreign = (F.col("namespace") != "") & ~F.array_contains(expected, F.col("namespace"))
    data = F.col("markup") | (F.col("record_share") > 0.6) | ((F.col("code_share") < 0.45) & silent) | ((F.col("code_share") < 0.2) & (F.col("statements") < 0.05) & (F.col("size") > 0))
    written = when(F.col("imports"), "imports") + when(F.col("remark_share") >= 0.01, "remarks")
    minified = ~data & (((F.col("line_chars") > 150) & (F.col("space_share") < 0.15)) | ((F.col("short_names") > 0.3) & (F.col("space_share") < 0.12)))

    def summed(label: str, *parts: Column) -> Column:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole + p
        return F.when(whole > 0, whole).otherwise(ABSENT[label])

    own = F.when((F.col("namespace") != "") & ~foreign, OWN_NAMESPACE).otherwise(0.0)
    evidence = [
        F.lit(0.0),
        summed("generated", when(F.col("tool_line"), "tool_line"), when(F.col("path").rlike(GENERATED_FILE), "file_name"), when(F.col("listed"), "listed"), when((F.col("numbered") > 0.03) & silent, "numbered"), when((F.col("alike") > 0.5) & silent, "alike")) + written,
        summed("minified", when(minified & (F.col("size") > 0), "minified"), when(F.col("path").rlike(MINIFIED_FILE), "file_name")),
        summed("vendored", when(F.col("foreign_line"), "foreign_line"), when(foreign, "namespace"), when(F.col("repos") > 1, "copies")) + own,
        summed("blob", when(data, "blob")) + written,
    ]
    leaves = known.select("doc_id", "repo", "path", *[e.cast("double").alias(u) for e, u in zip(evidence, _U)])
    told = tree_beliefs(leaves)
    top = F.greatest(*_columns(_B))
    weights = [F.exp(F.col(b) - top) for b in _B]
    whole = weights[0]
    for w in weights[1:]:
        whole = whole + w
    calm = [sum(SIBLING[k][j] * COMPATIBLE[0][k] for k in range(len(LABELS))) for j in range(len(LABELS))]
    alone = [F.col(u) + F.lit(math.log(p)) for u, p in zip(_U, calm)]

    def likeliest(values: list[Column]) -> Column:
        best, label = F.greatest(*values), F.lit(LABELS[-1])
        for name, v in reversed(list(zip(LABELS[:-1], values[:-1]))):
            label = F.when(v == best, name).otherwise(label)
        return label

    return told.select("doc_id", "path", likeliest(_columns(_B)).alias("label"), F.round(1 / whole, 6).alias("probability"), F.round(weights[0] / whole, 6).alias("p_handwritten"), likeliest(alone).alias("alone"))
