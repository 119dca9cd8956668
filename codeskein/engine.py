"""The nineteen questions a client asks, as methods that return DataFrames or small values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeskein.functions.text import is_test
from codeskein.operators import communities, navigation, search
from codeskein.operators.closure import closure
from codeskein.operators.resolve import symbol_candidates
from codeskein.plans import graph, workspace
from codeskein.plans import navigation as listed
from codeskein.relations import DISPATCH_KINDS, HIERARCHY_KINDS, STRUCTURAL_KINDS, Relations, certain, is_type
from codeskein.sources.files import Annotations
from codeskein.sources.workspace import load_workspace

MOST_CANDIDATES = 20
#: Neighbours of which a context is chosen.
CONTEXT_ROWS = 2000


class Ambiguous(Exception):
    """A name that stands for several declarations; ``candidates`` has up to twenty ids."""

    def __init__(self, name: str, candidates: list[str]):
        super().__init__(f"{name} is ambiguous: {', '.join(candidates)}")
        self.candidates = candidates


class CodeGraph:
    def __init__(self, spark: SparkSession, folder: str, notes: str | None = None):
        self.spark, self.rel = spark, Relations(spark, folder)
        self.notes = Annotations(notes) if notes else None

    def resolve(self, symbol: str) -> int:
        """Node of an id, also in its short forms, of a place (``file:line`` or ``file:line:column``), or of a name."""
        exact = self.rel.symbols.where(F.col("id") == symbol).select("seq").first()
        if exact:
            return exact["seq"]
        asked = self.spark.createDataFrame([(symbol,)], "query string")
        found = symbol_candidates(self.rel, asked).orderBy("id", "node").limit(MOST_CANDIDATES + 1).collect()
        if not found:
            raise KeyError(f"no symbol {symbol}")
        if len(found) > 1:
            raise Ambiguous(symbol, [r["id"] for r in found[:MOST_CANDIDATES]])
        return found[0]["node"]

    def _named(self, nodes: DataFrame, key: str = "node") -> DataFrame:
        return nodes.join(self.rel.symbols.select(F.col("seq").alias(key), "id", "kind", "name", "project", "file"), key)

    def _start(self, node: int) -> DataFrame:
        return self.spark.createDataFrame([(node,)], "node long")

    def workspace_status(self) -> DataFrame:
        return workspace.status(self.rel)

    @classmethod
    def workspace_load(cls, spark: SparkSession, root: str, folder: str, notes: str | None = None, configuration: str = "Debug") -> tuple[CodeGraph, DataFrame]:
        """Read the solution, project or folder at ``root`` into tables below ``folder``: the graph over them, and a
        report per project."""
        report = load_workspace(spark, root, folder, configuration)
        return cls(spark, folder, notes), report

    def diagnostics(self, project: str | None = None, file: str | None = None, limit: int = 50) -> DataFrame:
        found = workspace.problems(self.rel)
        found = found.where(F.col("project") == project) if project else found
        found = found.where(F.lower("path").endswith(file.lower())) if file else found
        return found.orderBy("path", "stage", "message").limit(limit)

    def find_symbol(self, query: str, kind: str | None = None, project: str | None = None, exact: bool = False, limit: int = 50) -> DataFrame:
        return navigation.find_symbol(self.rel, query, kind, project, exact, limit)

    def symbol_info(self, symbol: str) -> DataFrame:
        return listed.symbol_info(self.rel).where(F.col("seq") == self.resolve(symbol))

    def go_to_definition(self, symbol: str) -> DataFrame:
        node = self.resolve(symbol)
        spans = navigation.declared_spans(self.rel).where(F.col("node") == node).groupBy("node").agg(F.min("start").alias("line"))
        return self.rel.symbols.where(F.col("seq") == node).select(F.col("seq").alias("node"), "id", "file", "signature").join(spans, "node", "left")

    def type_members(self, symbol: str, kind: str | None = None, inherited: bool = False, limit: int = 200) -> DataFrame:
        start = self._start(self.resolve(symbol))
        types = closure(start, graph._links(self.rel, HIERARCHY_KINDS)) if inherited else start.withColumn("depth", F.lit(0))
        owners = types.join(self.rel.symbols.select(F.col("seq").alias("node"), F.col("id").alias("container_id")), "node").orderBy("depth", "node").limit(32)
        members = self.rel.symbols.join(owners.select("container_id", "depth"), "container_id")
        members = members.where(F.lower("kind") == kind.lower()) if kind else members
        return members.orderBy("depth", "id").limit(limit).select("container_id", "depth", "id", "kind", "signature")

    def file_outline(self, file: str) -> DataFrame:
        return self._named(navigation.file_outline(self.rel).where(F.col("file") == file).drop("file")).orderBy("start")

    def type_hierarchy(self, symbol: str, transitive: bool = False, limit: int = 100) -> DataFrame:
        start, depth = self._start(self.resolve(symbol)), None if transitive else 1
        up = closure(start, graph._links(self.rel, HIERARCHY_KINDS), depth).withColumn("direction", F.lit("base"))
        down = closure(start, graph._links(self.rel, HIERARCHY_KINDS, reverse=True), depth).withColumn("direction", F.lit("derived"))
        return self._named(up.unionByName(down).where("depth > 0")).orderBy("direction", "depth", "id").limit(limit)

    def find_implementations(self, symbol: str, limit: int = 100) -> DataFrame:
        found = closure(self._start(self.resolve(symbol)), graph._links(self.rel, STRUCTURAL_KINDS, reverse=True))
        return self._named(found.where("depth > 0")).orderBy("depth", "id").limit(limit)

    def _family(self, node: int) -> DataFrame:
        up = closure(self._start(node), graph._links(self.rel, DISPATCH_KINDS))
        return closure(up.select("node"), graph._links(self.rel, DISPATCH_KINDS, reverse=True)).select("node")

    def find_references(self, symbol: str, limit: int = 200, offset: int = 0, implementations: bool = True, name_only: bool = False) -> DataFrame:
        node = self.resolve(symbol)
        family = self._family(node) if implementations else self._start(node)
        refs = navigation.with_caller(self.rel, self.rel.references.where("edge_kind <> 'Contains'").join(family.withColumnRenamed("node", "to_node"), "to_node", "left_semi"))
        refs = refs if name_only else refs.where(certain(F.col("confidence")))
        return refs.orderBy("file", "first_line", "edge_id").offset(max(0, offset)).limit(max(0, limit)).select("edge_id", "caller", "file", "first_line", "confidence", is_test(F.col("file")).alias("is_test"))

    def find_callers(self, symbol: str, limit: int = 50, offset: int = 0, tests: bool = True, name_only: bool = False) -> DataFrame:
        node = self.resolve(symbol)
        called = closure(self._start(node), graph._links(self.rel, DISPATCH_KINDS))
        refs = self.rel.references.where("edge_kind <> 'Contains'").join(called.select(F.col("node").alias("to_node"), (F.col("depth") > 0).alias("indirect")), "to_node")
        refs = navigation.with_caller(self.rel, refs if name_only else refs.where(certain(F.col("confidence"))))
        refs = refs if tests else refs.where(~is_test(F.col("file")))
        return refs.orderBy("file", "first_line", "edge_id").offset(max(0, offset)).limit(max(0, limit)).select("edge_id", "caller", "file", "first_line", "indirect")

    def find_callees(self, symbol: str, external: bool = True, limit: int = 100) -> DataFrame:
        found = navigation.callees(self.rel).where(F.col("from_node") == self.resolve(symbol))
        found = found if external else found.where("place <> 'external'")
        return found.orderBy(F.desc(F.col("place") == "workspace"), "first_line", "target").limit(limit)

    def search_code(self, query: str, kind: str | None = None, project: str | None = None, limit: int = 20, tests: bool = True) -> DataFrame:
        asked = self.spark.createDataFrame([(query,)], "query string")
        ranks = graph.rank_percentile(self.rel).select("node", "percentile")
        found = self._named(search.bm25(self.rel, asked, ranks).drop("id"))
        for column, value in (("kind", kind), ("project", project)):
            found = found.where(F.lower(column) == value.lower()) if value else found
        found = found if tests else found.where(~is_test(F.col("file")))
        return found.orderBy(F.desc("score"), "id").limit(min(200, max(1, limit)))

    def get_context(self, symbol: str, depth: int = 1, token_budget: int = 4000) -> DataFrame:
        """Neighbours within ``depth`` steps in order of distance, relation and weight, as long as their code, or else
        signature, fits the budget; one that doesn't fit is skipped and the scan goes on. A type starts with its members;
        at most CONTEXT_ROWS neighbours are looked at, in that order."""
        start = self._start(self.resolve(symbol))
        owners = start.join(self.rel.symbols.where(is_type(F.col("kind"))).select(F.col("seq").alias("node"), F.col("id").alias("container_id")), "node")
        seeds = start.unionByName(self.rel.symbols.join(owners.select("container_id"), "container_id").select(F.col("seq").alias("node")))
        ranks = graph.rank_percentile(self.rel).select("node", "percentile")
        near = graph.context_hops(self.rel, seeds, min(3, max(1, depth)), ranks)
        near = self._named(near).join(self.rel.symbols.select("id", "signature", "summary"), "id").join(search.bodies(self.rel), "node", "left")
        text = F.coalesce("body", F.concat(F.coalesce("signature", F.lit("")), F.coalesce("summary", F.lit(""))))
        size = F.floor((80 + F.length(text)) / 4).cast("long")
        rows = near.withColumn("tokens", size).orderBy("depth", "priority", F.desc("weight"), "id").limit(CONTEXT_ROWS)
        key = F.struct("depth", "priority", (-F.col("weight")).alias("light"), "id", "kind", "relation", "tokens", F.coalesce("body", "signature").alias("code"))
        folded = rows.agg(F.array_sort(F.collect_list(key)).alias("x"))
        none = F.array().cast("array<struct<depth:int,priority:int,light:double,id:string,kind:string,relation:string,tokens:bigint,code:string>>")
        first = F.struct(F.lit(0).cast("long").alias("used"), none.alias("taken"))
        taken = F.aggregate("x", first, lambda a, e: F.when(a["used"] + e["tokens"] <= token_budget, F.struct((a["used"] + e["tokens"]).alias("used"), F.concat(a["taken"], F.array(e)).alias("taken"))).otherwise(a))
        return folded.select(F.explode(taken["taken"]).alias("e")).select("e.depth", "e.priority", (-F.col("e.light")).alias("weight"), "e.id", "e.kind", "e.relation", "e.tokens", "e.code")

    def impact_analysis(self, symbol: str, depth: int = 3, name_only: bool = False, limit: int = 100) -> DataFrame:
        node = self.resolve(symbol)
        members = self.rel.edges.where((F.col("edge_kind") == "Contains") & (F.col("from_node") == node)).select(F.col("to_node").alias("node"))
        followed = self.rel.edges.where(F.col("edge_kind") != "Contains")
        followed = followed if name_only else followed.where(F.col("edge_kind").isin(*STRUCTURAL_KINDS) | certain(F.col("confidence")))
        reached = closure(self._start(node).unionByName(members), followed.select(F.col("to_node").alias("src"), F.col("from_node").alias("dst")), min(10, max(1, depth)))
        ranked = self._named(reached.where("depth > 0")).join(graph.page_rank(self.rel), "node", "left")
        return ranked.orderBy("depth", F.desc("rank"), "id").limit(limit)

    def find_path(self, start: str, end: str, max_depth: int = 8) -> DataFrame:
        """One shortest path: node and step; forward, else reverse, else empty. A type counts only as the last step."""
        a, b = self.resolve(start), self.resolve(end)
        into_type = self.rel.edges.where((F.col("edge_kind") == "ReferencesType") & certain(F.col("confidence")))
        for source, target in ((a, b), (b, a)):
            last = into_type.where(F.col("to_node") == target).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
            links = graph.forward_edges(self.rel).unionByName(last)
            reached = closure(self._start(source), links, min(20, max(1, max_depth)))
            hit = reached.where(F.col("node") == target).first()
            if hit:
                steps, at = [(hit["depth"], target)], target
                for d in range(hit["depth"] - 1, -1, -1):  # a path has at most twenty steps
                    before = links.where(F.col("dst") == at).join(reached.where(F.col("depth") == d).select(F.col("node").alias("src")), "src").agg(F.min("src")).first()[0]
                    steps.append((d, before))
                    at = before
                return self._named(self.spark.createDataFrame(sorted(steps), "step int, node long")).orderBy("step")
        return self._named(self.spark.createDataFrame([], "step int, node long"))

    def module_map(self) -> dict[str, DataFrame]:
        return {"projects": graph.types_by_project(self.rel), "namespaces": graph.namespace_topk(self.rel), "communities": graph.louvain(self.rel), "links": communities.community_links(self.rel), "entry_points": graph.entry_points(self.rel)}

    def annotate(self, target: str, note: str | None = None) -> str | None:
        if self.notes is None:
            raise ValueError("no notes file was given")
        if note is not None:
            self.notes.set(target, note)
        return self.notes.get(target)
