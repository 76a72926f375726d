"""The library: index trees, keep the index, ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, graph, overlay, ranking
from .plans.index import FINGERPRINT, Index, build
from .store import SnapshotStore, find_store, leave_pointer

# How much each answer shows unless asked otherwise.
IMPACT, REVIEW, LOCATE, SEARCH, NEIGHBORS_DEPTH, NEIGHBORS, PATH_DEPTH, PATHS = 20, 15, 10, 30, 1, 50, 6, 3


class Engine:
    """Answers over one index. Every answer is a DataFrame with its rank and how many there were before the cut."""

    def __init__(self, spark: SparkSession, index: Index):
        self.spark, self.index = spark, index
        self.nodes, self.edges = index.nodes, index.edges

    @classmethod
    def index_roots(cls, spark: SparkSession, roots: list[str], history: DataFrame | None = None, store: str | None = None) -> Engine:
        """Indexes trees; with a store, unchanged files keep their facts and the result is saved there."""
        saved = SnapshotStore(spark, store) if store else None
        previous = None
        if saved is not None and (facts := saved.read("facts", FINGERPRINT)) is not None:
            previous = Index(saved.read("nodes"), saved.read("edges"), facts, saved.read("stamps"))
        index = build(spark, roots, history, previous)
        if saved is not None:
            saved.write({"nodes": index.nodes, "edges": index.edges, "facts": index.facts, "stamps": index.stamps}, FINGERPRINT)
            for root in roots[1:]:
                leave_pointer(spark, root, store)
        return cls(spark, index)

    @classmethod
    def load(cls, spark: SparkSession, store: str) -> Engine:
        saved = SnapshotStore(spark, find_store(spark, store))
        tables = [saved.read(t) for t in ("nodes", "edges", "facts", "stamps")]
        if any(t is None for t in tables):
            raise FileNotFoundError(f"no index at {store}")
        return cls(spark, Index(*tables))

    def lookup(self, query: str, in_file: str | None = None) -> DataFrame:
        nodes = graph.in_file(self.nodes, in_file) if in_file else self.nodes
        return graph.lookup(nodes, query).orderBy("module_path", "start_line", "key")

    def impact(self, query: str, budget: int | None = IMPACT, in_file: str | None = None) -> DataFrame:
        seeds = self.lookup(query, in_file).select(F.lit(query).alias("seed"), "key")
        return graph.impact(self.nodes, self.edges, seeds, budget).orderBy("rank")

    def neighbors(self, query: str, direction: str = "out", kinds: list[str] | None = None, depth: int = NEIGHBORS_DEPTH, limit: int = NEIGHBORS) -> DataFrame:
        hops = graph.neighbors(self.edges, self.lookup(query), direction, kinds, depth)
        return hops.groupBy("depth", "src", "dst", "kind").agg(F.count("*").alias("sites")).orderBy("depth", "src", "dst", "kind").limit(limit)

    def path(self, start: str, goal: str, depth: int = PATH_DEPTH, limit: int = PATHS) -> DataFrame:
        a, b = (self.lookup(q).select(F.col("key").alias(n)) for q, n in ((start, "start"), (goal, "goal")))
        return graph.paths(self.edges, a.crossJoin(b), depth, limit).orderBy("hops", "rank")

    def is_reachable(self, start: str, goal: str, depth: int = PATH_DEPTH) -> bool:
        return not self.path(start, goal, depth, 1).isEmpty()

    def locate(self, task: str, budget: int = LOCATE) -> DataFrame:
        return ranking.locate_with_preview(self.nodes, self.edges, task, budget).orderBy("rank")

    def search(self, query: str, limit: int = SEARCH) -> DataFrame:
        return ranking.search(self.nodes, query, limit)

    def review(self, changed: DataFrame, budget: int | None = REVIEW, scope: str = "") -> DataFrame:
        """changed: module_path, from_line, to_line."""
        first = self.nodes.select("key", "module_path", "start_line", "end_line")
        more = self.nodes.select("key", "module_path", F.explode("extra_spans").alias("s")).select("key", "module_path", "s.start_line", "s.end_line")
        return ranking.review(self.nodes, self.edges, first.unionByName(more), changed, budget, scope).orderBy("rank")

    def missing_cochange(self, changed: DataFrame) -> DataFrame:
        return ranking.missing_cochange(self.nodes.filter("kind = 'Module'").select("key", "module_path"), self.edges, changed)

    def risk(self, query: str | None = None) -> DataFrame:
        rows = self.lookup(query) if query else self.nodes
        return rows.select("key", "module_path", "churn", "bug_density", "ownership", "fanout", "composite").orderBy(F.desc("composite"), "key")

    def explain_edge(self, a: str, b: str) -> DataFrame:
        return graph.explain_edge(self.edges, self.lookup(a), self.lookup(b))

    def imports(self, dep: str) -> bool:
        return graph.imported(self.nodes, self.edges, dep).first()[0]

    def uses(self, dep: str, symbol: str) -> DataFrame:
        return graph.uses(self.nodes, self.edges, dep, symbol)

    def reaches(self, dep: str, symbol: str) -> DataFrame:
        return graph.reaches(self.nodes, self.edges, dep, symbol)

    def evaluate_recall(self, history: DataFrame, k: int = 50, depth: int = 3) -> DataFrame:
        """pairs, static, cochange, fused: how many same-commit file pairs of the k newest commits the graph and older history link."""
        known = self.nodes.select(F.col("module_path").alias("file")).distinct()
        history = history.join(known, "file", "left_semi")
        parts = overlay.holdout(history, k)
        of = lambda p: history.join(parts.filter(F.col("part") == p).select("commit"), "commit", "left_semi")
        reach = evaluation.module_reach(self.nodes, self.edges, of("test").select("file"), ["Calls", "Imports", "GraphqlCall", "DbQuery"], depth)
        return evaluation.cochange_recall(of("test"), reach, overlay.cochange(of("train")))

    def risk_files(self, history: DataFrame, k: int = 50) -> DataFrame:
        """file, churn, bug_density, ownership (from commits before the k newest), fanout (the most of its symbols), fixed (whether a fix among the k touches it)."""
        parts = overlay.holdout(history, k)
        of = lambda p: history.join(parts.filter(F.col("part") == p).select("commit"), "commit", "left_semi")
        risk = overlay.file_risk(overlay.file_stats(of("train"))).select("file", "churn", "bug_density", "ownership")
        most = self.nodes.groupBy(F.col("module_path").alias("file")).agg(F.max("fanout").alias("fanout"))
        fixed = of("test").filter("is_fix").select("file").distinct().withColumn("fixed", F.lit(True))
        return risk.join(most, "file").join(fixed, "file", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))

    def evaluate_risk(self, history: DataFrame, k: int = 50, weights: tuple[float, ...] | None = None) -> DataFrame:
        """Precision and lift of every risk term; with weights, of their blend."""
        files = self.risk_files(history, k)
        terms = ["churn", "bug_density", "ownership", "fanout"]
        if weights is None:
            return evaluation.risk_precision(files, terms)
        blended = overlay.blend(files, dict(zip(terms, weights, strict=True)))
        return evaluation.risk_precision(blended, ["composite"])

    def evaluate_grep(self, history: DataFrame, texts: DataFrame, k: int = 50) -> DataFrame:
        """ranking, queries, recall, mrr of impact, of shared identifiers, and of chance, over files of the k newest commits.

        A query is a file of a commit; wanted are the others of it. texts: file, text.
        """
        known = self.nodes.select(F.col("module_path").alias("file")).distinct()
        history = history.join(known, "file", "left_semi")
        test = history.join(overlay.holdout(history, k).filter("part = 'test'").select("commit"), "commit", "left_semi")
        pairs = evaluation.commit_pairs(test).select(F.col("a").alias("query"), F.col("b").alias("file")).distinct()
        queries = pairs.select("query").distinct()
        seeds = queries.join(self.nodes.select(F.col("module_path").alias("query"), "key"), "query")
        others = lambda ranked: ranked.filter("query <> file")
        graph_ = evaluation.recall_and_mrr(others(evaluation.impact_ranking(self.nodes, self.edges, seeds)), pairs)
        grep = evaluation.recall_and_mrr(others(evaluation.shared_identifier_ranking(queries.join(texts.withColumnRenamed("file", "query"), "query"), texts)), pairs)
        floor = graph_.select("queries", F.lit(evaluation.random_floor(known.count())).alias("recall"), F.lit(None).cast("double").alias("mrr"))
        name = lambda x, n: x.select(F.lit(n).alias("ranking"), "queries", "recall", "mrr")
        return name(graph_, "impact").unionByName(name(grep, "identifiers")).unionByName(name(floor, "chance"))

    def stale(self, current: DataFrame) -> DataFrame:
        from .sources.files import stale

        return stale(self.index.stamps, current)


def commit_files(log: DataFrame) -> DataFrame:
    """History for an index from ``sources.git.history``: names are carried through renames."""
    renames = log.filter("status = 'R'").select("seq", F.col("old_path").alias("old"), F.col("file").alias("new")).distinct()
    files = log.select(F.col("sha").alias("commit"), "seq", "author", "file", overlay.is_fix(F.col("message")).alias("is_fix"))
    current = overlay.current_names(files.select("seq", "file").distinct(), renames)
    return files.join(current, ["seq", "file"]).select("commit", "seq", "author", F.col("current").alias("file"), "is_fix").distinct()
