"""Ranked answers: locate (task text to entry points), search (a symbol's name), review (what to read first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms, task_terms, tokenize
from ..plans.lineage import cut
from .graph import diffuse, impact, in_edge_counts, test_side, tested
from .order import first_rows, with_place

RRF = 60


def shared_rank(rows: DataFrame, value: str, out: str = "place") -> DataFrame:
    """rows with their competition rank from 0: equal values share a place."""
    return with_place(rows, value, out)


def locate_scores(nodes: DataFrame, task: str) -> DataFrame:
    """Nodes with any matching term: lexical score and why. Per term the first field that holds it counts."""
    n = nodes.select("key", "module_path", "qualified_name", "name", "composite",
                     F.explode(task_terms(task)).alias("t"), tokenize(F.col("name")).alias("name_tokens"), tokenize(F.col("module_path")).alias("module_tokens"),
                     tokenize(F.col("route_path")).alias("route_tokens"), tokenize(F.col("doc")).alias("doc_tokens"))
    t = F.col("t.term")
    holds = lambda c: F.array_contains(F.col(c), t)
    rules = [
        (holds("route_tokens"), 5, "route"), (holds("name_tokens"), 4, "name"), (F.lower("name").contains(t), 2, "name"),
        (holds("module_tokens") | F.lower("qualified_name").contains(t), 2, "module"), (holds("doc_tokens"), 1, "doc"),
    ]
    points, field = F.lit(0), F.lit("")
    for rule, p, f in reversed(rules):
        points, field = F.when(rule, F.lit(p)).otherwise(points), F.when(rule, F.lit(f)).otherwise(field)
    hit = n.withColumn("points", points).withColumn("why", F.concat(field, F.lit(":"), F.col("t.raw"))).filter("points > 0")
    return hit.groupBy("key", "module_path", "qualified_name", "composite").agg(F.sum("points").alias("lexical"), F.array_join(F.array_sort(F.collect_list("why")), " ").alias("why"))


def locate(nodes: DataFrame, edges: DataFrame, task: str, budget: int = 10) -> DataFrame:
    """key, rrf, lexical, centrality, why, rank, ambiguous, total: entry points of a task, by fused ranks.

    Lexical score, in-edges and risk are ranked apart (ties share a place) and fused as the sum
    of 1 / (60 + place). ambiguous: the last row shown ties with the first one cut.
    """
    scored = locate_scores(nodes, task).join(in_edge_counts(edges), "key", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0)))
    scored = cut(scored)
    fields = ("lexical", "centrality", "composite")
    fused = scored
    for c in fields:
        fused = shared_rank(fused, c, f"{c}_place")
    fused = fused.withColumn("rrf", sum((1.0 / (RRF + F.col(f"{c}_place")) for c in fields), F.lit(0.0))).drop(*(f"{c}_place" for c in fields))
    total = scored.agg(F.count("*").alias("total"))
    order = [F.desc(F.round("rrf", 12)), "module_path", "qualified_name", "key"]
    # One more than is shown, to see whether the cut goes through a tie.
    top = first_rows(fused, order, budget + 1)
    line = Window.orderBy("rank")
    tie = (F.col("rank") == budget) & (F.abs(F.col("rrf") - F.lead("rrf").over(line)) < 1e-12)
    return top.withColumn("_tie", tie).withColumn("ambiguous", F.max(F.coalesce("_tie", F.lit(False))).over(Window.partitionBy())).drop("_tie").filter(F.col("rank") <= budget).crossJoin(F.broadcast(total))


def locate_with_preview(nodes: DataFrame, edges: DataFrame, task: str, budget: int = 10, preview: int = 3) -> DataFrame:
    """locate, and for each entry the hits that a change of it would have first."""
    found = locate(nodes, edges, task, budget)
    hits = impact(nodes, edges, found.select(F.col("key").alias("seed"), "key"), preview)
    shown = hits.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]), " ").alias("preview"))
    return found.join(shown.withColumnRenamed("seed", "key"), "key", "left")


def search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """key, module_path, name, score: symbols whose name, qualified name or module holds the terms of a query."""
    terms = search_terms(F.lit(query))
    name_terms = search_terms(F.col("name"))
    low, wide = F.lower("name"), F.lower("qualified_name")
    point = lambda t: (
        F.when(F.array_contains(name_terms, t), 4).when(low.startswith(t), 3).when(low.contains(t), 2)
        .when(wide.contains(t) | F.lower("module_path").contains(t), 1).otherwise(0)
    )
    score = F.aggregate(F.transform(terms, point), F.lit(0), lambda a, x: a + x) + F.when(F.array_sort(terms) == F.array_sort(name_terms), 8).otherwise(0)
    return nodes.withColumn("score", score).filter("score > 0").select("key", "module_path", "name", "score").orderBy(F.desc("score"), "module_path", "name", "key").limit(limit)


def changed_symbols(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """key, changed_lines, rewrite_share of symbols any of whose definition spans meets a changed range of its file.

    spans: key, module_path, start_line, end_line (a row per definition site); changed: module_path, from_line, to_line.
    """
    meets = (F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line"))
    overlap = F.greatest(F.lit(0), F.least("to_line", "end_line") - F.greatest("from_line", "start_line") + 1)
    hit = spans.join(changed, "module_path").filter(meets).groupBy("key").agg(F.sum(overlap).alias("changed_lines"))
    total = spans.groupBy("key").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide("changed_lines", "total_lines"), F.lit(0.0)))
    return hit.join(total, "key").select("key", "changed_lines", share.alias("rewrite_share"))


def priority(composite: Column, down_weight: Column, changed_lines: Column, share: Column) -> Column:
    return (1 + composite) * (1 + F.log1p(down_weight)) * (1 + F.log1p(changed_lines) * (0.5 + 0.5 * share))


def review(nodes: DataFrame, edges: DataFrame, spans: DataFrame, changed: DataFrame, budget: int | None = 15, scope: str = "") -> DataFrame:
    """Changed symbols by review priority, with downstream reach, lines, reasons, rank and total. One batched diffusion for all."""
    syms = changed_symbols(spans, changed).join(nodes.select("key", "module_path", "qualified_name", "composite", "churn", "bug_density"), "key")
    best = diffuse(edges, syms.select(F.col("key").alias("seed"), "key"))
    hits = best.filter("seed <> key").join(nodes.select("key"), "key", "left_semi")
    tests = test_side(edges).withColumn("is_test", F.lit(True))
    down = hits.join(tests, "key", "left").groupBy(F.col("seed").alias("key")).agg(
        F.count("*").alias("downstream"), F.sum(F.when(F.col("is_test").isNull(), F.col("w")).otherwise(0.0)).alias("down_weight"))
    known = edges.filter("kind = 'Tests'").join(nodes.select(F.col("key").alias("src"), "module_path"), "src").filter(F.col("module_path").startswith(scope)).limit(1)
    known = known.agg((F.count("*") > 0).alias("tests_known"))
    covered = tested(edges).withColumn("is_tested", F.lit(True))
    out = syms.join(down, "key", "left").join(covered, "key", "left").crossJoin(F.broadcast(known))
    out = out.withColumn("downstream", F.coalesce("downstream", F.lit(0))).withColumn("down_weight", F.coalesce("down_weight", F.lit(0.0)))
    out = out.withColumn("untested", F.col("tests_known") & F.col("is_tested").isNull())
    reasons = F.array(
        F.when(F.col("bug_density") > 0.6, F.format_string("high bug-density (%.2f)", "bug_density")),
        F.when(F.col("churn") > 0.6, F.format_string("high churn (%.2f)", "churn")),
        F.when(F.col("downstream") > 0, F.concat(F.col("downstream").cast("string"), F.lit(" downstream"))),
        F.when(F.col("changed_lines") > 0, F.concat(F.col("changed_lines").cast("string"), F.lit(" lines changed"))),
        F.when(F.col("untested"), F.lit("untested")),
    )
    out = out.withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), "; "))
    out = out.withColumn("review_priority", priority(F.col("composite"), F.col("down_weight"), F.col("changed_lines"), F.col("rewrite_share")))
    out = cut(out)
    order = [F.desc(F.round("review_priority", 9)), "module_path", "qualified_name", "key"]
    cols = ["key", "rank", "total", "review_priority", "downstream", "down_weight", "changed_lines", "rewrite_share", "reasons", "untested"]
    return first_rows(out, order, budget).crossJoin(F.broadcast(out.agg(F.count("*").alias("total")))).select(cols)


def review_by_case(nodes: DataFrame, edges: DataFrame, spans: DataFrame, changed: DataFrame) -> DataFrame:
    """case, key, module_path, review_priority, rank, total: a review of each case's changes, all cases in one diffusion.

    changed: case, module_path, from_line, to_line.
    """
    meets = (F.col("start_line") <= F.col("to_line")) & (F.col("end_line") >= F.col("from_line"))
    overlap = F.greatest(F.lit(0), F.least("to_line", "end_line") - F.greatest("from_line", "start_line") + 1)
    hit = spans.join(changed, "module_path").filter(meets).groupBy("case", "key").agg(F.sum(overlap).alias("changed_lines"))
    total = spans.groupBy("key").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total_lines"))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide("changed_lines", "total_lines"), F.lit(0.0)))
    syms = cut(hit.join(total, "key").withColumn("rewrite_share", share).join(nodes.select("key", "module_path", "qualified_name", "composite"), "key"))
    best = diffuse(edges, syms.select(F.col("key").alias("seed"), "key"))
    hits = best.filter("seed <> key").join(nodes.select("key"), "key", "left_semi").join(test_side(edges), "key", "left_anti")
    down = hits.groupBy(F.col("seed").alias("key")).agg(F.sum("w").alias("down_weight"))
    out = syms.join(down, "key", "left").withColumn("down_weight", F.coalesce("down_weight", F.lit(0.0)))
    out = out.withColumn("review_priority", priority(F.col("composite"), F.col("down_weight"), F.col("changed_lines"), F.col("rewrite_share")))
    order = Window.partitionBy("case").orderBy(F.desc(F.round("review_priority", 9)), "module_path", "qualified_name", "key")
    out = out.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("case")))
    return out.select("case", "key", "module_path", "review_priority", "rank", "total")


def missing_cochange(modules: DataFrame, edges: DataFrame, changed: DataFrame, least: float = 0.5) -> DataFrame:
    """Modules that change with a changed one (coupling at least ``least``) but are not in the change."""
    files = changed.select("module_path").distinct()
    start = modules.join(files, "module_path", "left_semi").select(F.col("key").alias("src"))
    other = edges.filter((F.col("kind") == "ChangesWith") & (F.col("confidence") >= least)).join(start, "src", "left_semi").select(F.col("dst").alias("key")).distinct()
    return modules.join(other, "key", "left_semi").join(files, "module_path", "left_anti").select("module_path").distinct().orderBy("module_path")
