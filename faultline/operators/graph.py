"""Traversals of the property graph.

nodes: key, kind, name, qualified_name, module_path, start_line, end_line, composite, ...
edges: src, dst, kind, confidence (parallel edges are allowed).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import CALL_KINDS, DECAY, EPSILON, MAX_ROUNDS, MAX_ROUTES, kind_weight


def of_kinds(edges: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    return edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def diffuse(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, key, w, depth, via, parent: the best product of edge factors from any seed row (seed, key) against the edges.

    One batch for all seeds. A round extends only what the last one improved; parallel edges are
    reduced to their best before a round's own aggregate. Rounds only append: what a round found
    is one table, and the best of all rounds is taken at the end. Factors are below one, so
    rounds are bounded.
    """
    factor = F.greatest("confidence", F.lit(0.0)) * kind_weight(F.col("kind")) * DECAY
    best_edge = F.max_by("kind", F.struct(F.col("factor"), F.col("kind")))
    steps = edges.withColumn("factor", factor).groupBy("src", "dst").agg(F.max("factor").alias("factor"), best_edge.alias("via"))
    steps = cut(steps)
    found = [cut(seeds.select("seed", "key").distinct().select(
        "seed", "key", F.lit(1.0).alias("w"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("parent")))]
    # Ties go to the least depth, then to the edge kind and the parent that come first.
    order = F.struct((-F.col("w")).alias("low"), F.col("depth"), F.col("via"), F.col("parent"))
    best = lambda rows: rows.groupBy("seed", "key").agg(F.min(order).alias("o")).select("seed", "key", (-F.col("o.low")).alias("w"), "o.depth", "o.via", "o.parent")
    for _ in range(MAX_ROUNDS):
        reached = found[-1].select("seed", F.col("key").alias("dst"), "w", "depth").join(steps, "dst").select(
            "seed", F.col("src").alias("key"), (F.col("w") * F.col("factor")).alias("w"), (F.col("depth") + 1).alias("depth"), steps["via"], F.col("dst").alias("parent"))
        reached = best(reached.filter(F.col("w") >= EPSILON))
        old = union_all([t.select("seed", "key", "w") for t in found]).groupBy("seed", "key").agg(F.max("w").alias("old_w"))
        new = cut(reached.join(old, ["seed", "key"], "left").filter("old_w IS NULL OR w > old_w").drop("old_w"))
        if new.isEmpty():
            break
        found.append(new)
    return best(union_all(found))


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int | None = 20) -> DataFrame:
    """seed, key, w, score, depth, via, parent, rank, reached: what a change of the seeds is likely to break.

    Seeds are no hits. reached counts the hits before the cut at budget.
    """
    best = diffuse(edges, seeds)
    hits = best.join(seeds.select("seed", "key"), ["seed", "key"], "left_anti").join(nodes.select("key", "composite", "module_path", "qualified_name"), "key")
    scored = hits.withColumn("score", F.col("w") * (1 + F.col("composite")))
    reached = scored.groupBy("seed").agg(F.count("*").alias("reached"))
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("score", 9)), "module_path", "qualified_name", "key")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if budget is not None:
        ranked = ranked.filter(F.col("rank") <= budget)
    return ranked.join(reached, "seed").select("seed", "key", "w", "score", "depth", "via", "parent", "rank", "reached")


def neighbors(edges: DataFrame, start: DataFrame, direction: str = "out", kinds: Iterable[str] | None = None, depth: int = 1) -> DataFrame:
    """depth, src, dst, kind, confidence: every edge out of each level; a node is expanded once, when first met."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    own = of_kinds(edges, kinds)
    seen, hops = [cut(start.select("key").distinct())], []
    for d in range(1, depth + 1):
        hops.append(cut(own.join(seen[-1].select(F.col("key").alias(near)), near).select(F.lit(d).alias("depth"), "src", "dst", "kind", "confidence")))
        if d == depth:
            break
        level = cut(hops[-1].select(F.col(far).alias("key")).distinct().join(union_all(seen), "key", "left_anti"))
        if level.isEmpty():
            break
        seen.append(level)
    return union_all(hops)


def paths(edges: DataFrame, pairs: DataFrame, depth: int = 6, limit: int | None = 3, kinds: Iterable[str] | None = None) -> DataFrame:
    """start, goal, route (keys), route_kinds, hops, confidence, rank: simple routes of pairs (start, goal), shortest first.

    Co-change edges are no routes; parallel edges give routes of their own. A route ends at its goal.
    Only edges that some start reaches are looked at, and a route grows only where its goal can
    still be reached in the hops that are left. Since shorter routes come first, a pair is done
    with the first level that completes its limit.
    """
    cap = MAX_ROUTES if limit is None else min(limit, MAX_ROUTES)
    pairs = cut(pairs.select("start", "goal").filter("start <> goal").distinct())
    near = neighbors(edges.filter("kind <> 'ChangesWith'"), pairs.select(F.col("start").alias("key")), "out", kinds, depth)
    own = cut(near.select("src", "dst", "kind", "confidence"))
    step = own.select("src", "dst").distinct()
    # How far every key is from every goal.
    away = [cut(pairs.select("goal", F.col("goal").alias("key"), F.lit(0).alias("far")).distinct())]
    for d in range(1, depth):
        level = away[-1].join(step.withColumnRenamed("dst", "key"), "key").select("goal", F.col("src").alias("key")).distinct()
        level = cut(level.join(union_all(away).select("goal", "key"), ["goal", "key"], "left_anti").withColumn("far", F.lit(d)))
        if level.isEmpty():
            break
        away.append(level)
    away = union_all(away).withColumnRenamed("key", "dst")
    live = pairs.select("start", "goal", F.array("start").alias("route"), F.array().cast("array<string>").alias("route_kinds"), F.lit(1.0).alias("confidence"))
    done = []
    for hop in range(1, depth + 1):
        grown = live.withColumn("src", F.element_at("route", -1)).join(own.withColumnRenamed("confidence", "c"), "src")
        grown = grown.filter(~F.array_contains("route", F.col("dst"))).join(away.filter(F.col("far") <= depth - hop).drop("far"), ["goal", "dst"], "left_semi").select(
            "start", "goal", F.concat("route", F.array("dst")).alias("route"), F.concat("route_kinds", F.array("kind")).alias("route_kinds"),
            (F.col("confidence") * F.col("c")).alias("confidence"))
        grown = cut(grown)
        there = F.element_at("route", -1) == F.col("goal")
        done.append(grown.filter(there))
        full = union_all(done).groupBy("start", "goal").count().filter(F.col("count") >= cap)
        live = grown.filter(~there).join(full, ["start", "goal"], "left_anti")
        if hop == depth or live.isEmpty():
            break
    found = union_all(done).withColumn("hops", F.size("route_kinds"))
    order = Window.partitionBy("start", "goal").orderBy("hops", F.desc(F.round("confidence", 9)), F.array_join("route", ">"), F.array_join("route_kinds", ">"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def reachable_modules(nodes: DataFrame, edges: DataFrame, start: DataFrame, kinds: Iterable[str], depth: int) -> DataFrame:
    hops = neighbors(edges, start, "out", kinds, depth)
    return nodes.join(hops.select(F.col("dst").alias("key")).distinct(), "key", "left_semi").select("module_path").distinct()


def lookup(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes of the first tier that has any: exact name or qualified name, then qualified suffix, then part of either."""
    q = F.lit(query)
    low = query.lower()
    part = F.lower("qualified_name").contains(low) | F.lower("name").contains(low)
    tier = F.when((F.col("name") == q) | (F.col("qualified_name") == q), 1).when(F.col("qualified_name").endswith("." + query), 2).when(part, 3)
    found = nodes.withColumn("tier", tier).filter("tier IS NOT NULL")
    first = found.agg(F.min("tier").alias("first_tier"))
    names = F.element_at(F.array(*map(F.lit, ("Exact", "QualifiedSuffix", "Substring"))), F.col("tier"))
    return found.join(F.broadcast(first), F.col("tier") == F.col("first_tier")).withColumn("match", names).drop("tier", "first_tier")


def in_file(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes of a file named by its path or by a suffix of it that starts at a folder."""
    return nodes.filter((F.col("module_path") == path) | F.col("module_path").endswith("/" + path))


def imported(nodes: DataFrame, edges: DataFrame, dep: str) -> DataFrame:
    """is_imported: whether any Imports edge enters an external node of dep."""
    external = nodes.filter((F.col("kind") == "External") & (F.col("module_path") == dep)).select(F.col("key").alias("dst"))
    hit = edges.filter("kind = 'Imports'").join(external, "dst", "left_semi").limit(1)
    return hit.agg((F.count("*") > 0).alias("is_imported"))


def uses(nodes: DataFrame, edges: DataFrame, dep: str, symbol: str) -> DataFrame:
    """Project symbols that call or reference dep.symbol, each once."""
    target = nodes.filter((F.col("kind") == "External") & (F.col("module_path") == dep) & (F.col("qualified_name") == f"{dep}.{symbol}"))
    callers = of_kinds(edges, CALL_KINDS).join(target.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key")).distinct()
    return nodes.filter("kind <> 'External'").join(callers, "key", "left_semi").orderBy("module_path", "start_line", "key")


def reaches(nodes: DataFrame, edges: DataFrame, dep: str, symbol: str, depth: int = 6) -> DataFrame:
    """The best route of each transitive caller into dep.symbol, kept only if all its edges are calls."""
    target = nodes.filter((F.col("kind") == "External") & (F.col("module_path") == dep) & (F.col("qualified_name") == f"{dep}.{symbol}")).select("key")
    callers = neighbors(edges, target, "in", CALL_KINDS, depth).select(F.col("src").alias("start")).distinct()
    pairs = callers.crossJoin(F.broadcast(target.select(F.col("key").alias("goal")).limit(1)))
    best = paths(edges, pairs, depth, limit=1)
    return best.filter(F.forall("route_kinds", lambda k: k.isin(*CALL_KINDS)))


def explain_edge(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges between two sets of keys, with their direction."""
    ends = lambda x, n: x.select(F.col("key").alias(n)).distinct()
    there = edges.join(ends(a, "src"), "src", "left_semi").join(ends(b, "dst"), "dst", "left_semi").withColumn("direction", F.lit("a->b"))
    back = edges.join(ends(b, "src"), "src", "left_semi").join(ends(a, "dst"), "dst", "left_semi").withColumn("direction", F.lit("b->a"))
    return there.unionByName(back)


def test_side(edges: DataFrame) -> DataFrame:
    """Keys with an outgoing Tests edge."""
    return edges.filter("kind = 'Tests'").select(F.col("src").alias("key")).distinct()


def tested(edges: DataFrame) -> DataFrame:
    """Keys with a Tests edge in either direction."""
    own = edges.filter("kind = 'Tests'")
    return own.select(F.col("src").alias("key")).unionByName(own.select(F.col("dst").alias("key"))).distinct()


def in_edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("centrality"))


def tree(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """Hops in tree order: below their parent, one row per (node, kind), siblings by key; sort_path gives the order."""
    level = edges.sparkSession.createDataFrame([(root, root, None, 0)], "key string, sort_path string, kind string, depth int")
    out = level
    own = edges.select(F.col("src").alias("key"), F.col("dst"), F.col("kind").alias("k")).distinct()
    seen = level.select("key")
    for _ in range(depth):
        grown = level.select("key", "sort_path", "depth").join(own, "key").select(
            F.col("dst").alias("key"), F.concat_ws("/", "sort_path", F.concat("dst", F.lit(":"), "k")).alias("sort_path"), F.col("k").alias("kind"), (F.col("depth") + 1).alias("depth"))
        first = Window.partitionBy("key", "kind").orderBy("sort_path")
        level = cut(grown.join(seen, "key", "left_anti").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n"))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level.select("key")).distinct())
        out = out.unionByName(level)
    return out.orderBy("sort_path")


def route_confidence(confidences: Column) -> Column:
    """The product of the edges of a route."""
    return F.aggregate(confidences, F.lit(1.0), lambda a, x: a * x)


def repeated_edges(edges: DataFrame) -> DataFrame:
    """One row: repeated, the edges beyond the first of their (src, dst, kind)."""
    return edges.groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
