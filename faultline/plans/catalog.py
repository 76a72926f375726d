"""Every query by name: a call of an operator over a view of the driver's tables, and DuckDB SQL for the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, graph, link, overlay, ranking, routes
from ..schema import DECAY, EPSILON, IGNORED_DIRS, STOPWORDS, kind_weight_sql
from .fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def keys(spark: SparkSession, *k: str) -> DataFrame:
    return rows(spark, "key string", *((x,) for x in k))


# --- J: traversals ---------------------------------------------------------------------------

STEPS = f"(SELECT src, dst, max(greatest(confidence, 0) * {kind_weight_sql('kind')} * {DECAY}) AS f FROM %s GROUP BY src, dst)"


def diffusion_sql(edges: str, seeds: str) -> str:
    return f"""WITH RECURSIVE steps AS {STEPS % edges}, seeds AS ({seeds}),
    t(seed, key, w, depth) AS (
      SELECT seed, key, CAST(1 AS DOUBLE), 0 FROM seeds
      UNION ALL SELECT t.seed, s.src, t.w * s.f, t.depth + 1 FROM t JOIN steps s ON s.dst = t.key WHERE t.w * s.f >= {EPSILON}),
    best AS (SELECT seed, key, max(w) AS w FROM t GROUP BY seed, key),
    hits AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.seed = b.seed AND x.key = b.key))"""


@query(diffusion_sql("g_edges", "SELECT 'r0' AS seed, 'r0' AS key") + """
 SELECT h.key, round(h.w, 6) AS w, round(h.w * (1 + n.composite), 6) AS score, count(*) OVER () AS reached FROM hits h JOIN g_nodes n ON n.key = h.key""")
def j1_impact(spark, d):
    seeds = rows(spark, "seed string, key string", ("r0", "r0"))
    out = graph.impact(view(spark, d, "g_nodes"), view(spark, d, "g_edges"), seeds, budget=None)
    return out.select("key", F.round("w", 6).alias("w"), F.round("score", 6).alias("score"), "reached")


@query(diffusion_sql("k_edges", "SELECT key AS seed, key FROM k_nodes") + """
 SELECT h.seed, h.key, round(h.w, 6) AS w, CAST(row_number() OVER (PARTITION BY h.seed ORDER BY round(h.w * (1 + n.composite), 9) DESC, n.module_path, n.qualified_name, h.key) AS INT) AS rank
 FROM hits h JOIN k_nodes n ON n.key = h.key""")
def j1_impact_batched_cyclic(spark, d):
    nodes = view(spark, d, "k_nodes")
    out = graph.impact(nodes, view(spark, d, "k_edges"), nodes.select(F.col("key").alias("seed"), "key"), budget=None)
    return out.select("seed", "key", F.round("w", 6).alias("w"), "rank")


@query("""WITH RECURSIVE lv(key, d) AS (SELECT 'n3', 0 UNION SELECT e.src, d + 1 FROM lv JOIN g_edges e ON e.dst = lv.key WHERE d < 2)
 SELECT d + 1 AS depth, e.src, e.dst, e.kind, count(*) AS sites FROM lv JOIN g_edges e ON e.dst = lv.key WHERE d < 2 GROUP BY ALL""")
def j2_neighbors(spark, d):
    hops = graph.neighbors(view(spark, d, "g_edges"), keys(spark, "n3"), "in", depth=2)
    return hops.groupBy("depth", "src", "dst", "kind").agg(F.count("*").alias("sites"))


PATHS = """WITH RECURSIVE p(start, goal, at_node, route, kinds, confidence, hops) AS (
  SELECT a.key, b.key, a.key, [a.key], CAST([] AS VARCHAR[]), CAST(1 AS DOUBLE), 0 FROM {pairs}
  UNION ALL SELECT p.start, p.goal, e.dst, list_append(route, e.dst), list_append(kinds, e.kind), p.confidence * e.confidence, hops + 1
  FROM p JOIN {edges} e ON e.src = p.at_node WHERE p.at_node <> p.goal AND NOT list_contains(route, e.dst) AND e.kind <> 'ChangesWith' AND hops < 6),
 done AS (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY hops, round(confidence, 9) DESC, array_to_string(route, '>'), array_to_string(kinds, '>')) AS rank
  FROM p WHERE at_node = goal AND hops > 0)"""


@query(PATHS.format(pairs="k_nodes a CROSS JOIN k_nodes b WHERE a.key <> b.key", edges="k_edges") + """
 SELECT start, goal, array_to_string(route, '>') AS route, array_to_string(kinds, '>') AS route_kinds, hops, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank FROM done WHERE rank <= 3""")
def j3_paths(spark, d):
    nodes = view(spark, d, "k_nodes")
    pairs = nodes.select(F.col("key").alias("start")).crossJoin(nodes.select(F.col("key").alias("goal"))).filter("start <> goal")
    out = graph.paths(view(spark, d, "k_edges"), pairs)
    return out.select("start", "goal", F.array_join("route", ">").alias("route"), F.array_join("route_kinds", ">").alias("route_kinds"), "hops", F.round("confidence", 6).alias("confidence"), "rank")


@query(PATHS.format(pairs="(SELECT key FROM g_nodes WHERE key = 'o1') a CROSS JOIN g_nodes b WHERE b.kind = 'Module'", edges="g_edges") + """
 SELECT goal, array_to_string(route, '>') AS route, hops, round(confidence, 6) AS confidence, CAST(rank AS INT) AS rank FROM done WHERE rank <= 3""")
def j3_paths_to_regions(spark, d):
    nodes = view(spark, d, "g_nodes")
    pairs = nodes.filter("kind = 'Module'").select(F.lit("o1").alias("start"), F.col("key").alias("goal"))
    out = graph.paths(view(spark, d, "g_edges"), pairs)
    return out.select("goal", F.array_join("route", ">").alias("route"), "hops", F.round("confidence", 6).alias("confidence"), "rank")


@query("""WITH RECURSIVE lv(key, d) AS (SELECT 'o1', 0 UNION SELECT e.dst, d + 1 FROM lv JOIN g_edges e ON e.src = lv.key WHERE d < 3 AND e.kind IN ('Calls', 'Imports', 'DbQuery'))
 SELECT DISTINCT n.module_path FROM lv JOIN g_nodes n ON n.key = lv.key WHERE d > 0""")
def j4_reachable_modules(spark, d):
    return graph.reachable_modules(view(spark, d, "g_nodes"), view(spark, d, "g_edges"), keys(spark, "o1"), ["Calls", "Imports", "DbQuery"], 3)


@query(PATHS.format(pairs="(SELECT key FROM k_nodes WHERE name = 'main') a CROSS JOIN (SELECT key FROM k_nodes WHERE name = 'Store.save' OR name = 'Store') b", edges="k_edges") + """
 SELECT start, goal, count(*) > 0 AS is_reachable, CAST(min(hops) AS INT) AS hops FROM done WHERE rank <= 3 GROUP BY start, goal""")
def j5_reachable(spark, d):
    nodes = view(spark, d, "k_nodes")
    start = graph.lookup(nodes, "main").select(F.col("key").alias("start"))
    goal = graph.lookup(nodes, "Store").unionByName(graph.lookup(nodes, "Store.save")).select(F.col("key").alias("goal")).distinct()
    out = graph.paths(view(spark, d, "k_edges"), start.crossJoin(goal))
    return out.groupBy("start", "goal").agg((F.count("*") > 0).alias("is_reachable"), F.min("hops").alias("hops"))


@query("SELECT dep, EXISTS (SELECT 1 FROM k_edges e JOIN k_nodes n ON n.key = e.dst WHERE e.kind = 'Imports' AND n.kind = 'External' AND n.module_path = dep) AS is_imported FROM (VALUES ('requests'), ('numpy')) v(dep)")
def j6_imports(spark, d):
    nodes, edges = view(spark, d, "k_nodes"), view(spark, d, "k_edges")
    one = lambda dep: graph.imported(nodes, edges, dep).select(F.lit(dep).alias("dep"), "is_imported")
    return one("requests").unionByName(one("numpy"))


@query("SELECT DISTINCT n.key, n.module_path FROM k_edges e JOIN k_nodes n ON n.key = e.src WHERE e.dst = 'xg' AND e.kind IN ('Calls', 'AsyncCall', 'References') AND n.kind <> 'External'")
def j7_uses(spark, d):
    return graph.uses(view(spark, d, "k_nodes"), view(spark, d, "k_edges"), "requests", "get").select("key", "module_path")


@query(PATHS.format(pairs="k_nodes a CROSS JOIN (SELECT 'xg' AS key) b WHERE a.key <> b.key", edges="k_edges") + """
 , callers(key, d) AS (SELECT 'xg', 0 UNION SELECT e.src, d + 1 FROM callers c JOIN k_edges e ON e.dst = c.key WHERE d < 6 AND e.kind IN ('Calls', 'AsyncCall', 'References'))
 SELECT start, array_to_string(route, '>') AS route FROM done WHERE rank = 1 AND start IN (SELECT key FROM callers)
   AND len(list_filter(kinds, lambda k: k NOT IN ('Calls', 'AsyncCall', 'References'))) = 0""")
def j8_reaches(spark, d):
    out = graph.reaches(view(spark, d, "k_nodes"), view(spark, d, "k_edges"), "requests", "get")
    return out.select("start", F.array_join("route", ">").alias("route"))


@query("""WITH q(q) AS (VALUES ('FRANCE'), ('Customer#000000007'), ('customer#00000000')),
 tiers AS (SELECT q, key, CASE WHEN name = q OR qualified_name = q THEN 1 WHEN ends_with(qualified_name, concat('.', q)) THEN 2
   WHEN contains(lower(name), lower(q)) OR contains(lower(qualified_name), lower(q)) THEN 3 END AS tier FROM q, g_nodes)
 SELECT q AS wanted, key, CASE tier WHEN 1 THEN 'Exact' WHEN 2 THEN 'QualifiedSuffix' ELSE 'Substring' END AS match
 FROM (SELECT *, min(tier) OVER (PARTITION BY q) AS first_tier FROM tiers WHERE tier IS NOT NULL) WHERE tier = first_tier""")
def j9_lookup(spark, d):
    nodes = view(spark, d, "g_nodes")
    out = None
    for q in ("FRANCE", "Customer#000000007", "customer#00000000"):
        one = graph.lookup(nodes, q).select(F.lit(q).alias("wanted"), "key", "match")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT key, name FROM g_nodes WHERE module_path = 'nation/3' OR ends_with(module_path, '/nation/3')")
def j10_nodes_in_file(spark, d):
    return graph.in_file(view(spark, d, "g_nodes"), "nation/3").select("key", "name")


@query("SELECT key, key IN (SELECT src FROM k_edges WHERE kind = 'Tests') AS is_test_side, key IN (SELECT src FROM k_edges WHERE kind = 'Tests' UNION SELECT dst FROM k_edges WHERE kind = 'Tests') AS has_test_edge FROM k_nodes")
def j11_test_side(spark, d):
    nodes, edges = view(spark, d, "k_nodes"), view(spark, d, "k_edges")
    side = graph.test_side(edges).withColumn("s", F.lit(True))
    any_ = graph.tested(edges).withColumn("t", F.lit(True))
    return nodes.join(side, "key", "left").join(any_, "key", "left").select("key", F.col("s").isNotNull().alias("is_test_side"), F.col("t").isNotNull().alias("has_test_edge"))


@query("""SELECT src, dst, kind, CASE WHEN src IN ('b', 'c') AND dst IN ('a', 'd') THEN 'b->a' ELSE 'a->b' END AS direction FROM k_edges
 WHERE (src IN ('a', 'd') AND dst IN ('b', 'c')) OR (src IN ('b', 'c') AND dst IN ('a', 'd'))""")
def j12_explain_edge(spark, d):
    return graph.explain_edge(view(spark, d, "k_edges"), keys(spark, "a", "d"), keys(spark, "b", "c")).select("src", "dst", "kind", "direction")


def tokens_sql(c: str) -> str:
    words = f"list_filter(string_split_regex(lower(regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_transform({words}, lambda w: CASE WHEN len(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END)"


def locate_sql(terms: str, nodes: str, edges: str) -> str:
    return f"""terms(term, raw) AS (VALUES {terms}),
 pts AS (SELECT n.key, n.module_path, n.qualified_name, n.composite, raw,
   CASE WHEN list_contains({tokens_sql('n.name')}, term) THEN 4 WHEN contains(lower(n.name), term) THEN 2
        WHEN list_contains({tokens_sql('n.module_path')}, term) OR contains(lower(n.qualified_name), term) THEN 2 WHEN list_contains({tokens_sql('n.doc')}, term) THEN 1 ELSE 0 END AS p,
   CASE WHEN list_contains({tokens_sql('n.name')}, term) THEN 'name' WHEN contains(lower(n.name), term) THEN 'name'
        WHEN list_contains({tokens_sql('n.module_path')}, term) OR contains(lower(n.qualified_name), term) THEN 'module' ELSE 'doc' END AS f
   FROM {nodes} n, terms),
 scored AS (SELECT key, module_path, qualified_name, composite, CAST(sum(p) AS BIGINT) AS lexical, string_agg(concat(f, ':', raw), ' ' ORDER BY concat(f, ':', raw)) AS why FROM pts WHERE p > 0 GROUP BY ALL),
 cent AS (SELECT dst AS key, count(*) AS centrality FROM {edges} GROUP BY dst),
 both_ AS (SELECT s.*, coalesce(c.centrality, 0) AS centrality FROM scored s LEFT JOIN cent c ON c.key = s.key),
 ranked AS (SELECT *, CAST(1 AS DOUBLE) / (60 + rank() OVER (ORDER BY lexical DESC) - 1) + CAST(1 AS DOUBLE) / (60 + rank() OVER (ORDER BY centrality DESC) - 1)
   + CAST(1 AS DOUBLE) / (60 + rank() OVER (ORDER BY composite DESC) - 1) AS rrf FROM both_),
 final AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, module_path, qualified_name, key) AS rank, lead(rrf) OVER (ORDER BY round(rrf, 12) DESC, module_path, qualified_name, key) AS nxt, count(*) OVER () AS total FROM ranked)"""


LOCATE = locate_sql("('ring', 'rings'), ('steel', 'steel')", "t_nodes", "t_edges")
LOCATE_PEOPLE = locate_sql("('customer', 'customer'), ('building', 'building')", "g_nodes", "g_edges")


@query(f"WITH {LOCATE} SELECT key, lexical, why, centrality, round(rrf, 9) AS rrf, CAST(rank AS INT) AS rank, total, (SELECT abs(rrf - nxt) < 1e-12 FROM final WHERE rank = 10) AS ambiguous FROM final WHERE rank <= 10")
def j13_locate(spark, d):
    out = ranking.locate(view(spark, d, "t_nodes"), view(spark, d, "t_edges"), "implement the steel rings")
    return out.select("key", "lexical", "why", "centrality", F.round("rrf", 9).alias("rrf"), "rank", "total", "ambiguous")


@query(f"""WITH RECURSIVE {LOCATE_PEOPLE}, steps AS {STEPS % "g_edges"}, top10 AS (SELECT key, CAST(rank AS INT) AS rank FROM final WHERE rank <= 10),
 t(seed, key, w) AS (SELECT key, key, CAST(1 AS DOUBLE) FROM top10 UNION ALL SELECT t.seed, s.src, t.w * s.f FROM t JOIN steps s ON s.dst = t.key WHERE t.w * s.f >= {EPSILON}),
 best AS (SELECT seed, key, max(w) AS w FROM t WHERE seed <> key GROUP BY ALL),
 hit AS (SELECT b.seed, b.key, row_number() OVER (PARTITION BY b.seed ORDER BY round(b.w * (1 + n.composite), 9) DESC, n.module_path, n.qualified_name, b.key) AS r FROM best b JOIN g_nodes n ON n.key = b.key),
 shown AS (SELECT seed, string_agg(key, ' ' ORDER BY r) AS preview FROM hit WHERE r <= 3 GROUP BY seed)
 SELECT x.key, x.rank, s.preview FROM top10 x LEFT JOIN shown s ON s.seed = x.key""")
def j13_locate_with_preview(spark, d):
    return ranking.locate_with_preview(view(spark, d, "g_nodes"), view(spark, d, "g_edges"), "customer building", 10).select("key", "rank", "preview")


CHANGED_SYMS = """spans AS (SELECT key, module_path, start_line, end_line FROM g_nodes WHERE kind = 'Function' AND key LIKE 'o%'),
 syms AS (SELECT s.key, CAST(sum(greatest(0, least(c.to_line, s.end_line) - greatest(c.from_line, s.start_line) + 1)) AS BIGINT) AS changed_lines, min(s.end_line - s.start_line + 1) AS total_lines
  FROM spans s JOIN g_changed c ON c.module_path = s.module_path AND s.start_line <= c.to_line AND s.end_line >= c.from_line GROUP BY s.key)"""


@query(f"WITH {CHANGED_SYMS} SELECT key, changed_lines, round(least(1, changed_lines / total_lines), 6) AS rewrite_share FROM syms")
def d40_changed_symbols(spark, d):
    spans = view(spark, d, "g_nodes").filter("kind = 'Function' AND key LIKE 'o%'")
    out = ranking.changed_symbols(spans, view(spark, d, "g_changed"))
    return out.select("key", "changed_lines", F.round("rewrite_share", 6).alias("rewrite_share"))


#: For the review the edges are turned round: a change of an order reaches its customer, nation and region.
BACK = "SELECT dst AS src, src AS dst, kind, confidence FROM g_edges"


@query(f"""WITH RECURSIVE {CHANGED_SYMS}, steps AS {STEPS % ('(' + BACK + ')')}, t(seed, key, w) AS (
   SELECT key, key, CAST(1 AS DOUBLE) FROM syms UNION ALL SELECT t.seed, s.src, t.w * s.f FROM t JOIN steps s ON s.dst = t.key WHERE t.w * s.f >= {EPSILON}),
 best AS (SELECT seed, key, max(w) AS w FROM t GROUP BY ALL), down AS (SELECT seed, count(*) AS downstream, sum(w) AS down_weight FROM best WHERE seed <> key GROUP BY seed),
 r AS (SELECT y.key, n.module_path, n.qualified_name, coalesce(downstream, 0) AS downstream, changed_lines, n.bug_density, n.churn,
   (1 + n.composite) * (1 + ln(1 + coalesce(down_weight, 0))) * (1 + ln(1 + changed_lines) * (0.5 + 0.5 * least(1, changed_lines / total_lines))) AS review_priority
   FROM syms y JOIN g_nodes n ON n.key = y.key LEFT JOIN down ON down.seed = y.key),
 k AS (SELECT *, row_number() OVER (ORDER BY round(review_priority, 9) DESC, module_path, qualified_name, key) AS rank, count(*) OVER () AS total FROM r)
 SELECT key, CAST(rank AS INT) AS rank, total, round(review_priority, 6) AS review_priority, downstream, changed_lines,
   concat_ws('; ', CASE WHEN bug_density > 0.6 THEN printf('high bug-density (%.2f)', bug_density) END, CASE WHEN churn > 0.6 THEN printf('high churn (%.2f)', churn) END,
     CASE WHEN downstream > 0 THEN concat(downstream, ' downstream') END, concat(changed_lines, ' lines changed')) AS reasons FROM k WHERE rank <= 15""")
def j14_review(spark, d):
    nodes = view(spark, d, "g_nodes")
    spans = nodes.filter("kind = 'Function' AND key LIKE 'o%'")
    edges = view(spark, d, "g_edges").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "confidence")
    out = ranking.review(nodes, edges, spans, view(spark, d, "g_changed"))
    return out.select("key", "rank", "total", F.round("review_priority", 6).alias("review_priority"), "downstream", "changed_lines", "reasons")


@query("""SELECT key, name, score FROM (SELECT key, name, module_path,
  CASE WHEN list_contains(string_split_regex(lower(name), '[^a-z0-9]+'), 'steel') THEN 4 WHEN starts_with(lower(name), 'steel') THEN 3 WHEN contains(lower(name), 'steel') THEN 2
       WHEN contains(lower(qualified_name), 'steel') OR contains(lower(module_path), 'steel') THEN 1 ELSE 0 END
  + CASE WHEN list_contains(string_split_regex(lower(name), '[^a-z0-9]+'), 'ring') THEN 4 WHEN starts_with(lower(name), 'ring') THEN 3 WHEN contains(lower(name), 'ring') THEN 2
       WHEN contains(lower(qualified_name), 'ring') OR contains(lower(module_path), 'ring') THEN 1 ELSE 0 END
  + CASE WHEN list_sort(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) = ['ring', 'steel'] THEN 8 ELSE 0 END AS score FROM t_nodes)
 WHERE score > 0 ORDER BY score DESC, module_path, name, key LIMIT 30""")
def i5_search(spark, d):
    return ranking.search(view(spark, d, "t_nodes"), "Steel ring").select("key", "name", "score")


# --- D37, E: history and risk ----------------------------------------------------------------

USABLE = """sizes AS (SELECT commit, count(DISTINCT file) AS n, min(seq) AS s FROM g_commit_files GROUP BY commit HAVING count(DISTINCT file) BETWEEN 1 AND 40),
 newest AS (SELECT commit FROM sizes ORDER BY s, commit LIMIT 3000), cf AS (SELECT DISTINCT commit, seq, author, file, is_fix FROM g_commit_files WHERE commit IN (SELECT commit FROM newest)),
 stats AS (SELECT file, count(DISTINCT commit) AS commits, count(DISTINCT CASE WHEN is_fix THEN commit END) AS fixes, count(DISTINCT author) AS authors FROM cf GROUP BY file)"""


def usable(spark, d):
    return overlay.usable_commits(view(spark, d, "g_commit_files"))


@query(f"WITH {USABLE} SELECT * FROM stats")
def e1_file_stats(spark, d):
    return overlay.file_stats(usable(spark, d))


PERCENTILES = f"""{USABLE}, risk AS (SELECT file, commits, fixes, authors, (rank() OVER (ORDER BY commits) - 1) / count(*) OVER () AS churn,
  (rank() OVER (ORDER BY fixes / commits) - 1) / count(*) OVER () AS bug_density, (rank() OVER (ORDER BY 1 / authors) - 1) / count(*) OVER () AS ownership FROM stats)"""


@query(f"WITH {PERCENTILES} SELECT file, round(churn, 6) AS churn, round(bug_density, 6) AS bug_density, round(ownership, 6) AS ownership FROM risk")
def e5_file_risk(spark, d):
    out = overlay.file_risk(overlay.file_stats(usable(spark, d)))
    return out.select("file", *(F.round(c, 6).alias(c) for c in ("churn", "bug_density", "ownership")))


@query(f"WITH {PERCENTILES} SELECT file, round((0.4 * churn + 0.4 * bug_density + 0.2 * ownership) / 1.0, 6) AS composite FROM risk")
def e7_blend(spark, d):
    out = overlay.blend(overlay.file_risk(overlay.file_stats(usable(spark, d))), {"churn": 0.4, "bug_density": 0.4, "ownership": 0.2})
    return out.select("file", F.round("composite", 6).alias("composite"))


PAIRS = """pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS shared FROM (SELECT DISTINCT commit, file FROM cf) x JOIN (SELECT DISTINCT commit, file FROM cf) y ON x.commit = y.commit AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2),
 kept AS (SELECT a, b, shared, least(1, shared / least(sa.commits, sb.commits)) AS coupling FROM pairs JOIN stats sa ON sa.file = a JOIN stats sb ON sb.file = b)"""


@query(f"WITH {USABLE}, {PAIRS} SELECT a, b, shared, round(coupling, 6) AS coupling FROM kept WHERE coupling >= 0.3")
def d37_cochange(spark, d):
    return overlay.cochange(usable(spark, d)).select("a", "b", "shared", F.round("coupling", 6).alias("coupling"))


@query(f"""WITH {USABLE}, {PAIRS}, k AS (SELECT * FROM kept WHERE coupling >= 0.3), mods AS (SELECT concat('n', n_nationkey) AS key, concat('nation/', n_nationkey) AS module_path FROM nation)
 SELECT ma.key AS src, mb.key AS dst, round(coupling, 6) AS confidence FROM (SELECT a, b, coupling FROM k UNION ALL SELECT b, a, coupling FROM k) z(a, b, coupling) JOIN mods ma ON ma.module_path = a JOIN mods mb ON mb.module_path = b""")
def d39_changes_with(spark, d):
    commits = usable(spark, d)
    mods = view(spark, d, "SELECT concat('n', n_nationkey) AS key, concat('nation/', n_nationkey) AS module_path FROM nation")
    _, edges = overlay.apply_overlay(mods, mods, overlay.file_risk(overlay.file_stats(commits)), overlay.cochange(commits))
    return edges.select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {USABLE}, {PAIRS}, changed AS (SELECT unnest(['nation/1', 'nation/2']) AS m), k AS (SELECT a, b FROM kept WHERE coupling >= 0.5 UNION ALL SELECT b, a FROM kept WHERE coupling >= 0.5)
 SELECT DISTINCT b AS module_path FROM k WHERE a IN (SELECT m FROM changed) AND b NOT IN (SELECT m FROM changed)""")
def d41_missing_cochange(spark, d):
    mods = view(spark, d, "SELECT concat('n', n_nationkey) AS key, concat('nation/', n_nationkey) AS module_path FROM nation")
    commits = usable(spark, d)
    _, edges = overlay.apply_overlay(mods, mods, overlay.file_risk(overlay.file_stats(commits)), overlay.cochange(commits))
    return ranking.missing_cochange(mods, edges, rows(spark, "module_path string", ("nation/1",), ("nation/2",)))


@query("""WITH dep AS (SELECT dst AS key, count(DISTINCT src) AS dependents FROM g_edges WHERE src <> dst GROUP BY dst), n AS (SELECT g.key, coalesce(dependents, 0) AS dependents FROM g_nodes g LEFT JOIN dep ON dep.key = g.key)
 SELECT key, dependents, round((rank() OVER (ORDER BY dependents) - 1) / count(*) OVER (), 6) AS fanout FROM n""")
def e8_fanout(spark, d):
    return overlay.fanout(view(spark, d, "g_nodes"), view(spark, d, "g_edges")).select("key", "dependents", F.round("fanout", 6).alias("fanout"))


@query("""WITH tests AS (SELECT src FROM k_edges WHERE kind = 'Tests'), dep AS (SELECT dst AS key, count(DISTINCT src) AS dependents FROM k_edges WHERE kind NOT IN ('Tests', 'ChangesWith') AND src NOT IN (SELECT src FROM tests) GROUP BY dst),
 n AS (SELECT g.key, coalesce(dependents, 0) AS dependents FROM k_nodes g LEFT JOIN dep ON dep.key = g.key)
 SELECT key, round((rank() OVER (ORDER BY dependents) - 1) / count(*) OVER (), 6) AS composite FROM n""")
def e8_structural_risk(spark, d):
    return overlay.structural_risk(view(spark, d, "k_nodes"), view(spark, d, "k_edges")).select("key", F.round("composite", 6).alias("composite"))


@query("SELECT count(*) - count(DISTINCT (src, dst, kind)) AS repeated FROM g_edges")
def e12_repeated_edges(spark, d):
    return graph.repeated_edges(view(spark, d, "g_edges"))


@query("SELECT src, dst, kind, count(*) AS sites FROM g_edges WHERE dst = 's1' GROUP BY ALL")
def e13_call_sites(spark, d):
    hops = graph.neighbors(view(spark, d, "g_edges"), keys(spark, "s1"), "in")
    return hops.groupBy("src", "dst", "kind").agg(F.count("*").alias("sites"))


@query("""WITH sizes AS (SELECT commit, seq, count(DISTINCT file) AS n FROM g_commit_files GROUP BY ALL), el AS (SELECT *, row_number() OVER (ORDER BY seq, commit) AS i FROM sizes WHERE n BETWEEN 2 AND 40),
 c AS (SELECT max(CASE WHEN i <= 5 THEN seq END) AS s, max(CASE WHEN i <= 25 THEN seq END) AS t FROM el)
 SELECT commit, CASE WHEN seq <= s THEN 'skip' WHEN seq <= t THEN 'test' ELSE 'train' END AS part FROM sizes, c WHERE (seq <= s) OR (seq <= t AND n BETWEEN 2 AND 40) OR (seq > t AND n <= 40)""")
def k1_holdout(spark, d):
    return overlay.holdout(view(spark, d, "g_commit_files"), 20, 5).select("commit", "part")


@query("""WITH sizes AS (SELECT commit, seq, count(DISTINCT file) AS n FROM g_commit_files GROUP BY ALL), el AS (SELECT *, row_number() OVER (ORDER BY seq, commit) AS i FROM sizes WHERE n BETWEEN 2 AND 40),
 c AS (SELECT max(CASE WHEN i <= 50 THEN seq END) AS t FROM el), test AS (SELECT DISTINCT f.commit, file FROM g_commit_files f JOIN el ON el.commit = f.commit, c WHERE el.seq <= t),
 cf AS (SELECT DISTINCT f.commit, f.file FROM g_commit_files f JOIN sizes s ON s.commit = f.commit, c WHERE s.seq > t AND n <= 40), stats AS (SELECT file, count(DISTINCT commit) AS commits FROM cf GROUP BY file),
 pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS shared FROM cf x JOIN cf y ON x.commit = y.commit AND x.file < y.file GROUP BY ALL HAVING count(*) >= 2),
 kept AS (SELECT a, b FROM pairs JOIN stats sa ON sa.file = a JOIN stats sb ON sb.file = b WHERE shared / least(sa.commits, sb.commits) >= 0.3),
 sym AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept), reach AS (SELECT concat('nation/', x.n_nationkey) AS a, concat('nation/', y.n_nationkey) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey),
 tp AS (SELECT x.commit, x.file AS a, y.file AS b FROM test x JOIN test y ON x.commit = y.commit AND x.file <> y.file),
 h AS (SELECT EXISTS (SELECT 1 FROM reach r WHERE r.a = tp.a AND r.b = tp.b) AS g, EXISTS (SELECT 1 FROM sym s WHERE s.a = tp.a AND s.b = tp.b) AS k FROM tp)
 SELECT count(*) AS pairs, round(avg(CAST(g AS INT)), 6) AS static, round(avg(CAST(k AS INT)), 6) AS cochange, round(avg(CAST(g OR k AS INT)), 6) AS fused FROM h""")
def k2_recall(spark, d):
    files = view(spark, d, "g_commit_files")
    parts = overlay.holdout(files, 50)
    of = lambda p: files.join(parts.filter(F.col("part") == p).select("commit"), "commit", "left_semi")
    reach = view(spark, d, "SELECT concat('nation/', x.n_nationkey) AS a, concat('nation/', y.n_nationkey) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey")
    out = evaluation.cochange_recall(of("test"), reach, overlay.cochange(of("train")))
    return out.select("pairs", *(F.round(c, 6).alias(c) for c in ("static", "cochange", "fused")))


FIXED = "files AS (SELECT risk.*, CAST(substr(file, 8) AS INT) % 3 = 0 AS fixed FROM risk)"


def risk_files(spark, d):
    risk = overlay.file_risk(overlay.file_stats(usable(spark, d)))
    return risk.withColumn("fixed", F.substring("file", 8, 9).cast("int") % 3 == 0)


@query(f"""WITH {PERCENTILES}, {FIXED}, n AS (SELECT count(*) AS n, avg(CAST(fixed AS INT)) AS base FROM files), fr AS (SELECT unnest([0.1, 0.25]) AS fraction), tm AS (SELECT unnest(['churn', 'bug_density', 'ownership']) AS term),
 long AS (SELECT file, fixed, term, CASE term WHEN 'churn' THEN churn WHEN 'bug_density' THEN bug_density ELSE ownership END AS v FROM files, tm),
 r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY v DESC, file) AS r FROM long)
 SELECT term, CAST(fraction AS DOUBLE) AS fraction, CAST(greatest(1, round(n * fraction)) AS INT) AS k, round(avg(CAST(fixed AS INT)), 6) AS precision, round(base, 6) AS base, round(avg(CAST(fixed AS INT)) / base, 6) AS lift
 FROM r, fr, n WHERE r <= greatest(1, round(n * fraction)) GROUP BY term, fraction, n, base""")
def k3_risk_precision(spark, d):
    out = evaluation.risk_precision(risk_files(spark, d), ["churn", "bug_density", "ownership"])
    return out.select("term", "fraction", "k", F.round("precision", 6).alias("precision"), F.round("base", 6).alias("base"), F.round("lift", 6).alias("lift"))


# The steps of the weights that are tried.
GRID = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


@query(f"""WITH {PERCENTILES}, {FIXED}, f4 AS (SELECT *, (churn + ownership) / 2 AS fanout FROM files), s AS (SELECT CAST(unnest({GRID}) AS DOUBLE) AS v), g AS (SELECT a.v AS wc, b.v AS wb, c.v AS wo, d.v AS wf FROM s a, s b, s c, s d WHERE a.v + b.v + c.v + d.v > 0),
 r AS (SELECT wc, wb, wo, wf, fixed, row_number() OVER (PARTITION BY wc, wb, wo, wf ORDER BY round((wc * churn + wb * bug_density + wo * ownership + wf * fanout) / (wc + wb + wo + wf), 9) DESC, file) AS r FROM f4, g), n AS (SELECT greatest(1, round(count(*) * 0.25)) AS k FROM files)
 SELECT wc AS w_churn, wb AS w_bug_density, wo AS w_ownership, wf AS w_fanout, round(avg(CAST(fixed AS INT)), 6) AS precision FROM r, n WHERE r <= k GROUP BY ALL""")
def k4_weight_grid(spark, d):
    files = risk_files(spark, d).withColumn("fanout", (F.col("churn") + F.col("ownership")) / 2)
    out = evaluation.weight_grid(files, ["churn", "bug_density", "ownership", "fanout"], GRID)
    return out.select("w_churn", "w_bug_density", "w_ownership", "w_fanout", F.round("precision", 6).alias("precision"))


IDENT = "list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]{3,}'))"


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query, unnest({IDENT}) AS token FROM benchmark), t AS (SELECT DISTINCT doc_id AS file, unnest({IDENT}) AS token FROM documents),
 s AS (SELECT query, file, count(*) AS shared FROM q JOIN t ON q.token = t.token GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, file) AS rank FROM s)
 SELECT query, file, shared, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def k8_shared_identifiers(spark, d):
    q = view(spark, d, "SELECT item_id AS query, text FROM benchmark")
    t = view(spark, d, "SELECT doc_id AS file, text FROM documents")
    return evaluation.shared_identifier_ranking(q, t).filter("rank <= 10")


@query(f"""WITH q AS (SELECT DISTINCT item_id AS query, unnest({IDENT}) AS token FROM benchmark), t AS (SELECT DISTINCT doc_id AS file, unnest({IDENT}) AS token FROM documents),
 s AS (SELECT query, file, count(*) AS shared FROM q JOIN t ON q.token = t.token GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, file) AS rank FROM s),
 w AS (SELECT item_id AS query, unnest([item_id, item_id + 1, item_id + 2]) AS file FROM benchmark), h AS (SELECT w.query, r.rank FROM w LEFT JOIN r ON r.query = w.query AND r.file = w.file),
 p AS (SELECT query, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS recall, coalesce(1 / min(rank), 0) AS rr FROM h GROUP BY query)
 SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM p""")
def k8_recall_and_mrr(spark, d):
    q = view(spark, d, "SELECT item_id AS query, text FROM benchmark")
    t = view(spark, d, "SELECT doc_id AS file, text FROM documents")
    wanted = q.select("query", F.explode(F.array(F.col("query"), F.col("query") + 1, F.col("query") + 2)).alias("file"))
    out = evaluation.recall_and_mrr(evaluation.shared_identifier_ranking(q, t), wanted)
    return out.select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("""WITH o AS (SELECT DISTINCT concat('n', n_nationkey) AS target, concat('c', c_custkey) AS caller FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0),
 t AS (SELECT DISTINCT concat('n', c_nationkey) AS target, concat('c', c_custkey) AS caller FROM customer WHERE c_custkey % 4 > 0)
 SELECT coalesce(o.target, t.target) AS target, count(CASE WHEN o.caller IS NOT NULL AND t.caller IS NOT NULL THEN 1 END) AS agreed, count(CASE WHEN t.caller IS NULL THEN 1 END) AS only_ours, count(CASE WHEN o.caller IS NULL THEN 1 END) AS only_theirs
 FROM o FULL JOIN t ON o.target = t.target AND o.caller = t.caller GROUP BY 1""")
def k9_agreement(spark, d):
    base = "SELECT concat('n', c_nationkey) AS target, concat('c', c_custkey) AS caller FROM customer WHERE c_custkey % {} > 0"
    return evaluation.caller_agreement(view(spark, d, base.format(3)), view(spark, d, base.format(4)))


@query("""WITH b AS (SELECT l_orderkey AS fix, l_suppkey AS origin, l_partkey % 5 AS file, count(*) AS lines FROM lineitem GROUP BY ALL), t AS (SELECT fix, origin, sum(lines) AS lines FROM b GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY fix ORDER BY lines DESC, origin) AS r, sum(lines) OVER (PARTITION BY fix) AS al FROM t)
 SELECT fix, origin AS introducer, round(lines / al, 6) AS share FROM top WHERE r = 1 AND lines / al >= 0.6 AND fix % 40 >= 7""")
def k6_szz(spark, d):
    blamed = view(spark, d, "SELECT l_orderkey AS fix, l_suppkey AS origin, l_partkey % 5 AS file, count(*) AS lines FROM lineitem GROUP BY 1, 2, 3")
    fixes = blamed.select("fix").distinct()
    at = lambda days: F.timestamp_seconds(F.lit(86400) * days)
    one = [F.lit(3).alias("n_files"), F.lit(1).alias("n_parents")]
    # Fixes are dated by their number; what they blame is dated at the epoch.
    dated = fixes.select(F.col("fix").cast("string").alias("commit"), at(F.col("fix") % 40).alias("committed_at"), *one)
    ordered = blamed.select(F.col("fix").cast("string").alias("fix"), F.format_string("s%012d", "origin").alias("origin"), "file", "lines")
    old = ordered.select(F.col("origin").alias("commit")).distinct().select("commit", at(F.lit(0)).alias("committed_at"), *one)
    out = evaluation.szz_introducers(ordered, fixes.select(F.col("fix").cast("string").alias("fix")), dated.unionByName(old))
    return out.select(F.col("fix").cast("long").alias("fix"), F.substring("introducer", 2, 20).cast("long").alias("introducer"), F.round("share", 6).alias("share"))


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) WHERE i % (n // 7) = 0 AND i // (n // 7) < 7")
def f8_spread_sample(spark, d):
    return evaluation.spread_sample(view(spark, d, "SELECT p_partkey FROM part"), "p_partkey", 7)
