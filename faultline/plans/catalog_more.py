"""Queries of the remaining operators: externals, receivers, evaluation details, trees, sources (see ``catalog.py``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, graph, link, overlay, ranking
from ..schema import EPSILON
from .catalog import BACK, CHANGED_SYMS, PAIRS, PERCENTILES, STEPS, USABLE, diffusion_sql, query, risk_files, rows, usable
from .fixtures import view

IMPORTS = "SELECT concat('f', p_partkey) AS module_path, CASE p_partkey % 4 WHEN 0 THEN './local' WHEN 1 THEN concat('@org/', p_brand) ELSE concat(p_brand, '/sub') END AS spec, p_name AS imported, CASE WHEN p_partkey % 4 = 0 THEN 'x' END AS target FROM part"


@query(f"""WITH i AS (SELECT *, CASE WHEN spec LIKE '@%' THEN spec ELSE split_part(spec, '/', 1) END AS dep FROM ({IMPORTS}) WHERE target IS NULL)
 SELECT DISTINCT dep AS key FROM i UNION SELECT concat(dep, '.', imported) FROM i""")
def d9_external_nodes(spark, d):
    return link.external_nodes(view(spark, d, IMPORTS), F.lit("npm"))[0].select("key")


@query(f"SELECT DISTINCT module_path AS src, CASE WHEN spec LIKE '@%' THEN spec ELSE split_part(spec, '/', 1) END AS dst FROM ({IMPORTS}) WHERE target IS NULL")
def d9_external_edges(spark, d):
    return link.external_nodes(view(spark, d, IMPORTS), F.lit("npm"))[1].select("src", "dst")


HEAD_DEFS = "SELECT concat('p', p_partkey) AS key, p_name AS name, CAST(p_size AS INT) AS start_line FROM part"
HEAD_REFS = "SELECT l_orderkey * 10 + l_linenumber AS ref, concat('p', l_partkey) AS src, CASE WHEN l_linenumber < 3 THEN p_name ELSE 'other' END AS name, CAST(NULL AS STRING) AS qualifier, CAST(NULL AS STRING) AS recv_kind, CAST(CASE WHEN l_orderkey % 2 = 0 THEN p_size ELSE 0 END AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"SELECT r.ref FROM ({HEAD_REFS}) r JOIN ({HEAD_DEFS}) d ON d.key = r.src WHERE NOT (r.name = d.name AND r.line = d.start_line)")
def d12_header_suppression(spark, d):
    return link.without_headers(view(spark, d, HEAD_REFS), view(spark, d, HEAD_DEFS)).select("ref")


CANDS = "SELECT l_orderkey AS ref, concat('s', l_suppkey) AS dst, CAST(0.6 AS DOUBLE) AS base FROM lineitem"
CAND_REFS = "SELECT o_orderkey AS ref, concat('nation/', c_nationkey) AS module_path FROM orders JOIN customer ON c_custkey = o_custkey"
CAND_DEFS = "SELECT concat('s', s_suppkey) AS key, concat('nation/', s_nationkey) AS module_path FROM supplier"


@query(f"""WITH j AS (SELECT DISTINCT c.ref, c.dst, r.module_path = d.module_path AS l FROM ({CANDS}) c JOIN ({CAND_REFS}) r ON r.ref = c.ref JOIN ({CAND_DEFS}) d ON d.key = c.dst)
 SELECT ref, dst FROM (SELECT *, max(CAST(l AS INT)) OVER (PARTITION BY ref) AS b FROM j) WHERE CAST(l AS INT) = b""")
def d15_prefer_local(spark, d):
    return link.prefer_local(view(spark, d, CANDS), view(spark, d, CAND_REFS), view(spark, d, CAND_DEFS)).select("ref", "dst").distinct()


@query("SELECT * FROM (VALUES (1, 'util#load', 1), (2, 'requests.get', 2), (3, 'store#Store.save', 3), (4, 'store#Store.save', 3), (5, 'store#Store.save', 4), (6, 'a#A.go', 4), (6, 'b#B.go', 4)) v(ref, dst, rule_no)")
def d16_member_calls(spark, d):
    defs = rows(spark, "key string, root string, module_path string, name string, owner string, kind string, is_exported boolean",
                ("util#load", "r", "util", "load", None, "Function", True), ("store#Store.save", "r", "store", "save", "Store", "Method", True), ("a#A.go", "r", "a", "go", "A", "Method", True), ("b#B.go", "r", "b", "go", "B", "Method", True))
    refs = rows(spark, "ref int, root string, module_path string, name string, recv_kind string, recv_text string, recv_type string, this_owner string",
                (1, "r", "m", "load", "ident", "util", None, None), (2, "r", "m", "get", "ident", "requests", None, None), (3, "r", "m", "save", "ident", "s", "Store", None),
                (4, "r", "store", "save", "this", "self", None, "Store"), (5, "r", "m", "save", "ident", "util", "", None), (6, "r", "m", "go", "other", "x.y", None, None))
    imported = rows(spark, "module_path string, local string, imported string, target_module string, dep string", ("m", "util", "*", "util", None), ("m", "requests", "*", None, "requests"))
    return link.member_calls(refs, defs, imported).select("ref", "dst", "rule_no")


VERDICTS = "SELECT concat('h', user_id) AS hash, event_id AS src, event_type AS kind, value AS verdict FROM events"
CONTENT = "SELECT concat('h', c_custkey) AS hash FROM customer WHERE c_acctbal > 0"


@query(f"SELECT v.* FROM ({VERDICTS}) v WHERE hash IN (SELECT hash FROM ({CONTENT})) AND kind IN ('click', 'purchase')")
def d46_verdict_replay(spark, d):
    return link.replayed(view(spark, d, VERDICTS), view(spark, d, CONTENT), ["click", "purchase"])


@query(f"WITH {USABLE} SELECT file, round(CASE WHEN commits = 0 THEN 0 ELSE fixes / commits END, 6) AS fix_ratio FROM stats")
def e4_fix_ratio(spark, d):
    s = overlay.file_stats(usable(spark, d))
    return s.select("file", F.round(overlay.ratio(F.col("fixes"), F.col("commits")), 6).alias("fix_ratio"))


@query(f"WITH {PERCENTILES} SELECT max(churn) > min(churn) AS churn, max(bug_density) > min(bug_density) AS bug_density, max(ownership) > min(ownership) AS ownership FROM risk")
def e6_informative(spark, d):
    return overlay.informative(risk_files(spark, d), ["churn", "bug_density", "ownership"])


@query(f"WITH {USABLE}, {PAIRS}, k AS (SELECT * FROM kept WHERE coupling >= 0.3) SELECT file, round(max(coupling), 6) AS coupling FROM (SELECT a AS file, coupling FROM k UNION ALL SELECT b, coupling FROM k) GROUP BY file")
def e17_max_coupling(spark, d):
    return overlay.max_coupling(overlay.cochange(usable(spark, d))).select("file", F.round("coupling", 6).alias("coupling"))


@query("SELECT l_orderkey, round(product(1 - l_discount / 3), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def e18_route_confidence(spark, d):
    t = view(spark, d, "SELECT l_orderkey, collect_list(1 - l_discount / 3) AS c FROM lineitem GROUP BY l_orderkey")
    return t.select("l_orderkey", F.round(graph.route_confidence(F.col("c")), 6).alias("confidence"))


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) - 1 AS place FROM part")
def f1_shared_rank(spark, d):
    return ranking.shared_rank(view(spark, d, "SELECT p_partkey, p_size FROM part"), "p_size").select("p_partkey", "place")


@query("""SELECT * FROM (VALUES ('e', NULL, 0, 'e'), ('a', 'Calls', 1, 'e/a:Calls'), ('d', 'Calls', 1, 'e/d:Calls'), ('b', 'Calls', 2, 'e/a:Calls/b:Calls'), ('xg', 'Calls', 2, 'e/a:Calls/xg:Calls'),
 ('x', 'Imports', 2, 'e/a:Calls/x:Imports'), ('xg', 'References', 2, 'e/d:Calls/xg:References')) v(key, kind, depth, sort_path)""")
def g8_hop_tree(spark, d):
    return graph.tree(view(spark, d, "k_edges"), "e", 2).select("key", "kind", "depth", "sort_path")


@query("SELECT * FROM (VALUES ('app', '/a/app', 0), ('app~2', '/b/app', 1), ('web', '/web', 2)) v(tag, path, ord)")
def i15_root_tags(spark, d):
    from ..sources.files import roots_table

    return roots_table(spark, ["/a/app/", "/b/app", "/web"]).select("tag", "path", "ord")


@query("SELECT * FROM (VALUES ('Mod.fun/2', 'fun'), ('fun(a, b)', 'fun'), ('fun', 'fun')) v(spelling, bare)")
def i14_bare_names(spark, d):
    return rows(spark, "spelling string", ("Mod.fun/2",), ("fun(a, b)",), ("fun",)).select("spelling", T.bare_name(F.col("spelling")).alias("bare"))


@query("SELECT * FROM (VALUES ('@app/*', 'src/*', 0, './x'), ('@app/*', 'lib/*', 1, './x'), ('exact', 'src/e.ts', 2, './x')) v(pattern, target, ord, base_url)")
def a10_tsconfig(spark, d):
    from ..sources.config import tsconfig_paths

    text = '{ // comment\n "compilerOptions": {"baseUrl": "./x", "paths": {"@app/*": ["src/*", "lib/*",], /* more */ "exact": ["src/e.ts"],},},}'
    return rows(spark, "pattern string, target string, ord int, base_url string", *tsconfig_paths(text))


@query("SELECT * FROM (VALUES ('npm', '@org/a', 'packages/a'), ('npm', 'root', ''), ('go', 'example.com/m', 'svc')) v(kind, name, dir)")
def a11_packages(spark, d):
    from ..sources.config import go_modules, package_dirs

    files = rows(spark, "module_path string, content binary", ("packages/a/package.json", b'{"name": "@org/a"}'), ("package.json", b'{"name": "root"}'), ("x/package.json", b"{}"), ("svc/go.mod", b"module example.com/m\n\ngo 1.22\n"))
    npm = package_dirs(files).select(F.lit("npm").alias("kind"), "name", "dir")
    return npm.unionByName(go_modules(files).select(F.lit("go").alias("kind"), F.col("module").alias("name"), "dir"))


@query("SELECT * FROM (VALUES ('api.json', 'GET', '/v1/users/{id}'), ('api.json', 'POST', '/v1/users')) v(module_path, method, path)")
def a6_api_specs(spark, d):
    from ..sources.config import read_specs

    text = b'{\n"swagger": "2.0",\n"basePath": "/v1",\n"paths": {"/users/{id}": {"get": {}}, "/users": {"post": {}, "parameters": []}}}'
    return read_specs(rows(spark, "module_path string, content binary", ("api.json", text), ("other.json", b'{"paths": 1}')))


SOURCE = 'import os.path\nfrom .util import load as l\n\n\nclass A(B):\n    """Doc."""\n\n    def go(self, x: Store):\n        self.run(x)\n        return l(x.save())\n\n\ndef _hidden():\n    A().go(1)\n'


@query("SELECT * FROM (VALUES ('def', 'A', 'A', 'Class', 5, true), ('def', 'go', 'A.go', 'Method', 8, true), ('def', '_hidden', '_hidden', 'Function', 13, false)) v(fact, name, qualified_name, kind, start_line, is_exported)")
def c2_definitions(spark, d):
    from ..extract.base import extract

    files = rows(spark, "module_path string, root string, language string, content binary", ("a.py", "r", "python", SOURCE.encode()))
    return extract(files).filter("fact = 'def'").select("fact", "name", "qualified_name", "kind", "start_line", "is_exported")


@query("SELECT * FROM (VALUES ('import', 'os.path', '*', 'os'), ('import', '.util', 'load', 'l')) v(fact, spec, imported, local)")
def c3_imports(spark, d):
    from ..extract.base import extract

    files = rows(spark, "module_path string, root string, language string, content binary", ("a.py", "r", "python", SOURCE.encode()))
    return extract(files).filter("fact = 'import'").select("fact", "spec", "imported", "local")


@query("SELECT * FROM (VALUES ('run', 'this', 'self', 9), ('l', NULL, NULL, 10), ('save', 'ident', 'x', 10), ('go', 'new', 'A', 14), ('A', NULL, NULL, 14)) v(name, recv_kind, recv_text, line)")
def c5_references(spark, d):
    from ..extract.base import extract

    files = rows(spark, "module_path string, root string, language string, content binary", ("a.py", "r", "python", SOURCE.encode()))
    return extract(files).filter("fact = 'ref'").select("name", "recv_kind", "recv_text", F.col("start_line").alias("line"))


@query("SELECT * FROM (VALUES ('game', NULL), ('game/name', NULL), ('game/team', NULL), (NULL, 'TeamBits'), ('id', NULL)) v(path, spread)")
def c16_graphql_paths(spark, d):
    from ..extract.base import extract

    text = "query Q($x: ID!) { alias: game(id: $x) @skip(if: false) { name team { ...TeamBits } } }\nfragment TeamBits on Team { id }\n"
    files = rows(spark, "module_path string, root string, language string, content binary", ("q.graphql", "r", "graphql", text.encode()))
    return extract(files).filter("fact IN ('consume', 'spread')").select("path", F.when(F.col("fact") == "spread", F.col("name")).alias("spread"))


@query("""SELECT * FROM (VALUES ('elixir', true, true, false), ('gleam', true, true, false), ('go', true, true, true), ('graphql', false, false, false), ('html', false, false, false),
 ('php', true, true, false), ('python', true, true, true), ('ruby', true, true, false), ('rust', true, true, true), ('svelte', true, true, true), ('tsx', true, true, true),
 ('typescript', true, true, true), ('vue', true, true, true)) v(language, imports, refs, binds)""")
def c18_capabilities(spark, d):
    from ..extract.base import capabilities

    return rows(spark, "language string, imports boolean, refs boolean, binds boolean", *capabilities())


@query(f"WITH {PERCENTILES}, f AS (SELECT *, CAST(substr(file, 8) AS INT) % 3 = 0 AS fixed, round((0.5 * churn + bug_density) / 1.5, 9) AS score FROM risk), n AS (SELECT greatest(1, round(count(*) * 0.25)) AS k FROM f), r AS (SELECT fixed, row_number() OVER (ORDER BY score DESC, file) AS r FROM f) SELECT CAST(k AS INT) AS k, round(avg(CAST(fixed AS INT)), 6) AS precision FROM r, n WHERE r <= k GROUP BY k")
def k5_given_weights(spark, d):
    files = risk_files(spark, d).withColumn("score", F.round((0.5 * F.col("churn") + F.col("bug_density")) / 1.5, 9))
    return overlay.precision_at(files, "score", 0.25).select("k", F.round("precision", 6).alias("precision"))


#: Cases: what changed in the customers of a nation; the culprit is the file of the first of them.
CASES = "SELECT concat('n', c_nationkey) AS case, g.module_path, g.from_line, g.to_line FROM (SELECT * FROM g_changed) g JOIN customer ON g.module_path = concat('customer/', c_custkey)"


@query(f"""WITH RECURSIVE {CHANGED_SYMS}, steps AS {STEPS % ('(' + BACK + ')')}, t(seed, key, w) AS (
   SELECT key, key, CAST(1 AS DOUBLE) FROM syms UNION ALL SELECT t.seed, s.src, t.w * s.f FROM t JOIN steps s ON s.dst = t.key WHERE t.w * s.f >= {EPSILON}),
 best AS (SELECT seed, key, max(w) AS w FROM t GROUP BY ALL), down AS (SELECT seed, sum(w) AS down_weight FROM best WHERE seed <> key GROUP BY seed),
 r AS (SELECT c_nationkey AS nation_no, c_custkey, y.key, n.module_path, n.qualified_name,
   (1 + n.composite) * (1 + ln(1 + coalesce(down_weight, 0))) * (1 + ln(1 + changed_lines) * (0.5 + 0.5 * least(1, changed_lines / total_lines))) AS p
   FROM syms y JOIN g_nodes n ON n.key = y.key JOIN customer ON n.module_path = concat('customer/', c_custkey) LEFT JOIN down ON down.seed = y.key),
 k AS (SELECT *, row_number() OVER (PARTITION BY nation_no ORDER BY round(p, 9) DESC, module_path, qualified_name, key) AS rank, count(*) OVER (PARTITION BY nation_no) AS total, min(c_custkey) OVER (PARTITION BY nation_no) AS first FROM r),
 c AS (SELECT nation_no, min(rank) AS rank, min(total) AS total FROM k WHERE c_custkey = first GROUP BY nation_no)
 SELECT count(*) AS cases, round(avg(CASE WHEN total > 1 THEN (rank - 1) / (total - 1) ELSE 0 END), 6) AS mean_rank, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS hit_rate,
   round(0.5 / avg(CASE WHEN total > 1 THEN (rank - 1) / (total - 1) ELSE 0 END), 6) AS lift FROM c""")
def k7_normalized_ranks(spark, d):
    from .fixtures import VIEWS

    nodes = view(spark, d, "g_nodes")
    spans = nodes.filter("kind = 'Function' AND key LIKE 'o%'")
    changed = view(spark, d, CASES.replace("SELECT * FROM g_changed", VIEWS["g_changed"]))
    syms = ranking.changed_symbols(spans, changed).join(nodes.select("key", "module_path"), "key")
    culprits = syms.join(changed.select("case", "module_path").distinct(), "module_path").groupBy("case").agg(F.min_by("module_path", F.substring("module_path", 10, 20).cast("long")).alias("module_path"))
    reviews = ranking.review_by_case(nodes, view(spark, d, BACK.replace("g_edges", "(" + VIEWS["g_edges"] + ") g")), spans, changed)
    out = evaluation.normalized_ranks(evaluation.culprit_ranks(reviews, culprits), 3)
    return out.select("cases", *(F.round(c, 6).alias(c) for c in ("mean_rank", "hit_rate", "lift")))


SUPPLIERS = "SELECT concat('s', s_suppkey) AS query, concat('s', s_suppkey) AS key FROM supplier"


@query(diffusion_sql("g_edges", "SELECT query AS seed, key FROM (" + SUPPLIERS + ")") + """
 , files AS (SELECT h.seed AS query, n.module_path AS file, max(h.w * (1 + n.composite)) AS score FROM hits h JOIN g_nodes n ON n.key = h.key GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, file) AS rank FROM files),
 wanted AS (SELECT DISTINCT concat('s', l_suppkey) AS query, concat('customer/', o_custkey) AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49),
 h AS (SELECT w.query, r.rank FROM wanted w LEFT JOIN r ON r.query = w.query AND r.file = w.file), p AS (SELECT query, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS recall, coalesce(1 / min(rank), 0) AS rr FROM h GROUP BY query)
 SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, (SELECT round(least(1, 10 / count(DISTINCT module_path)), 6) FROM g_nodes) AS floor FROM p""")
def k8_impact_ranking(spark, d):
    nodes = view(spark, d, "g_nodes")
    ranked = evaluation.impact_ranking(nodes, view(spark, d, "g_edges"), view(spark, d, SUPPLIERS))
    wanted = view(spark, d, "SELECT DISTINCT concat('s', l_suppkey) AS query, concat('customer/', o_custkey) AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 49")
    out = evaluation.recall_and_mrr(ranked, wanted)
    floor = evaluation.random_floor(nodes.select("module_path").distinct().count())
    return out.select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round(F.lit(floor), 6).alias("floor"))


SALES = "SELECT DISTINCT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, 'Calls' AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.1"
PEOPLE = "SELECT concat('c', c_custkey) AS key, concat('nation/', c_nationkey) AS module_path FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('nation/', s_nationkey) FROM supplier"


@query(f"SELECT DISTINCT a.module_path AS a, b.module_path AS b FROM ({SALES}) e JOIN ({PEOPLE}) a ON a.key = e.src JOIN ({PEOPLE}) b ON b.key = e.dst WHERE a.module_path <> b.module_path")
def k2_module_reach(spark, d):
    nodes = view(spark, d, PEOPLE)
    return evaluation.module_reach(nodes, view(spark, d, SALES), nodes.select(F.col("module_path").alias("file")).distinct(), ["Calls", "Imports", "GraphqlCall", "DbQuery"])


@query("SELECT 'A' AS from_snapshot, count(*) AS n FROM nation UNION ALL SELECT 'B', count(*) FROM region")
def b2_snapshot_roundtrip(spark, d):
    import uuid

    from ..store import SnapshotStore
    from .lineage import shared_dir

    store = SnapshotStore(spark, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    store.write({"t": view(spark, d, "SELECT n_name FROM nation")}, "one")
    first = store.read("t").agg(F.lit("A").alias("from_snapshot"), F.count("*").alias("n"))
    store.write({"t": view(spark, d, "SELECT r_name FROM region")}, "one")
    return first.unionByName(store.read("t").agg(F.lit("B").alias("from_snapshot"), F.count("*").alias("n")))


@query("""SELECT p_partkey, p_name = 'steel ring' AS eq, p_name <> 'steel ring' AS neq, p_brand IN ('Brand#1', 'Brand#2') AS any_of, p_brand NOT IN ('Brand#1', 'Brand#2') AS none_of,
 regexp_matches(p_type, 'S[A-Z]+') AS matches, NOT regexp_matches(p_type, 'S[A-Z]+') AS no_match FROM part""")
def c10_predicates(spark, d):
    t = view(spark, d, "SELECT p_partkey, p_name, p_brand, p_type FROM part")
    return t.select("p_partkey", T.predicate("eq?", F.col("p_name"), "steel ring").alias("eq"), T.predicate("not-eq?", F.col("p_name"), "steel ring").alias("neq"),
                    T.predicate("any-of?", F.col("p_brand"), "Brand#1", "Brand#2").alias("any_of"), T.predicate("not-any-of?", F.col("p_brand"), "Brand#1", "Brand#2").alias("none_of"),
                    T.predicate("match?", F.col("p_type"), "S[A-Z]+").alias("matches"), T.predicate("not-match?", F.col("p_type"), "S[A-Z]+").alias("no_match"))
