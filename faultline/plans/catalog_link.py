"""Queries of the linker, the route matcher and the scalar functions (see ``catalog.py``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import link, overlay, routes
from ..schema import IGNORED_DIRS, LANGUAGES, STOPWORDS
from .catalog import keys, query, rows
from .fixtures import view

PATHS = "SELECT page_id, concat(CASE page_id % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'lib/dist/' WHEN 2 THEN 'distx/' ELSE 'src/' END, 'f', page_id, CASE page_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.js' WHEN 3 THEN '_test.go' WHEN 4 THEN '.txt' ELSE '.rb' END) AS path FROM pages"


@query(f"SELECT page_id FROM ({PATHS}) WHERE len(list_intersect(string_split(path, '/')[1:-2], {IGNORED_DIRS!r})) = 0")
def a2_ignored_directories(spark, d):
    return view(spark, d, PATHS).filter(~T.is_ignored(F.col("path"))).select("page_id")


LANG_SQL = "CASE " + " ".join(f"WHEN ends_with(path, '{s}') THEN '{lang}'" for lang, ss in LANGUAGES.items() for s in ss) + " END"


@query(f"SELECT page_id, {LANG_SQL} AS language, coalesce(CASE {LANG_SQL} WHEN 'python' THEN regexp_matches(path, '(^|/)test_[^/]*$|_test\\.py$|(^|/)tests/') WHEN 'typescript' THEN regexp_matches(path, '(\\.test\\.|\\.spec\\.)[^/]*$|(^|/)(__tests__|test|tests|spec)/') WHEN 'tsx' THEN regexp_matches(path, '(\\.test\\.|\\.spec\\.)[^/]*$|(^|/)(__tests__|test|tests|spec)/') WHEN 'go' THEN regexp_matches(path, '_test\\.go$') WHEN 'ruby' THEN regexp_matches(path, '(_spec|_test)\\.rb$|(^|/)(spec|test)/') END, false) AS is_test FROM ({PATHS})")
def a3_adapter_dispatch(spark, d):
    lang = T.language_of(F.col("path"))
    return view(spark, d, PATHS).select("page_id", lang.alias("language"), F.coalesce(T.is_test_path(F.col("path"), lang), F.lit(False)).alias("is_test"))


ROOTED = "SELECT concat('/w/', lower(r_name), '/', n_name, '/', c_custkey) AS canonical, roots.tag FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey CROSS JOIN (VALUES ('all', '/w'), ('asia', '/w/asia'), ('china', '/w/asia/CHINA')) AS roots(tag, path) WHERE concat('/w/', lower(r_name), '/', n_name, '/', c_custkey) LIKE concat(roots.path, '/%')"


@query(f"SELECT canonical, max_by(tag, CASE tag WHEN 'all' THEN 1 WHEN 'asia' THEN 2 ELSE 3 END) AS tag FROM ({ROOTED}) GROUP BY canonical")
def a4_nested_roots(spark, d):
    from ..sources.files import claim

    roots = rows(spark, "tag string, path string", ("all", "/w"), ("asia", "/w/asia"), ("china", "/w/asia/CHINA"))
    return claim(view(spark, d, ROOTED), roots).select("canonical", "tag")


OLD, NEW = ("SELECT concat('o', o_orderkey) AS module_path, o_orderstatus AS hash FROM orders WHERE o_orderkey % 10 > 0", "SELECT concat('o', o_orderkey) AS module_path, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 9 > 0")


@query(f"SELECT CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS files FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.module_path = n.module_path GROUP BY 1")
def a5_incremental_state(spark, d):
    from ..sources.files import changes

    return changes(view(spark, d, NEW), view(spark, d, OLD)).groupBy("state").agg(F.count("*").alias("files"))


SHARED = "SELECT concat('root', p_partkey % 3) AS root, CASE WHEN p_partkey % 50 = 0 THEN concat('pkg', p_partkey) ELSE p_name END AS name FROM part"


@query(f"WITH p AS (SELECT DISTINCT root, name FROM ({SHARED})), once AS (SELECT name, min(root) AS home FROM p GROUP BY name HAVING count(*) = 1), r AS (SELECT DISTINCT root FROM p) SELECT r.root, once.name, home FROM r, once WHERE r.root <> home")
def a12_shared_packages(spark, d):
    from ..sources.config import shared_packages

    return shared_packages(view(spark, d, SHARED))


EXPORTS = "SELECT concat('b', p_brand) AS module_path, p_type AS name, concat('p', p_partkey) AS key, CAST(p_partkey AS INT) AS ord, p_size > 10 AS is_exported FROM part"


@query(f"SELECT module_path, name, max_by(key, ord) AS key FROM ({EXPORTS}) WHERE is_exported GROUP BY ALL")
def d5_exports(spark, d):
    return link.exports(view(spark, d, EXPORTS))


MODULES = "SELECT concat('m', p_partkey % 900) AS module_path, concat('p', p_partkey) AS key, p_size > 10 AS is_exported FROM part"


@query(f"SELECT module_path, min(key) AS key FROM ({MODULES}) WHERE is_exported GROUP BY module_path HAVING count(DISTINCT key) = 1")
def d7_default_exports(spark, d):
    return link.default_exports(view(spark, d, MODULES))


@query("SELECT * FROM (VALUES ('index.ts', 'Button', 'b1'), ('index.ts', 'Card', 'c1'), ('index.ts', 'Alias', 'x1'), ('deep.ts', 'Button', 'b1')) v(module_path, name, key)")
def d6_reexport_chain(spark, d):
    exported = rows(spark, "module_path string, name string, key string", ("button.ts", "Button", "b1"), ("card.ts", "Card", "c1"), ("other.ts", "Card", "c2"), ("x.ts", "Inner", "x1"))
    re = rows(spark, "module_path string, name string, source_name string, target_module string, ord int",
              ("index.ts", "Button", "Button", "button.ts", 0), ("index.ts", "*", "*", "barrel.ts", 1), ("index.ts", "*", "*", "other.ts", 2), ("index.ts", "Alias", "Inner", "x.ts", 3),
              ("barrel.ts", "*", "*", "card.ts", 0), ("deep.ts", "*", "*", "index.ts", 0), ("far.ts", "*", "*", "d1.ts", 0), ("d1.ts", "*", "*", "d2.ts", 0), ("d2.ts", "*", "*", "d3.ts", 0), ("d3.ts", "*", "*", "deep.ts", 0))
    wanted = rows(spark, "module_path string, name string", ("index.ts", "Button"), ("index.ts", "Card"), ("index.ts", "Alias"), ("index.ts", "Nope"), ("deep.ts", "Button"), ("far.ts", "Button"))
    return link.follow_reexports(wanted, exported, re)


SPECS = "SELECT * FROM (VALUES ('npm', '@org/pkg/sub'), ('npm', 'lodash/fp'), ('npm', './x'), ('npm', '@org'), ('python', 'os.path'), ('python', '.rel'), ('go', 'github.com/a/b'), ('go', 'net/http'), ('ruby', 'active_record/base'), ('php', '\\Guzzle\\Client')) AS v(eco, spec)"


@query("SELECT * FROM (VALUES ('npm', '@org/pkg/sub', '@org/pkg'), ('npm', 'lodash/fp', 'lodash'), ('npm', './x', NULL), ('npm', '@org', NULL), ('python', 'os.path', 'os'), ('python', '.rel', NULL), ('go', 'github.com/a/b', 'github.com/a/b'), ('go', 'net/http', NULL), ('ruby', 'active_record/base', 'active_record'), ('php', '\\Guzzle\\Client', 'Guzzle')) v(eco, spec, dep)")
def d10_dependency_keys(spark, d):
    out = rows(spark, "eco string, spec string", ("npm", "@org/pkg/sub"), ("npm", "lodash/fp"), ("npm", "./x"), ("npm", "@org"), ("python", "os.path"), ("python", ".rel"),
               ("go", "github.com/a/b"), ("go", "net/http"), ("ruby", "active_record/base"), ("php", "\\Guzzle\\Client"))
    return out.withColumn("dep", T.dependency_key(F.col("spec"), F.col("eco")))


@query("SELECT * FROM (VALUES ('src/app.ts', './util', 'src/util.ts'), ('src/app.ts', './ui', 'src/ui/index.tsx'), ('src/app.ts', './cause.js', 'src/cause.ts'), ('src/app.ts', '@app/x', 'src/x.ts'), ('src/app.ts', '@org/a/sub/y', 'pk/sub/y.ts'), ('src/app.ts', '@org/a', 'pk/a/src/index.ts'), ('src/app.ts', 'react', NULL), ('src/deep/b.ts', '../util', 'src/util.ts')) v(module_path, spec, target)")
def d1_resolve_imports(spark, d):
    imports = rows(spark, "module_path string, spec string", *(("src/app.ts", s) for s in ("./util", "./ui", "./cause.js", "@app/x", "@org/a/sub/y", "@org/a", "react")), ("src/deep/b.ts", "../util"))
    files = rows(spark, "module_path string", *((p,) for p in ("src/app.ts", "src/util.ts", "src/ui/index.tsx", "src/cause.ts", "src/x.ts", "pk/sub/y.ts", "pk/a/src/index.ts", "pk/a/sub/y.ts")))
    ts = rows(spark, "pattern string, target string, ord int, base_url string", ("@app/*", "src/*", 0, "."))
    packages = rows(spark, "name string, dir string", ("@org/a", "pk/a"), ("@org/a/sub", "pk/sub"))
    return link.resolve_imports(imports, files, ts, packages).select("module_path", "spec", "target")


@query("SELECT * FROM (VALUES ('pkg/sub/m.py', 'util', 'pkg/util.py'), ('pkg/sub/m.py', '.near', 'pkg/sub/near.py'), ('pkg/sub/m.py', '..', 'pkg/__init__.py'), ('pkg/sub/m.py', 'pkg.util', 'pkg/util.py')) v(module_path, spec, target)")
def d4_python_imports(spark, d):
    imports = rows(spark, "module_path string, spec string", *(("pkg/sub/m.py", s) for s in ("util", ".near", "..", "pkg.util", "os")))
    files = rows(spark, "module_path string", *((p,) for p in ("pkg/util.py", "pkg/sub/near.py", "pkg/__init__.py", "util.py", "pkg/sub/m.py")))
    return link.python_candidates(imports, files)


SPANS = "SELECT concat('nation/', s_nationkey) AS module_path, concat('s', s_suppkey) AS key, CAST(s_suppkey AS INT) AS start_line, CAST(s_suppkey * 2 AS INT) AS end_line FROM supplier"
POINTS = "SELECT c_custkey AS ref, concat('nation/', c_nationkey) AS module_path, CAST(c_custkey % 200 AS INT) AS line FROM customer"


@query(f"SELECT p.ref, (SELECT key FROM ({SPANS}) s WHERE s.module_path = p.module_path AND s.start_line <= p.line AND p.line <= s.end_line ORDER BY start_line DESC, end_line, key LIMIT 1) AS container FROM ({POINTS}) p")
def d11_enclosing_latest(spark, d):
    return link.enclosing(view(spark, d, POINTS), view(spark, d, SPANS), "ref").select("ref", "container")


@query(f"SELECT p.ref, (SELECT key FROM ({SPANS}) s WHERE s.module_path = p.module_path AND s.start_line <= p.line AND p.line <= s.end_line ORDER BY end_line - start_line, start_line DESC, key LIMIT 1) AS container FROM ({POINTS}) p")
def d25_enclosing_smallest(spark, d):
    return link.enclosing(view(spark, d, POINTS), view(spark, d, SPANS), "ref", "smallest").select("ref", "container")


@query(f"WITH s AS (SELECT *, max(end_line) OVER (PARTITION BY module_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({SPANS})), i AS (SELECT *, sum(CASE WHEN start_line > b + 1 OR b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY module_path ORDER BY start_line, end_line) AS isle FROM s) SELECT module_path, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY module_path, isle")
def c8_merged_regions(spark, d):
    return link.merged_regions(view(spark, d, SPANS))


@query(f"SELECT ref FROM ({POINTS}) p WHERE NOT EXISTS (SELECT 1 FROM ({SPANS}) s WHERE s.module_path = p.module_path AND s.start_line <= p.line AND p.line <= s.end_line)")
def c9_outside_regions(spark, d):
    return link.outside(view(spark, d, POINTS), view(spark, d, SPANS)).select("ref")


PURCHASES, CLICKS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'", "SELECT user_id, ts, event_id AS click FROM events WHERE event_type = 'click'"


@query(f"SELECT p.event_id, c.click FROM ({PURCHASES}) p ASOF LEFT JOIN ({CLICKS}) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def d17_as_of(spark, d):
    return link.as_of(view(spark, d, PURCHASES), view(spark, d, CLICKS), ["user_id"], "ts", "click").select("event_id", "click")


BINDS = "SELECT concat('f', user_id) AS module_path, 'x' AS name, CAST(event_id AS INT) AS line, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('T', event_id % 5) END AS type, 0 AS scope_start, CAST(event_id + 4000 AS INT) AS scope_end FROM events WHERE event_type = 'click'"
RECV = "SELECT event_id AS ref, concat('f', user_id) AS module_path, CAST(event_id AS INT) AS line, 'ident' AS recv_kind, 'x' AS recv_text FROM events WHERE event_type = 'purchase'"


@query(f"SELECT r.ref, (SELECT type FROM ({BINDS}) b WHERE b.module_path = r.module_path AND b.line <= r.line AND r.line <= b.scope_end ORDER BY line DESC, type DESC LIMIT 1) AS recv_type FROM ({RECV}) r")
def d17_receiver_types(spark, d):
    return link.receiver_types(view(spark, d, RECV), view(spark, d, BINDS)).select("ref", "recv_type")


DEFS = "SELECT concat('p', p_partkey) AS key, p_brand AS root, p_type AS module_path, p_name AS name, p_brand AS owner, CASE p_partkey % 4 WHEN 0 THEN 'Field' ELSE 'Function' END AS kind FROM part WHERE p_partkey % 11 < 6"
REFS = "SELECT l_orderkey * 10 + l_linenumber AS ref, p_brand AS root, p_type AS module_path, p_name AS name, CASE l_linenumber % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'lower' ELSE 'Upper' END AS qualifier, concat('p', l_suppkey) AS src, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 5 = 0"


@query(f"""WITH d AS ({DEFS}), r AS ({REFS}), a AS (SELECT ref, d.key AS dst, 0.9 AS base, 1 AS n FROM r JOIN d ON d.root = r.root AND d.owner = r.qualifier AND d.name = r.name),
 s AS (SELECT ref, NULL AS dst, NULL AS base, 2 AS n FROM r WHERE regexp_matches(qualifier, '^[A-Z]')), b AS (SELECT ref, d.key AS dst, 0.75 AS base, 3 AS n, count(*) OVER (PARTITION BY ref) AS c FROM r JOIN d ON d.root = r.root AND d.name = r.name),
 u AS (SELECT * FROM a UNION ALL SELECT * FROM s UNION ALL SELECT ref, dst, base, n FROM b WHERE c <= 4)
 SELECT ref, dst, CAST(base AS DOUBLE) AS base, n AS rule_no FROM (SELECT *, min(n) OVER (PARTITION BY ref) AS m FROM u) WHERE n = m""")
def d14_qualified_calls(spark, d):
    return link.qualified_calls(view(spark, d, REFS), view(spark, d, DEFS)).select("ref", "dst", "base", "rule_no")


@query(f"""WITH d AS ({DEFS}), r AS ({REFS}), im AS (SELECT module_path, name, min(key) AS key FROM d GROUP BY ALL), a AS (SELECT ref, d.key AS dst, 1 AS n FROM r JOIN d ON d.module_path = r.module_path AND d.name = r.name AND kind <> 'Field'),
 b AS (SELECT ref, im.key AS dst, 2 AS n FROM r JOIN im ON im.module_path = r.module_path AND im.name = r.name), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
 SELECT ref, dst, n AS rule_no FROM (SELECT *, min(n) OVER (PARTITION BY ref) AS m FROM u) WHERE n = m""")
def d13_bare_calls(spark, d):
    defs = view(spark, d, DEFS)
    imported = defs.groupBy("module_path", F.col("name").alias("local")).agg(F.min("key").alias("key"))
    return link.bare_calls(view(spark, d, REFS), defs, imported).select("ref", "dst", "rule_no")


@query(f"""WITH d AS ({DEFS}), r AS ({REFS}), h AS (SELECT DISTINCT ref, d.key AS dst FROM r JOIN d ON d.root = r.root AND d.name = r.name), n AS (SELECT ref, dst, 0.6 / count(*) OVER (PARTITION BY ref) AS confidence FROM h)
 SELECT r.src, n.dst, r.line, round(n.confidence, 6) AS confidence, count(*) AS sites FROM n JOIN r ON r.ref = n.ref WHERE r.src <> n.dst GROUP BY ALL""")
def d19_call_edges(spark, d):
    refs, defs = view(spark, d, REFS), view(spark, d, DEFS)
    return link.named_call_edges(refs, defs, ["root", "name"], 0.6)


@query("""WITH root_of AS (SELECT concat('c', c_custkey) AS key, concat('n', c_nationkey) AS root FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier),
 e AS (SELECT DISTINCT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 SELECT src, dst, CASE WHEN a.root <> b.root THEN round(0.9 * 0.85, 6) ELSE 0.9 END AS confidence FROM e LEFT JOIN root_of a ON a.key = src LEFT JOIN root_of b ON b.key = dst""")
def d20_cross_root(spark, d):
    root_of = view(spark, d, "SELECT concat('c', c_custkey) AS key, concat('n', c_nationkey) AS root FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier")
    edges = view(spark, d, "SELECT DISTINCT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, CAST(0.9 AS DOUBLE) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    return link.price_cross_root(edges, root_of).select("src", "dst", F.round("confidence", 6).alias("confidence"))


def route_views(spark, d):
    segments = lambda x: view(spark, d, x).withColumn("path", T.path_segments(F.col("raw")))
    return segments("r_consumers"), segments("r_producers")


@query("""SELECT c.id AS consumer, p.id AS producer, CAST(0.9 AS DOUBLE) AS quality FROM r_consumers c JOIN r_producers p ON split_part(c.raw, '/', 1) = split_part(p.raw, '/', 1)
 WHERE len(list_filter(string_split(c.raw, '/'), lambda x: x <> '')) = 2""")
def d26_route_match(spark, d):
    c, p = route_views(spark, d)
    return routes.match_routes(c, p).select("consumer", "producer", "quality")


@query("""WITH m AS (SELECT c.key AS src, p.key AS dst, 0.9 * 0.9 * 1.0 / count(*) OVER (PARTITION BY c.id) AS confidence FROM r_consumers c JOIN r_producers p ON split_part(c.raw, '/', 1) = split_part(p.raw, '/', 1) WHERE len(list_filter(string_split(c.raw, '/'), lambda x: x <> '')) = 2)
 SELECT src, dst, 'HttpCall' AS kind, round(max(confidence), 6) AS confidence FROM m GROUP BY src, dst""")
def d28_endpoint_edges(spark, d):
    c, p = route_views(spark, d)
    return routes.endpoint_edges(routes.match_routes(c, p), c, p).select("src", "dst", "kind", F.round("confidence", 6).alias("confidence"))


@query("SELECT 2 AS unmatched_consumers, 1 AS unused_providers")
def e10_unmatched(spark, d):
    c = rows(spark, "id int, transport string, method string, path array<string>", (1, "Http", "GET", ["a", ":"]), (2, "Http", "POST", ["a", "b"]), (3, "Http", None, ["a", "b"]))
    p = rows(spark, "id int, transport string, method string, path array<string>", (1, "Http", "GET", ["a", "*"]), (2, "Http", "GET", ["z"]), (3, "Http", "GET", ["z"]))
    return routes.unmatched(c, p, routes.match_routes(c, p)).select(F.col("unmatched_consumers").cast("int"), F.col("unused_providers").cast("int"))


@query("SELECT * FROM (VALUES ('query', 'query'), ('query', 'games'), ('query', 'players'), ('mutation', 'mutation'), ('mutation', 'games'), ('mutation', 'players'), ('subscription', 'subscription')) v(origin, scope)")
def d29_included_scopes(spark, d):
    inc = rows(spark, "scope string, included string", ("query", "games"), ("games", "players"), ("mutation", "games"), ("players", "games"))
    return routes.included_scopes(inc).select("origin", F.col("at").alias("scope"))


@query("SELECT * FROM (VALUES (1, 'Game.name'), (2, 'Team.players')) v(selection, field_key)")
def d30_selection_descent(spark, d):
    sel = rows(spark, "selection int, root_type string, path array<string>", (1, "Query", ["game", "name"]), (2, "Query", ["game", "team", "players"]), (3, "Query", ["nope"]))
    fields = rows(spark, "type string, field string, returns string, field_key string", ("Query", "game", "Game", "Query.game"), ("Game", "name", "String", "Game.name"), ("Game", "team", "Team", "Game.team"), ("Team", "players", "Player", "Team.players"))
    return routes.descend(sel, fields)


@query("SELECT * FROM (VALUES ('Op', 'id'), ('Op', 'name'), ('Op', 'x')) v(operation, field)")
def d31_fragments(spark, d):
    spreads = rows(spark, "owner string, fragment string", ("Op", "A"), ("A", "B"), ("B", "A"), ("B", "C"))
    frags = rows(spark, "fragment string, field string", ("A", "id"), ("B", "name"), ("C", "x"))
    return routes.expand_fragments(spreads, frags)


@query("SELECT * FROM (VALUES ('q1', 'r1', CAST(0.45 AS DOUBLE)), ('q1', 'r2', CAST(0.45 AS DOUBLE)), ('q2', 'r3', CAST(0.9 AS DOUBLE))) v(src, dst, confidence)")
def d32_graphql_edges(spark, d):
    ops = rows(spark, "op int, key string, scope string, field string", (1, "q1", "query", "game"), (2, "q2", "mutation", "play"))
    res = rows(spark, "scope string, field string, key string", ("query", "game", "r1"), ("query", "game", "r2"), ("mutation", "play", "r3"))
    return routes.graphql_edges(ops, res).select("src", "dst", "confidence")


@query("SELECT * FROM (VALUES ('h1', 'd1', CAST(0.45 AS DOUBLE)), ('h2', 'd1', CAST(0.45 AS DOUBLE)), ('h3', 'd2', CAST(0.9 AS DOUBLE))) v(src, dst, confidence)")
def d33_serves(spark, d):
    h = rows(spark, "handler string, declaration string, transport string, handler_kind string", ("h1", "d1", "Graphql", "Function"), ("h2", "d1", "Graphql", "Module"), ("h3", "d2", "Http", "Function"), ("h4", "d3", "Http", "Here"))
    return routes.serves_edges(h).select("src", "dst", "confidence")


@query("SELECT * FROM (VALUES ('f', 'g1', CAST(0.45 AS DOUBLE)), ('f', 'g2', CAST(0.45 AS DOUBLE))) v(src, dst, confidence)")
def d22_star_imports(spark, d):
    calls = rows(spark, "call int, key string, module_path string, name string", (1, "f", "a.ex", "get"), (2, "f", "a.ex", "own"))
    stars, local = rows(spark, "module_path string, fqn string", ("a.ex", "App.Repo")), rows(spark, "module_path string, name string", ("a.ex", "own"))
    fns = rows(spark, "fqn string, name string, key string", ("App.Repo", "get", "g1"), ("App.Repo", "get", "g2"), ("App.Repo", "own", "g3"))
    return routes.star_import_calls(calls, stars, fns, local).select("src", "dst", "confidence")


@query("SELECT * FROM (VALUES ('f', 'g1', CAST(0.9 AS DOUBLE))) v(src, dst, confidence)")
def d23_fqn_calls(spark, d):
    calls = rows(spark, "call int, key string, fqn string, name string", (1, "f", "App.Repo", "get"))
    return routes.fqn_calls(calls, rows(spark, "fqn string, name string, key string", ("App.Repo", "get", "g1"), ("Other", "get", "g2"))).select("src", "dst", "confidence")


@query("SELECT concat('o', l_orderkey) AS src, concat('s', l_suppkey) AS dst, round(0.85 / count(*) OVER (PARTITION BY l_orderkey), 6) AS confidence FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0)")
def d24_entity_edges(spark, d):
    refs = view(spark, d, "SELECT l_orderkey AS ref, concat('o', l_orderkey) AS key, concat('S', l_suppkey) AS fqn FROM lineitem")
    schemas = view(spark, d, "SELECT concat('S', s_suppkey) AS fqn, concat('s', s_suppkey) AS key FROM supplier WHERE s_suppkey % 2 = 0")
    return routes.entity_edges(refs, schemas).select("src", "dst", F.round("confidence", 6).alias("confidence"))


EMITTED = "SELECT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst, 'Calls' AS kind, max(l_discount) AS confidence, l_linenumber AS pass_no, CAST(l_orderkey AS INT) AS ord FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber, l_orderkey"


@query(f"SELECT src, dst, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY pass_no, ord) AS n FROM ({EMITTED})) WHERE n = 1")
def d34_emit(spark, d):
    return link.emit(view(spark, d, EMITTED)).select("src", "dst", "kind", "confidence")


TEST_NODES = "SELECT concat('o', o_orderkey) AS key, concat('customer/', o_custkey) AS module_path, CAST(o_orderkey % 100 AS INT) AS start_line, CAST(o_orderkey % 100 + 5 AS INT) AS end_line, o_custkey % 7 = 0 AS is_test_file FROM orders"
SCOPES = "SELECT concat('customer/', c_custkey) AS module_path, 40 AS start_line, 80 AS end_line FROM customer WHERE c_custkey % 5 = 0"
TEST_EDGES = "SELECT concat('o', l_orderkey) AS src, concat('o', l_partkey) AS dst, CASE l_linenumber % 3 WHEN 0 THEN 'Imports' ELSE 'Calls' END AS kind, l_tax + 0.1 AS confidence FROM lineitem"
MEMBERS_SQL = f"m AS (SELECT key, is_test_file FROM ({TEST_NODES}) n WHERE is_test_file OR EXISTS (SELECT 1 FROM ({SCOPES}) s WHERE s.module_path = n.module_path AND n.start_line >= s.start_line AND n.end_line <= s.end_line))"


@query(f"WITH {MEMBERS_SQL} SELECT key, is_test_file AS whole_file FROM m")
def d35_test_members(spark, d):
    return link.test_members(view(spark, d, TEST_NODES), view(spark, d, SCOPES))


@query(f"WITH {MEMBERS_SQL} SELECT e.src, e.dst, round(max(confidence) * 0.8, 6) AS confidence FROM ({TEST_EDGES}) e JOIN m ON m.key = e.src WHERE (e.kind <> 'Imports' OR m.is_test_file) AND e.dst NOT IN (SELECT key FROM m) GROUP BY e.src, e.dst")
def d36_link_tests(spark, d):
    out = link.link_tests(view(spark, d, TEST_EDGES), link.test_members(view(spark, d, TEST_NODES), view(spark, d, SCOPES)))
    return out.select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query("SELECT * FROM (VALUES (9, 'a', 'c'), (4, 'b', 'c'), (1, 'b', 'b'), (8, 'z', 'z')) v(seq, file, current)")
def d38_renames(spark, d):
    renames = rows(spark, "seq int, old string, new string", (6, "a", "b"), (3, "b", "c"), (2, "q", "r"))
    return overlay.current_names(rows(spark, "seq int, file string", (9, "a"), (4, "b"), (1, "b"), (8, "z")), renames)


STAMPS, CURRENT = "SELECT concat('o', o_orderkey) AS module_path, o_orderstatus AS hash FROM orders", "SELECT concat('o', o_orderkey) AS module_path, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 5 > 0"


@query(f"SELECT s.module_path FROM ({STAMPS}) s LEFT JOIN ({CURRENT}) c ON c.module_path = s.module_path WHERE c.hash IS NULL OR c.hash <> s.hash")
def d42_stale_files(spark, d):
    from ..sources.files import stale

    return stale(view(spark, d, STAMPS), view(spark, d, CURRENT))


OURS, THEIRS = "SELECT DISTINCT concat('s', l_suppkey) AS target, concat('o', l_orderkey) AS src, CAST(0.5 AS DOUBLE) AS confidence FROM lineitem WHERE l_linenumber < 4", "SELECT DISTINCT concat('s', l_suppkey) AS target, concat('o', l_orderkey) AS src FROM lineitem WHERE l_linenumber > 2"


@query(f"""WITH o AS ({OURS}), t AS ({THEIRS}), j AS (SELECT coalesce(o.target, t.target) AS target, coalesce(o.src, t.src) AS src, o.confidence AS c, t.src IS NOT NULL AS cl FROM o FULL JOIN t ON o.target = t.target AND o.src = t.src)
 SELECT target, src, CASE WHEN c IS NOT NULL AND cl THEN 'Confirmed' WHEN c IS NULL THEN 'Added' WHEN CAST(substr(src, 2) AS BIGINT) % 2 = 0 THEN 'Contradicted' ELSE 'Unresolved' END AS verdict,
  CAST(CASE WHEN c IS NOT NULL AND cl THEN 1 WHEN c IS NULL THEN 0.7 WHEN CAST(substr(src, 2) AS BIGINT) % 2 = 0 THEN 0.4 ELSE c END AS DOUBLE) AS confidence FROM j""")
def d43_reconcile(spark, d):
    covered = view(spark, d, "SELECT concat('o', o_orderkey) AS src FROM orders WHERE o_orderkey % 2 = 0")
    return link.reconcile(view(spark, d, OURS), view(spark, d, THEIRS), covered)


@query("SELECT * FROM (VALUES (1, 'k1', 'resolved'), (2, 'k2', 'resolved'), (3, NULL, 'ambiguous'), (4, NULL, 'unknown')) v(claim, key, outcome)")
def d44_claimed_symbols(spark, d):
    nodes = rows(spark, "key string, kind string, name string, qualified_name string", ("k1", "Function", "run", "App.run"), ("k2", "Method", "save", "Store.save"), ("k3", "Method", "go", "A.go"), ("k4", "Method", "go", "B.go"))
    claims = rows(spark, "claim int, spelling string", (1, "App.run"), (2, "save/2"), (3, "go(x)"), (4, "nope")).withColumn("bare", T.bare_name(F.col("spelling")))
    return link.claimed_symbols(claims, nodes).select("claim", "key", "outcome")


@query("SELECT DISTINCT n.module_path FROM g_nodes n WHERE n.key = 's3' OR n.key IN (SELECT src FROM g_edges WHERE dst = 's3')")
def d47_focus_files(spark, d):
    return link.focus_files(keys(spark, "s3"), view(spark, d, "g_edges"), view(spark, d, "g_nodes"))


DUP = "SELECT p_name AS key, CAST(p_partkey AS INT) AS ord, CASE p_partkey % 2 WHEN 0 THEN 'Variable' ELSE 'Function' END AS kind, p_brand AS module_path, CAST(p_size AS INT) AS start_line, CAST(p_size + 3 AS INT) AS end_line FROM part"


@query(f"SELECT key, CASE WHEN min_by(kind, ord) = 'Variable' AND max(CASE WHEN kind = 'Function' THEN 1 ELSE 0 END) = 1 THEN 'Function' ELSE min_by(kind, ord) END AS kind, min_by(module_path, ord) AS module_path, CAST(count(DISTINCT start_line) - 1 AS INT) AS extra FROM ({DUP}) GROUP BY key")
def e9_dedup_definitions(spark, d):
    return link.dedup_definitions(view(spark, d, DUP)).select("key", "kind", "module_path", F.size("extra_spans").alias("extra"))


@query("SELECT * FROM (VALUES ('h', 'users posts all')) v(key, route_path)")
def e15_route_words(spark, d):
    h = rows(spark, "key string, transport string, ord int, path array<string>", ("h", "Http", 0, ["users", ":", "posts"]), ("h", "Http", 1, ["users", "all"]), ("g", "Graphql", 0, ["x"]))
    return routes.route_words(h)


@query("SELECT r_name AS root, string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) AS languages FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def e20_languages_per_root(spark, d):
    t = view(spark, d, "SELECT r_name AS root, c_mktsegment AS language FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
    from ..sources.files import languages_per_root

    return languages_per_root(t)


@query("SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(p_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM part")
def i1_split_words(spark, d):
    return view(spark, d, "SELECT p_partkey, p_name FROM part").select("p_partkey", F.array_join(T.split_words(F.col("p_name")), " ").alias("words"))


@query("SELECT * FROM (VALUES ('address', 'address'), ('rings', 'ring'), ('bus', 'bus'), ('tests', 'test')) v(word, stem)")
def i2_singular(spark, d):
    return rows(spark, "word string", ("address",), ("rings",), ("bus",), ("tests",)).select("word", T.singular(F.col("word")).alias("stem"))


@query(f"SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: len(w) >= 2 AND NOT list_contains({STOPWORDS!r}, w))) AS signals FROM conversations WHERE regexp_matches(text, '^[ -~]*$')")
def i3_signal_words(spark, d):
    t = view(spark, d, "SELECT conv_id, turn, lower(text) AS text FROM conversations").filter(F.col("text").rlike("^[ -~]*$"))
    return t.select("conv_id", "turn", F.size(F.filter(T.split_words(F.col("text")), T.is_signal)).cast("long").alias("signals"))


@query("SELECT p_partkey, regexp_matches(lower(p_name), 'fix|bug|revert|hotfix|patch|regression') AS is_fix FROM part")
def i7_is_fix(spark, d):
    return view(spark, d, "SELECT p_partkey, p_name FROM part").select("p_partkey", overlay.is_fix(F.col("p_name")).alias("is_fix"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]{3,}'))) AS identifiers FROM documents")
def i8_identifier_tokens(spark, d):
    return view(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", F.size(T.identifier_tokens(F.col("text"))).cast("long").alias("identifiers"))


@query("SELECT * FROM (VALUES ('/users/:id/posts', 'users/:/posts', 0.667), ('/a/{b}/*rest', 'a/:/*', 0.333), ('/', '', 1.0)) v(url, path, share)")
def i9_http_paths(spark, d):
    t = rows(spark, "url string", ("/users/:id/posts",), ("/a/{b}/*rest",), ("/",)).withColumn("p", T.path_segments(F.col("url")))
    return t.select("url", F.array_join("p", "/").alias("path"), F.round(T.literal_share(F.col("p")), 3).alias("share"))


@query("SELECT * FROM (VALUES ('get_user_name', 'getUserName', 'GetUserName', 'get_user_name')) v(s, camel, op, snake)")
def i10_case_names(spark, d):
    camel = T.camelize(F.col("s"))
    return rows(spark, "s string", ("get_user_name",)).select("s", camel.alias("camel"), T.operation_key(camel).alias("op"), T.decamelize(camel).alias("snake"))


@query("SELECT * FROM (VALUES ('/api/${id}/x?y=1', '/api/:param/x'), ('a${b}c', 'a/:param/c')) v(url, path)")
def i12_url_templates(spark, d):
    return rows(spark, "url string", ("/api/${id}/x?y=1",), ("a${b}c",)).select("url", T.url_template(F.col("url")).alias("path"))


@query("SELECT * FROM (VALUES ('a:b.c', 'c'), ('x', 'x'), ('M.f/2', 'f/2')) v(name, last)")
def i13_last_segment(spark, d):
    return rows(spark, "name string", ("a:b.c",), ("x",), ("M.f/2",)).select("name", T.last_segment(F.col("name")).alias("last"))


VERDICTS = "SELECT concat('h', user_id % 50) AS hash, event_id AS batch, event_type AS verdict FROM events"


@query(f"SELECT hash, max_by(verdict, batch) AS verdict FROM ({VERDICTS}) GROUP BY hash")
def b4_merge_verdicts(spark, d):
    """Both halves of the batches go through a store, the older one first."""
    import uuid

    from ..store import SnapshotStore, latest
    from .lineage import shared_dir

    store = SnapshotStore(spark, f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}")
    every = view(spark, d, VERDICTS)
    middle = every.agg(F.floor(F.avg("batch"))).first()[0]
    for part in (every.filter(F.col("batch") <= middle), every.filter(F.col("batch") > middle)):
        store.merge("verdicts", latest(part, ["hash"], "batch"), ["hash"])
    return store.read("verdicts").select("hash", "verdict")


NEAR_ROOTS = "SELECT DISTINCT n_name AS root FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"


@query(f"SELECT n_name AS root FROM nation EXCEPT SELECT root FROM ({NEAR_ROOTS})")
def h5_dropped_roots(spark, d):
    from ..sources.files import dropped_roots

    return dropped_roots(view(spark, d, "SELECT n_name AS root FROM nation"), view(spark, d, NEAR_ROOTS))


@query(f"WITH a AS ({OURS}), b AS ({THEIRS}) SELECT 'both' AS side, count(*) AS n FROM (SELECT target, src FROM a INTERSECT SELECT target, src FROM b) UNION ALL SELECT 'ours', count(*) FROM (SELECT target, src FROM a EXCEPT SELECT target, src FROM b) UNION ALL SELECT 'theirs', count(*) FROM (SELECT target, src FROM b EXCEPT SELECT target, src FROM a)")
def h2_set_operations(spark, d):
    return link.sides(view(spark, d, OURS), view(spark, d, THEIRS), ["target", "src"]).groupBy("side").agg(F.count("*").alias("n"))
