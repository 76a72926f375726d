"""The index: source trees and history to a scored graph, as one chain of DataFrames.

Order matters: calls before tests, tests before risk, history before both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.base import extract, of
from ..functions.text import is_test_path, language_of, path_segments
from ..operators import link, overlay, routes
from ..schema import CONF_GRAPHQL, CONF_IMPORT
from ..sources import config, files as sources
from .lineage import cut

#: Raised when facts of an older extractor can't be reused.
FINGERPRINT = "facts-2"


@dataclass
class Index:
    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame
    stamps: DataFrame


def definitions(facts: DataFrame) -> DataFrame:
    """Definitions with their key; a module node for every file comes first."""
    defs = of(facts, "def", "root", "module_path", "ord", "name", "qualified_name", "kind", "owner", "start_line", "end_line", "is_exported", "doc")
    return defs.withColumn("key", F.concat_ws("#", "module_path", "qualified_name"))


def module_nodes(stamps: DataFrame) -> DataFrame:
    name = F.regexp_extract("module_path", r"([^/]*)$", 1)
    return stamps.select(F.concat(F.col("module_path"), F.lit("#<module>")).alias("key"), F.lit("Module").alias("kind"), "root", "module_path", name.alias("name"), F.col("module_path").alias("qualified_name"),
                         F.lit(None).cast("string").alias("owner"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("is_exported"), F.lit(None).cast("string").alias("doc"),
                         F.array().cast("array<struct<start_line:int,end_line:int>>").alias("extra_spans"))


def module_key(c) -> F.Column:
    return F.concat(c, F.lit("#<module>"))


def ecosystem(path) -> F.Column:
    lang = language_of(path)
    return F.when(lang.isin("typescript", "tsx", "svelte", "vue", "html"), "npm").otherwise(lang)


def resolved_imports(facts: DataFrame, stamps: DataFrame, configs: DataFrame | None) -> DataFrame:
    """imports with target (module_path of the file, or null) and dep (or null)."""
    imports = of(facts, "import", "root", "module_path", "language", "ord", "spec", "imported", "local", F.col("start_line").alias("line"))
    py = imports.filter("language = 'python'").select("module_path", "spec").distinct()
    py_as_module = of(facts, "import", "module_path", "spec", "imported").filter("imported <> '*'").select("module_path", F.concat_ws(".", F.when(F.col("spec").rlike(r"^\.+$"), F.lit("")).otherwise(F.col("spec")), "imported").alias("s2"), "spec", "imported")
    web = imports.filter("language IN ('typescript', 'tsx', 'svelte', 'vue', 'html')").select("module_path", "spec").distinct()
    packages = aliases = None
    if configs is not None:
        aliases = config.path_aliases(configs)
        # With several roots a module path begins with its root's tag, and a package is seen by its root, or by all if no other declares it.
        several = configs.select("root").distinct().count() > 1
        packages = config.package_dirs(configs)
        packages = config.visible_packages(packages.withColumn("root", F.element_at(F.split("dir", "/"), 1))) if several else packages
    found = link.python_candidates(py, stamps).unionByName(link.resolve_imports(web, stamps, aliases, packages).select("module_path", "spec", "target").filter("target IS NOT NULL"))
    if configs is not None:
        go = imports.filter("language = 'go'").select("module_path", "spec").distinct()
        found = found.unionByName(link.go_candidates(go, stamps, config.go_modules(configs)))
    # ``from package import module`` names a file as well.
    inner = link.python_candidates(py_as_module.select("module_path", F.col("s2").alias("spec")).distinct(), stamps)
    inner = py_as_module.join(inner.select("module_path", F.col("spec").alias("s2"), F.col("target").alias("inner_target")), ["module_path", "s2"]).select("module_path", "spec", "imported", "inner_target")
    out = imports.join(found.dropDuplicates(["module_path", "spec"]), ["module_path", "spec"], "left").join(inner.dropDuplicates(["module_path", "spec", "imported"]), ["module_path", "spec", "imported"], "left")
    whole = F.col("inner_target").isNotNull()
    out = out.withColumn("imported", F.when(whole, F.lit("*")).otherwise(F.col("imported"))).withColumn("target", F.coalesce("inner_target", "target")).drop("inner_target")
    from ..functions.text import dependency_key

    return out.withColumn("dep", F.when(F.col("target").isNull(), dependency_key(F.col("spec"), ecosystem(F.col("module_path")))))


def link_calls(facts: DataFrame, defs: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Calls edges, Imports edges, external nodes)."""
    exported = link.exports(defs)
    named = imports.filter("target IS NOT NULL AND imported NOT IN ('*', 'default')")
    reexports = of(facts, "reexport", "module_path", "name", F.col("imported").alias("source_name"), "spec", "ord")
    suffix = reexports.join(imports.select("module_path", "spec", "target").filter("target IS NOT NULL").distinct(), ["module_path", "spec"], "left")
    own = link.resolve_imports(reexports.select("module_path", "spec").distinct(), defs.select("module_path").distinct()).select("module_path", "spec", F.col("target").alias("t2"))
    suffix = suffix.join(own, ["module_path", "spec"], "left").withColumn("target_module", F.coalesce("target", "t2")).filter("target_module IS NOT NULL")
    followed = link.follow_reexports(named.select(F.col("target").alias("module_path"), F.col("imported").alias("name")), exported, suffix.select("module_path", "name", "source_name", "target_module", "ord"))
    by_name = named.join(followed.select(F.col("module_path").alias("target"), F.col("name").alias("imported"), "key"), ["target", "imported"])
    default = imports.filter("imported = 'default' AND target IS NOT NULL").join(link.default_exports(defs).withColumnRenamed("module_path", "target"), "target")
    outside = imports.filter("dep IS NOT NULL AND imported <> '*'").withColumn("key", F.concat_ws(".", "dep", "imported"))
    bound = cut(by_name.select("module_path", "local", "key").unionByName(default.select("module_path", "local", "key")).unionByName(outside.select("module_path", "local", "key")))

    ext_nodes, ext_edges = link.external_nodes(imports, ecosystem(F.col("module_path")))
    inside = imports.filter("target IS NOT NULL").select(module_key(F.col("module_path")).alias("src"), module_key(F.col("target")).alias("dst")).distinct()
    to_symbol = bound.select(module_key(F.col("module_path")).alias("src"), F.col("key").alias("dst")).distinct()
    import_edges = inside.unionByName(to_symbol).unionByName(ext_edges.select(module_key(F.col("src")).alias("src"), "dst")).distinct()
    import_edges = import_edges.select("src", "dst", F.lit("Imports").alias("kind"), F.lit(CONF_IMPORT).alias("confidence"), F.lit(None).cast("int").alias("line"))

    refs = of(facts, "ref", "root", "module_path", "ord", "name", "qualifier", "recv_kind", "recv_text", F.col("start_line").alias("line"), "col").withColumn("ref", F.concat_ws(":", "module_path", F.col("ord").cast("string")))
    spans = link.containers(defs).filter("kind <> 'Module' OR end_line > start_line")
    placed = link.enclosing(refs, spans, "ref").withColumn("src", F.coalesce("container", module_key(F.col("module_path")))).drop("container")
    around = defs.filter("kind = 'Class'").select("module_path", F.col("start_line"), F.col("end_line"), F.col("name").alias("key"))
    placed = link.enclosing(placed, around, "ref").withColumnRenamed("container", "this_owner")
    bindings = of(facts, "bind", "module_path", "name", F.col("start_line").alias("line"), "type", "scope_start", "scope_end")
    placed = cut(link.without_headers(link.receiver_types(placed, bindings), defs))

    bare = placed.filter("qualifier IS NULL AND recv_kind IS NULL")
    qualified = placed.filter("qualifier IS NOT NULL")
    member = placed.filter("qualifier IS NULL AND recv_kind IS NOT NULL")
    mods = imports.select("module_path", "local", "imported", F.col("target").alias("target_module"), "dep")
    # An owner that an import names is looked up where it comes from first.
    via = qualified.join(mods.filter("imported <> '*' OR target_module IS NOT NULL").select("module_path", F.col("local").alias("qualifier")).distinct(), ["module_path", "qualifier"], "left_semi")
    known = link.member_calls(via.withColumn("recv_kind", F.lit("ident")).withColumn("recv_text", F.col("qualifier")).withColumn("recv_type", F.when(F.lit(False), F.lit("")).cast("string")), defs, mods)
    known = known.filter("rule_no < 4")
    rest = link.qualified_calls(qualified.join(known.select("ref").distinct(), "ref", "left_anti"), defs)
    hits = link.bare_calls(bare, defs, bound).unionByName(link.member_calls(member, defs, mods)).unionByName(known).unionByName(rest)
    # Calls into packages outside the tree give their symbols a node.
    far = mods.filter("dep IS NOT NULL").select("module_path", F.col("local").alias("recv_text"), "dep")
    called = member.join(far, ["module_path", "recv_text"]).select("dep", "name").distinct()
    called = called.select(F.concat_ws(".", "dep", "name").alias("key"), F.col("dep").alias("module_path"), F.concat_ws(".", "dep", "name").alias("qualified_name"), F.lit("External").alias("kind"))
    ext_nodes = ext_nodes.unionByName(called.join(hits.select(F.col("dst").alias("key")).distinct(), "key", "left_semi")).distinct()
    calls = link.call_edges(link.prefer_local(hits.filter("dst IS NOT NULL"), placed, defs), placed)
    return calls, import_edges, ext_nodes


def endpoints(facts: DataFrame, defs: DataFrame, specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(consumers, producers) of HTTP routes: id, transport, method, path (segments), key. specs: module_path, method, path of API specifications."""
    spans = link.containers(defs)
    at = lambda f: link.enclosing(of(facts, f, "module_path", "ord", "transport", "method", "path", "name", F.col("start_line").alias("line")).filter("transport = 'Http'").withColumn("id", F.concat_ws(":", "module_path", F.col("ord").cast("string"))), spans, "id", "smallest")
    segments = lambda c: path_segments(F.regexp_replace(F.regexp_replace(c, r"\$?\{[^}]*\}", ":x"), r"^[a-z]+://[^/]*|[?#].*$", ""))
    keyed = lambda x: x.withColumn("key", F.coalesce("container", module_key(F.col("module_path")))).withColumn("path", segments(F.col("path")))
    provide, consume = keyed(at("provide")), keyed(at("consume"))
    # A route that names its handler belongs to it.
    named = defs.groupBy("module_path", "name").agg(F.min("key").alias("handler"))
    provide = provide.join(named, ["module_path", "name"], "left").withColumn("key", F.coalesce("handler", "key")).drop("handler")
    cols = ["id", "transport", "method", "path", "key", "ord"]
    provide, consume = provide.select(cols), consume.select(cols)
    if specs is not None:
        declared = specs.select(F.concat_ws(" ", "module_path", "method", "path").alias("id"), F.lit("Http").alias("transport"), "method", segments(F.col("path")).alias("path"), module_key(F.col("module_path")).alias("key"), F.lit(0).alias("ord"))
        provide = provide.unionByName(declared)
    return consume, provide


def link_graphql(facts: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(GraphqlCall edges from operations to fields and resolvers, Serves edges from resolvers to the fields of the schema)."""
    provide = of(facts, "provide", "module_path", "transport", "method", "owner", "path", "name", "type").filter("transport = 'Graphql'")
    declared = provide.filter("owner IS NOT NULL").select(F.col("method").alias("scope"), F.col("path").alias("field"), F.col("owner").alias("on_type"), "type", F.concat("module_path", F.lit("#"), "owner", F.lit("."), "path").alias("key"))
    functions = defs.filter("kind IN ('Function', 'Method')").select(F.concat_ws(".", "owner", "name").alias("name"), "key")
    resolved = provide.filter("owner IS NULL AND name IS NOT NULL").select(F.col("method").alias("own"), F.col("path").alias("field"), "name").join(functions, "name")
    # Fields of a scope that a root takes in are fields of the root.
    scopes = routes.included_scopes(of(facts, "include", F.col("owner").alias("scope"), F.col("name").alias("included")))
    resolved = resolved.join(scopes.select(F.col("origin").alias("scope"), F.col("at").alias("own")), "own").select("scope", "field", "key").distinct()
    targets = declared.filter("scope IN ('query', 'mutation', 'subscription')").select("scope", "field", "key").unionByName(resolved)

    taken = cut(of(facts, "consume", "module_path", "transport", "method", "owner", "path").filter("transport = 'Graphql'"))
    op = F.concat("module_path", F.lit("#"), "owner").alias("op")
    roots = F.col("method").isin("query", "mutation", "subscription")
    top = taken.filter(roots & ~F.col("path").contains("/")).select(op, F.col("method").alias("scope"), F.col("path").alias("field"))
    # A fragment's own fields come with the operations that spread it at their root.
    spreads = of(facts, "spread", F.col("owner").alias("owner"), F.col("name").alias("fragment"))
    held = taken.filter(~roots & ~F.col("path").contains("/")).select(F.col("owner").alias("fragment"), F.col("path").alias("field"))
    by_name = taken.filter(roots).select(op, "owner", F.col("method").alias("scope")).distinct()
    spread = routes.expand_fragments(spreads, held).join(by_name, F.col("operation") == F.col("owner")).select("op", "scope", "field")
    operations = top.unionByName(spread).distinct().withColumn("key", F.col("op"))
    calls = routes.graphql_edges(operations, targets)
    # Deeper selections end at a field of the type that the path leads to.
    deep = taken.filter(roots & F.col("path").contains("/")).select(F.concat_ws(" ", op, "path").alias("selection"), op, F.concat(F.upper(F.substring("method", 1, 1)), F.expr("substring(method, 2)")).alias("root_type"), F.split("path", "/").alias("path"))
    ends = routes.descend(deep, declared.select(F.col("on_type").alias("type"), "field", F.col("type").alias("returns"), F.col("key").alias("field_key")))
    nested = deep.join(ends, "selection").select(F.col("op").alias("src"), F.col("field_key").alias("dst"), F.lit("GraphqlCall").alias("kind"), F.lit(CONF_GRAPHQL).alias("confidence")).distinct()
    handlers = resolved.join(declared.select("scope", "field", F.col("key").alias("declaration")), ["scope", "field"]).select(F.col("key").alias("handler"), "declaration", F.lit("Graphql").alias("transport"), F.lit("Named").alias("handler_kind"))
    return calls.unionByName(nested), routes.serves_edges(handlers)


def link_modules(facts: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of languages with named modules: (calls by whole-module imports, calls by a module's full name, references to modules with a table)."""
    spans = link.containers(defs).filter("kind <> 'Module' OR end_line > start_line")
    placed = lambda x: link.enclosing(x, spans, "id").withColumn("key", F.coalesce("container", module_key(F.col("module_path")))).drop("container")
    number = F.concat_ws(":", "module_path", F.col("ord").cast("string")).alias("id")
    functions = defs.filter("kind IN ('Function', 'Method') AND owner IS NOT NULL").select(F.col("owner").alias("fqn"), "name", "key")
    stars = of(facts, "star", "module_path", F.col("spec").alias("fqn")).distinct()
    refs = of(facts, "ref", "module_path", "ord", "name", "qualifier", "recv_kind", "recv_text", F.col("start_line").alias("line")).withColumn("id", number)
    bare = placed(refs.filter("qualifier IS NULL AND recv_kind IS NULL").join(stars.select("module_path").distinct(), "module_path", "left_semi")).withColumnRenamed("id", "call")
    by_star = routes.star_import_calls(bare, stars, functions, defs.select("module_path", "name"))
    full = placed(refs.filter("qualifier IS NOT NULL AND recv_text LIKE '%.%'")).select(F.col("id").alias("call"), "key", F.col("recv_text").alias("fqn"), "name")
    tables = of(facts, "table", "module_path", "ord", F.col("start_line").alias("line")).withColumn("id", number)
    around = defs.filter("kind = 'Module'").select("module_path", "start_line", "end_line", "key")
    schemas = link.enclosing(tables, around, "id").filter("container IS NOT NULL").select(F.col("container").alias("key")).join(defs.select("key", F.col("name").alias("fqn")), "key")
    named = placed(of(facts, "entity", "module_path", "ord", "name", F.col("start_line").alias("line")).withColumn("id", number))
    # A module may be named by its last part, once it has an alias.
    last = schemas.select(F.element_at(F.split("fqn", r"\."), -1).alias("fqn"), "key")
    spelled = schemas.select("fqn", "key").unionByName(last).distinct()
    return by_star, routes.fqn_calls(full, functions), routes.entity_edges(named.select(F.col("id").alias("ref"), "key", F.col("name").alias("fqn")), spelled)


def build(spark: SparkSession, roots: list[str], history: DataFrame | None = None, previous: Index | None = None) -> Index:
    """Indexes the trees at roots. history: commit, seq, author, file (module_path), is_fix. previous: files with the same content keep their facts."""
    files = sources.discover(spark, roots)
    stamps = cut(files.select("module_path", "root", "language", "hash"))
    todo = files if previous is None else sources.to_extract(files, previous.stamps)
    facts = extract(todo)
    if previous is not None:
        same = stamps.join(previous.stamps.select("module_path", "hash"), ["module_path", "hash"], "left_semi").select("module_path")
        facts = facts.unionByName(previous.facts.join(same, "module_path", "left_semi"))
    facts = cut(facts)
    defs = cut(link.dedup_definitions(definitions(facts)).withColumn("ord", F.col("start_line")))

    configs = cut(sources.configurations(spark, roots))
    specs = cut(config.read_specs(configs))
    imports = cut(resolved_imports(facts, stamps, configs))
    calls, import_edges, external = link_calls(facts, defs, imports)
    consume, provide = (cut(x) for x in endpoints(facts, defs, specs))
    graphql, serves = link_graphql(facts, defs)
    http = routes.endpoint_edges(routes.match_routes(consume, provide), consume, provide)
    # Passes in order: of one (src, dst, kind) the first gives the edge.
    others = routes.all_passes(http, graphql, serves, *link_modules(facts, defs))
    edges = calls.unionByName(import_edges)

    cols = ["key", "kind", "root", "module_path", "name", "qualified_name", "owner", "start_line", "end_line", "is_exported", "doc", "extra_spans"]
    declared = specs.select("module_path").distinct().join(configs.select("module_path", "root"), "module_path")
    nodes = module_nodes(stamps.select("module_path", "root").unionByName(declared)).select(cols).unionByName(defs.select(cols)).unionByName(external.select(
        "key", "kind", F.lit(None).cast("string").alias("root"), "module_path", F.regexp_extract("key", r"([^./]*)$", 1).alias("name"), "qualified_name",
        F.lit(None).cast("string").alias("owner"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("is_exported"), F.lit(None).cast("string").alias("doc"),
        F.array().cast("array<struct<start_line:int,end_line:int>>").alias("extra_spans")))
    nodes = cut(nodes)
    seen = edges.select("src", "dst", "kind").distinct()
    others = others.join(seen, ["src", "dst", "kind"], "left_anti").join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")
    edges = edges.select("src", "dst", "kind", "confidence", "line").unionByName(others.select("src", "dst", "kind", "confidence", F.lit(None).cast("int").alias("line")))
    edges = cut(link.price_cross_root(edges, nodes.select("key", "root").filter("root IS NOT NULL")))

    if history is not None:
        usable = cut(overlay.usable_commits(history))
        risk = overlay.file_risk(overlay.file_stats(usable)).select("file", "churn", "bug_density", "ownership")
        nodes, pairs = overlay.apply_overlay(nodes, nodes.filter("kind = 'Module'").select("key", "module_path"), risk, overlay.cochange(usable))
        edges = edges.unionByName(pairs.withColumn("line", F.lit(None).cast("int")))
    test_file = F.coalesce(is_test_path(F.col("module_path"), language_of(F.col("module_path"))), F.lit(False))
    members = cut(link.test_members(nodes.filter("kind <> 'External'").withColumn("is_test_file", test_file), of(facts, "test_scope", "module_path", "start_line", "end_line")))
    edges = cut(edges.unionByName(link.link_tests(edges, members).select("src", "dst", "kind", "confidence", F.lit(None).cast("int").alias("line"))))
    words = routes.route_words(provide)
    scored = overlay.structural_risk(nodes, edges).join(words, "key", "left")
    return Index(cut(scored), edges, facts, stamps)
