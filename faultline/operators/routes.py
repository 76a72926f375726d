"""Links across services: HTTP routes, GraphQL operations, handlers, tables.

A route's path is an array of segments: a literal, ':' for one parameter, '*' for any rest.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import literal_share
from ..plans.lineage import cut
from ..schema import CONF_CONTEXT_MODULE, CONF_DB, CONF_ENDPOINT, CONF_GRAPHQL, CONF_QUALIFIED_CALL, CONF_SERVES, CONF_STAR, MAX_FRAGMENT_HOPS, NORMALIZED_ROUTE
from .link import emit, strongest


def unify(p: Column, c: Column) -> Column:
    """Whether two paths can name the same thing: a parameter takes one segment, a rest takes what is left, even nothing."""
    first = lambda x: F.when(F.array_position(x, "*") > 0, F.array_position(x, "*"))
    n = F.least(first(p), first(c)) - 1
    same = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.coalesce((x == ":") | (y == ":") | (x == y), F.lit(False))), lambda ok: ok)
    cut = F.coalesce(n, F.lit(0)).cast("int")
    rest = (F.size(p) >= cut) & (F.size(c) >= cut) & same(F.slice(p, 1, cut), F.slice(c, 1, cut))
    return F.when(n.isNull(), (F.size(p) == F.size(c)) & same(p, c)).otherwise(rest)


def _headed(routes: DataFrame, side: str, ids: list[str]) -> DataFrame:
    head = F.when(F.size("path") == 0, F.lit("")).otherwise(F.element_at("path", 1))
    return routes.select(*(F.col(c).alias(f"{side}_{c}") for c in ids), F.col("transport").alias(f"{side}_transport"), F.col("method").alias(f"{side}_method"), F.col("path").alias(f"{side}_path"), head.alias(f"{side}_head"))


def match_routes(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """consumer, producer, quality: routes whose transport and method agree and whose paths unify.

    Both sides: id, transport, method (null only equals null), path. Literal heads are joined
    by equality; only routes that begin with a placeholder meet every head of their transport.
    """
    c, p = _headed(consumers, "c", ["id"]), _headed(producers, "p", ["id"])
    fits = (F.col("c_transport") == F.col("p_transport")) & F.col("c_method").eqNullSafe(F.col("p_method"))
    loose = lambda h: F.col(h).isin(":", "*", "")
    exact = c.filter(~loose("c_head")).join(p.filter(~loose("p_head")), fits & (F.col("c_head") == F.col("p_head")))
    wide_p = c.join(p.filter(loose("p_head")), fits)
    wide_c = c.filter(loose("c_head")).join(p.filter(~loose("p_head")), fits)
    hit = exact.unionByName(wide_p).unionByName(wide_c).filter(unify(F.col("p_path"), F.col("c_path")))
    plain = lambda x: F.forall(x, lambda s: ~s.isin(":", "*"))
    quality = F.when(plain(F.col("p_path")) & plain(F.col("c_path")), 1.0).otherwise(NORMALIZED_ROUTE)
    return hit.select(F.col("c_id").alias("consumer"), F.col("p_id").alias("producer"), quality.alias("quality"), F.col("c_path").alias("path"), F.col("c_transport").alias("transport"))


def endpoint_edges(matches: DataFrame, consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """src, dst, kind, confidence: quality * 0.9 * (half + half the share of literals), split over a consumer's matches."""
    n = F.count("*").over(Window.partitionBy("consumer"))
    share = literal_share(F.col("path"))
    kind = F.when(F.col("transport") == "PubSub", "AsyncCall").when(F.col("transport") == "Db", "Serves").otherwise("HttpCall")
    out = matches.withColumn("confidence", F.col("quality") * CONF_ENDPOINT * (0.5 + 0.5 * share) / n).withColumn("kind", kind)
    out = out.join(consumers.select(F.col("id").alias("consumer"), F.col("key").alias("src")), "consumer").join(producers.select(F.col("id").alias("producer"), F.col("key").alias("dst")), "producer")
    return strongest(out.select("src", "dst", "kind", "confidence")).filter("src <> dst")


def unmatched(consumers: DataFrame, producers: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: unmatched_consumers (each consumer), unused_providers (distinct route keys that nothing matched)."""
    lone = consumers.join(matches.select(F.col("consumer").alias("id")).distinct(), "id", "left_anti").agg(F.count("*").alias("unmatched_consumers"))
    key = F.concat_ws(" ", "transport", F.coalesce("method", F.lit("-")), F.array_join("path", "/"))
    used = producers.join(matches.select(F.col("producer").alias("id")).distinct(), "id", "left_semi").select(key.alias("route"))
    idle = producers.select(key.alias("route")).distinct().join(used.distinct(), "route", "left_anti").agg(F.count("*").alias("unused_providers"))
    return lone.crossJoin(idle)


def serves_edges(handlers: DataFrame) -> DataFrame:
    """Handler -> declaration at 0.9 (GraphQL: split over a declaration's handlers), the strongest of a pair.

    handlers: handler, declaration, transport, handler_kind; 'Here' handlers give none.
    """
    n = F.when(F.col("transport") == "Graphql", F.count("*").over(Window.partitionBy("declaration"))).otherwise(1)
    out = handlers.filter("handler_kind <> 'Here'").withColumn("confidence", F.lit(CONF_SERVES) / n)
    return strongest(out.select(F.col("handler").alias("src"), F.col("declaration").alias("dst"), F.lit("Serves").alias("kind"), "confidence")).filter("src <> dst")


def route_words(handlers: DataFrame) -> DataFrame:
    """key, route_path: the distinct literal words of a handler's routes, in order (HTTP, gRPC and RPC only)."""
    own = handlers.filter("transport IN ('Http', 'Grpc', 'Rpc')").select("key", "ord", F.posexplode("path").alias("i", "word")).filter("word NOT IN (':', '*')")
    first = own.groupBy("key", "word").agg(F.min(F.struct("ord", "i")).alias("at"))
    return first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("route_path"))


def _closure(start: DataFrame, steps: DataFrame, hops: int | None = None) -> DataFrame:
    """Everything reached from start (origin, at) over steps (at, to), origin included, in at most ``hops`` steps if given."""
    met = cut(start.select("origin", "at").distinct())
    level = met
    for _ in count() if hops is None else range(hops):
        level = cut(level.join(steps, "at").select("origin", F.col("to").alias("at")).distinct().join(met, ["origin", "at"], "left_anti"))
        if level.isEmpty():
            break
        met = cut(met.unionByName(level))
    return met


def included_scopes(includes: DataFrame) -> DataFrame:
    """origin, at: scopes that query, mutation and subscription take in, directly or not. includes: scope, included."""
    roots = includes.sparkSession.createDataFrame([("query",), ("mutation",), ("subscription",)], "origin string").withColumn("at", F.col("origin"))
    return _closure(roots, includes.select(F.col("scope").alias("at"), F.col("included").alias("to")))


def expand_fragments(spreads: DataFrame, fragments: DataFrame) -> DataFrame:
    """operation, field of fields that come by fragments, at most four spreads deep; cycles end by themselves.

    spreads: owner (operation or fragment), fragment; fragments: fragment, field.
    """
    inner = fragments.select("fragment").distinct()
    ops = spreads.join(inner.withColumnRenamed("fragment", "owner"), "owner", "left_anti")
    start = ops.select(F.col("owner").alias("origin"), F.col("fragment").alias("at"))
    met = _closure(start, spreads.select(F.col("owner").alias("at"), F.col("fragment").alias("to")), MAX_FRAGMENT_HOPS - 1)
    return met.join(fragments.withColumnRenamed("fragment", "at"), "at").select(F.col("origin").alias("operation"), "field").distinct()


def descend(selections: DataFrame, fields: DataFrame) -> DataFrame:
    """selection, field_key: the field that ends each selection path, through the return types of the fields before it.

    selections: selection, root_type, path (array); fields: type, field, returns, field_key.
    """
    state = selections.select("selection", F.col("root_type").alias("type"), "path", F.lit(0).alias("i"), F.lit(None).cast("string").alias("field_key"))
    done = None
    while done is None or not state.isEmpty():
        state = state.withColumn("field", F.get("path", F.col("i"))).join(fields.withColumnRenamed("field_key", "fk"), ["type", "field"]).select(
            "selection", F.col("returns").alias("type"), "path", (F.col("i") + 1).alias("i"), F.col("fk").alias("field_key"))
        state = cut(state)
        end = state.filter("i = size(path)").select("selection", "field_key")
        done = end if done is None else done.unionByName(end)
        state = state.filter("i < size(path)")
    return done.distinct()


def _split(hits: DataFrame, by: str, base: float, kind: str) -> DataFrame:
    one = hits.select(by, "src", "dst").distinct()
    out = one.withColumn("confidence", F.lit(base) / F.count("*").over(Window.partitionBy(by))).filter("src <> dst")
    return out.select("src", "dst", F.lit(kind).alias("kind"), "confidence")


def graphql_edges(operations: DataFrame, resolvers: DataFrame) -> DataFrame:
    """Operation -> resolver at 0.9 / N. operations: op, key, scope, field; resolvers: scope, field, key."""
    hit = operations.select("op", F.col("key").alias("src"), "scope", "field").join(resolvers.select("scope", "field", F.col("key").alias("dst")), ["scope", "field"])
    return _split(hit, "op", CONF_GRAPHQL, "GraphqlCall")


def context_edges(loads: DataFrame, modules: DataFrame) -> DataFrame:
    """Field -> functions of the context module that a data loader names, at 0.5 / N. loads: load, key, context; modules: context, key."""
    return _split(loads.select("load", F.col("key").alias("src"), "context").join(modules.select("context", F.col("key").alias("dst")), "context"), "load", CONF_CONTEXT_MODULE, "GraphqlCall")


def star_import_calls(calls: DataFrame, stars: DataFrame, functions: DataFrame, local: DataFrame) -> DataFrame:
    """Bare calls through ``import Mod``: a name of the file itself wins. calls: call, key, module_path, name; stars: module_path, fqn; functions: fqn, name, key; local: module_path, name."""
    own = calls.join(local.select("module_path", "name").distinct(), ["module_path", "name"], "left_anti")
    hit = own.join(stars, "module_path").select("call", F.col("key").alias("src"), "fqn", "name").join(functions.select("fqn", "name", F.col("key").alias("dst")), ["fqn", "name"])
    return _split(hit, "call", CONF_STAR, "Calls")


def fqn_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls spelled with their full module name, at 0.9 / N. calls: call, key, fqn, name."""
    hit = calls.select("call", F.col("key").alias("src"), "fqn", "name").join(functions.select("fqn", "name", F.col("key").alias("dst")), ["fqn", "name"])
    return _split(hit, "call", CONF_QUALIFIED_CALL, "Calls")


def entity_edges(references: DataFrame, schemas: DataFrame) -> DataFrame:
    """References to modules that declare a table, at 0.85 / N. references: ref, key, fqn; schemas: fqn, key."""
    hit = references.join(schemas.select("fqn").distinct(), "fqn", "left_semi").select("ref", F.col("key").alias("src"), "fqn").join(schemas.select("fqn", F.col("key").alias("dst")), "fqn")
    return _split(hit, "ref", CONF_DB, "DbQuery")


def all_passes(*passes: DataFrame) -> DataFrame:
    """The edges of all passes; of one (src, dst, kind) the first pass wins."""
    out = None
    for i, p in enumerate(passes):
        p = p.select("src", "dst", "kind", "confidence", F.lit(i).alias("pass_no"), F.lit(0).alias("ord"))
        out = p if out is None else out.unionByName(p)
    return emit(out).select("src", "dst", "kind", "confidence")
