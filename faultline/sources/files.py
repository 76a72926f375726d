"""Source files: discovery, roots, content hashes, incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_ignored, language_of
from ..schema import LANGUAGES

#: A glob of the names that some adapter reads.
SUFFIXES = "*{" + ",".join(x for own in LANGUAGES.values() for x in own) + "}"


def unique_tags(paths: list[str]) -> list[tuple[str, str]]:
    """(tag, path) of each root: its folder's name, with ~2, ~3, ... where a name comes again."""
    seen: dict[str, int] = {}
    out = []
    for p in paths:
        name = p.rstrip("/").rsplit("/", 1)[-1] or "root"
        seen[name] = seen.get(name, 0) + 1
        out.append((name if seen[name] == 1 else f"{name}~{seen[name]}", p.rstrip("/")))
    return out


def roots_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(i, tag, p) for i, (tag, p) in enumerate(unique_tags(paths))]
    return spark.createDataFrame(rows, "ord int, tag string, path string")


def claim(files: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per canonical file: the deepest root claims it. files: canonical, tag; roots: tag, path."""
    depth = F.length("root_path")
    # A row for each root that was named.
    both = files.join(F.broadcast(roots.select("tag", F.col("path").alias("root_path"))), "tag")
    first = Window.partitionBy("canonical").orderBy(F.desc(depth), "tag")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "root_path")


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """module_path, canonical, root, rel, language, hash, content of every known source file below the roots.

    Read by Spark's own reader, so the roots may lie in any store it opens. With several roots,
    module_path carries the root's tag.
    """
    roots = unique_tags(paths)
    found = None
    for tag, path in roots:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).load(path)
        canonical = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
        one = one.select(canonical.alias("canonical"), "content", F.lit(tag).alias("tag"), F.lit(path.split("://")[-1]).alias("base"))
        # Ignored folders are out before any content is carried on.
        one = one.withColumn("rel", F.expr("substring(canonical, instr(canonical, base) + length(base) + 1)")).filter(~is_ignored(F.col("rel"))).drop("rel")
        found = one if found is None else found.unionByName(one)
    table = spark.createDataFrame([(t, p) for t, p in roots], "tag string, path string")
    own = claim(found, table)
    rel = F.expr("substring(canonical, instr(canonical, base) + length(base) + 1)")
    out = own.withColumn("rel", rel).filter(~is_ignored(F.col("rel"))).withColumn("language", language_of(F.col("rel"))).filter("language IS NOT NULL")
    module = F.concat_ws("/", "tag", "rel") if len(roots) > 1 else F.col("rel")
    return out.select(module.alias("module_path"), "canonical", F.col("tag").alias("root"), "rel", "language", F.sha2("content", 256).alias("hash"), "content")


def configurations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """module_path, root, content of package, module and compiler settings and of API specifications below the roots; ignored folders are out."""
    roots, found = unique_tags(paths), None
    for tag, path in roots:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{.json,.yaml,.yml,go.mod}").load(path)
        base = path.split("://")[-1]
        rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*(?=/)', ''), {len(base) + 2})")
        one = one.withColumn("rel", rel).filter(~is_ignored(F.col("rel")))
        module = F.concat(F.lit(f"{tag}/"), F.col("rel")) if len(roots) > 1 else F.col("rel")
        one = one.select(module.alias("module_path"), F.lit(tag).alias("root"), "content")
        found = one if found is None else found.unionByName(one)
    return found


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """module_path, state (added, changed, unchanged, removed) from two tables of (module_path, hash)."""
    now = current.select("module_path", F.col("hash").alias("now"))
    both = now.join(previous.select("module_path", F.col("hash").alias("was")), "module_path", "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return both.select("module_path", state.alias("state"))


def to_extract(files: DataFrame, previous: DataFrame) -> DataFrame:
    """The files whose extract can't be taken over."""
    return files.join(previous.select("module_path", "hash"), ["module_path", "hash"], "left_anti")


def stale(stamps: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed files that changed or are gone; files that were never indexed are not stale."""
    now = current.select("module_path", F.col("hash").alias("now"))
    return stamps.join(now, "module_path", "left").filter("now IS NULL OR now <> hash").select("module_path")


def languages_per_root(files: DataFrame) -> DataFrame:
    """root, languages (distinct, in order, joined by a space)."""
    own = files.select("root", "language").distinct()
    return own.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("language")), " ").alias("languages"))


def dropped_roots(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Roots of the previous index that the current one no longer has."""
    return previous.select("root").distinct().join(current.select("root").distinct(), "root", "left_anti")
