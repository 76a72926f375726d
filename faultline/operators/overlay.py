"""History and risk: churn, bug density, ownership, co-change, fanout.

commit_files: commit, seq (0 is the newest), author, file, is_fix. One row per file of a commit; repeats count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import COMMIT_WINDOW, FIX_WORDS, MAX_FILES_PER_COMMIT, MAX_RENAME_HOPS, MIN_COUPLING, MIN_SHARED, RISK_WEIGHTS
from .graph import test_side
from .order import with_place, with_share_below


def is_fix(message: Column) -> Column:
    return F.lower(message).rlike("|".join(FIX_WORDS))


def usable_commits(commit_files: DataFrame, window: int = COMMIT_WINDOW, least: int = 1, most: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Files of the newest commits that touch least to most files (bulk commits say nothing about single files)."""
    files = cut(commit_files.select("commit", "seq", "author", "file", "is_fix").distinct())
    size = files.groupBy("commit").agg(F.count("*").alias("n_files"), F.min("seq").alias("first_seq")).filter(F.col("n_files").between(least, most))
    newest = size.orderBy("first_seq", "commit").limit(window).select("commit")
    return files.join(newest, "commit", "left_semi")


def file_stats(commit_files: DataFrame) -> DataFrame:
    """file, commits, fixes, authors."""
    return commit_files.groupBy("file").agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct(F.when(F.col("is_fix"), F.col("commit"))).alias("fixes"), F.countDistinct("author").alias("authors"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def file_risk(stats: DataFrame) -> DataFrame:
    """Percentiles over files with history: churn (commits), bug_density (fixes / commits), ownership (1 / authors)."""
    raw = stats.withColumn("fix_ratio", ratio(F.col("fixes"), F.col("commits"))).withColumn("owner", ratio(F.lit(1.0), F.col("authors")))
    out = with_share_below(raw, "commits", "churn")
    out = with_share_below(out, "fix_ratio", "bug_density")
    return with_share_below(out, "owner", "ownership").drop("fix_ratio", "owner")


def informative(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether it varies at all."""
    return rows.agg(*((F.max(c) - F.min(c) > 1.1920929e-7).alias(c) for c in columns))


def blend(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with composite: the weighted mean of the terms that vary, 0 where none does."""
    flags = informative(rows, list(weights)).select(*(F.coalesce(c, F.lit(False)).alias(f"_{c}") for c in weights))
    both = rows.crossJoin(F.broadcast(flags))  # one row
    weight = sum((F.when(F.col(f"_{c}"), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    total = sum((F.when(F.col(f"_{c}"), F.lit(float(w)) * F.col(c)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return both.withColumn("composite", ratio(total, weight)).drop(*(f"_{c}" for c in weights))


def cochange(commit_files: DataFrame, min_shared: int = MIN_SHARED, min_coupling: float = MIN_COUPLING) -> DataFrame:
    """a, b, shared, coupling of unordered pairs (a < b): shared commits over those of the file with fewer.

    commit_files must have bulk commits removed, which bounds the pairs of a commit.
    """
    files = commit_files.select("commit", "file").distinct()
    per_commit = files.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    pairs = per_commit.select("files", F.posexplode("files").alias("i", "a")).select("a", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    sizes = files.groupBy("file").agg(F.count("*").alias("n"))
    of = lambda side: sizes.select(F.col("file").alias(side), F.col("n").alias(f"n_{side}"))
    out = shared.join(of("a"), "a").join(of("b"), "b").withColumn("coupling", F.least(F.lit(1.0), F.col("shared") / F.least("n_a", "n_b")))
    return out.filter(F.col("coupling") >= min_coupling).select("a", "b", "shared", "coupling")


def apply_overlay(nodes: DataFrame, modules: DataFrame, risk: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with their file's risk; ChangesWith edges both ways between modules (key, module_path) that are indexed."""
    scored = nodes.join(risk.withColumnRenamed("file", "module_path"), "module_path", "left")
    key = lambda side: modules.select(F.col("module_path").alias(side), F.col("key").alias(f"k_{side}"))
    both = pairs.join(key("a"), "a").join(key("b"), "b")
    edge = lambda s, d: both.select(F.col(s).alias("src"), F.col(d).alias("dst"), F.lit("ChangesWith").alias("kind"), F.col("coupling").alias("confidence"))
    return scored, edge("k_a", "k_b").unionByName(edge("k_b", "k_a"))


def fanout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, dependents, fanout: distinct dependents that are no tests, as a percentile over all nodes."""
    own = edges.filter("kind NOT IN ('Tests', 'ChangesWith')").join(test_side(edges).withColumnRenamed("key", "src"), "src", "left_anti")
    counts = own.filter("src <> dst").select("src", "dst").distinct().groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("dependents"))
    all_nodes = nodes.select("key").join(counts, "key", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return with_share_below(all_nodes, "dependents", "fanout")


def structural_risk(nodes: DataFrame, edges: DataFrame, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """nodes (with churn, bug_density, ownership; absent is 0) with fanout and the composite."""
    terms = [c for c in ("churn", "bug_density", "ownership") if c in nodes.columns]
    out = nodes.drop("composite", "fanout").join(fanout(nodes, edges).select("key", "fanout"), "key")
    for c in ("churn", "bug_density", "ownership"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)) if c in terms else F.lit(0.0))
    return blend(out, weights)


def rename_pointers(renames: DataFrame) -> DataFrame:
    """renames (seq, old, new; seq 0 is the newest) with the seq of the rename that follows each, if any.

    The next rename of a name is the closest newer one that renames it again.
    """
    nxt = renames.select(F.col("seq").alias("next_seq"), F.col("old").alias("new"))
    later = renames.join(nxt, "new").filter("next_seq < seq").groupBy("seq", "old", "new").agg(F.max("next_seq").alias("next_seq"))
    return renames.join(later, ["seq", "old", "new"], "left")


def current_names(files: DataFrame, renames: DataFrame) -> DataFrame:
    """files (seq, file) with ``current``: the file's name after all newer renames, at most MAX_RENAME_HOPS of them."""
    steps = cut(rename_pointers(renames).select(F.col("seq").alias("r_seq"), "old", "new", "next_seq"))
    first = files.join(steps.select("r_seq", "old"), (F.col("file") == F.col("old")) & (F.col("r_seq") < F.col("seq")), "left")
    state = first.groupBy("seq", "file").agg(F.max("r_seq").alias("at_seq")).withColumn("current", F.col("file"))
    for _ in range(MAX_RENAME_HOPS):
        moved = state.join(steps, (F.col("at_seq") == F.col("r_seq")) & (F.col("current") == F.col("old")), "left")
        state = cut(moved.select("seq", "file", F.coalesce("new", "current").alias("current"), F.col("next_seq").alias("at_seq")))
        if state.filter("at_seq IS NOT NULL").isEmpty():
            break
    return state.select("seq", "file", "current")


def holdout(commit_files: DataFrame, k: int, skip: int = 0) -> DataFrame:
    """commit, part ('skip', 'test', 'train'): k newest eligible commits are the test; only strictly older ones train.

    Eligible commits touch 2 to 40 files. Whatever is newer than the last test commit trains nothing.
    """
    sizes = commit_files.select("commit", "seq", "file").distinct().groupBy("commit", "seq").agg(F.count("*").alias("n"))
    eligible = F.col("n").between(2, MAX_FILES_PER_COMMIT)
    # Places of the cuts come from the newest skip + k eligible commits alone.
    head = sizes.filter(eligible).orderBy("seq", "commit").limit(skip + k).withColumn("i", F.row_number().over(Window.orderBy("seq", "commit")))
    cuts = head.agg(F.coalesce(F.max(F.when(F.col("i") <= skip, F.col("seq"))), F.lit(-1)).alias("skip_to"), F.max("seq").alias("test_to"), F.count("*").alias("n_head"))
    tagged = sizes.crossJoin(F.broadcast(cuts))
    part = (
        F.when(F.col("seq") <= F.col("skip_to"), F.lit("skip"))
        .when((F.col("seq") <= F.col("test_to")) | (F.col("n_head") < skip + k), F.when(eligible, F.lit("test")))
        .when(F.col("n") <= MAX_FILES_PER_COMMIT, F.lit("train"))
    )
    return tagged.select("commit", "seq", part.alias("part")).filter("part IS NOT NULL")


def precision_at(files: DataFrame, score: str, fraction: float) -> DataFrame:
    """k, precision, base, lift of the files (file, fixed boolean) ranked by score; ties by path."""
    n = files.agg(F.count("*").alias("n"), F.avg(F.col("fixed").cast("double")).alias("base"))
    n = n.withColumn("k", F.greatest(F.lit(1), F.round(F.col("n") * fraction)).cast("int"))
    # How many come before: rows with a larger score, from counts of scores; ties go by path within their score.
    placed = with_place(files, score, "place")
    tied = Window.partitionBy(score).orderBy("file")
    both = placed.withColumn("r", F.col("place") + F.row_number().over(tied)).crossJoin(F.broadcast(n))
    top = both.filter(F.col("r") <= F.col("k")).groupBy("k", "base").agg(F.avg(F.col("fixed").cast("double")).alias("precision"))
    return top.select("k", "precision", "base", ratio(F.col("precision"), F.col("base")).alias("lift"))


def max_coupling(pairs: DataFrame) -> DataFrame:
    """file, coupling: the strongest coupling of each file in pairs (a, b, coupling)."""
    both = pairs.select(F.col("a").alias("file"), "coupling").unionByName(pairs.select(F.col("b").alias("file"), "coupling"))
    return both.groupBy("file").agg(F.max("coupling").alias("coupling"))
