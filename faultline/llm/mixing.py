"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a word budget (its target). Complete epochs come first: each document of
a source is taken floor(target / source size) times. The rest of the budget is sampled
without replacement: a document's key is -ln(u) / w, with u drawn from a hash of its doc_id
and w its quality weight; the documents with the smallest keys are taken while their
prefix sum of sizes stays nearest the rest.

No sort ever holds a whole source. Keys are cut into ``BUCKETS`` ranges; the ranges are
prefix-summed per source (at most ``BUCKETS`` rows each, pre-aggregated within tasks), and
only the documents of the one range in which the budget ends are ordered.

Null text has size 0. A null source is a source of its own, last in order. Rows that repeat
a doc_id count each. Extra columns are ignored. A source of size 0 has target 0. An empty
table gives an empty result. Reruns agree: nothing depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_sql import NO_ID, free_name, masked, n_words, text_hash, unit_hash, unmasked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
BUCKETS = 4096


def quality_weight(text: Column, size: Column) -> Column:
    """1 for clean text, down to 0.1 as symbols take the place of words."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.1), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def sized(docs: DataFrame) -> DataFrame:
    size = n_words(F.col("text"))
    out = masked(docs).select("doc_id", text_hash(F.col("source")).alias("h"), "source", size.alias("size"), quality_weight(F.col("text"), size).alias("w"))
    exponential = -F.log(unit_hash(F.col("doc_id"), seed=5)) / F.col("w")
    # 1 - e^-key is between 0 and 1 and rises with the key, so its ranges are ranges of keys.
    place = F.floor((F.lit(1.0) - F.exp(-exponential)) * BUCKETS)
    return out.select("doc_id", "h", "source", "size", exponential.alias("es_key"),
                      F.least(place, F.lit(BUCKETS - 1)).cast("int").alias("bucket"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size): weights repeat over the sources by code point.

    A target is min(2 * size, level * weight) with one level for all sources. Sources are
    taken by rising 2 * size / weight: the first for which the level that is left does
    not exceed that ratio, and all after it, get level * weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * F.lit(MAX_EPOCHS)
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left_words = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left_words / left_weight)
    # The level of the first source that is not capped; a later one would give the same.
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")),
                     F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.coalesce("source", F.lit(""))))).over(everything)
    return t.withColumn("common", level).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight"))).alias("target"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times the copies the mix takes) and copies, per row of docs."""
    return unmasked(mixed(docs).drop("h"))


def mixed(docs: DataFrame) -> DataFrame:
    """The same with doc_id masked and h, which tells rows of other texts or sources apart."""
    items = sized(docs)
    ranges = items.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes).select(F.col("source").alias("t_source"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    budget = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        ranges.withColumn("before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
        .join(targets, same)
        .withColumn("epochs", budget.cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("edge", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("range_size") > F.col("rest")))
        .select(F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "source_size", "target", "epochs",
                "rest", "before", "range_size", "edge")
    )
    placed = items.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    whole = placed.filter(~F.col("edge")).withColumn(
        "copies", F.col("epochs") + F.when(F.col("before") + F.col("range_size") <= F.col("rest"), 1).otherwise(0)
    )
    inside = Window.partitionBy("source", "bucket").orderBy("es_key", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = placed.filter("edge").withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    nearer = F.col("before") + F.col("size") - F.col("rest") <= F.col("rest") - F.col("before")
    at_edge = at_edge.withColumn("copies", F.col("epochs") + F.when(nearer & (F.col("before") < F.col("rest")), 1).otherwise(0))
    cols = ["doc_id", "h", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
            F.col("copies").cast("long").alias("copies")]
    return whole.select(cols).unionByName(at_edge.select(cols))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it (0, 1 or 2 times)."""
    key, own, each, turn, i = (free_name(docs, n) for n in ("_mix_id", "_mix_h", "_mix_copies", "_mix_turn", "_mix_copy"))
    # Rows that are alike in id, text and source share out the copies that the mix gives to them.
    copies = mixed(docs).groupBy(F.col("doc_id").alias(key), F.col("h").alias(own)).agg(F.sort_array(F.collect_list(F.col("copies").cast("int")), asc=False).alias(each))
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, text_hash(F.col("source")))
    rows = rows.join(copies.filter(F.col(each)[0] > 0), [key, own]).withColumn(turn, F.row_number().over(Window.partitionBy(key, own).orderBy(key)))
    times = F.get(F.col(each), F.col(turn) - 1)
    return rows.withColumn(i, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select([f"`{c}`" for c in docs.columns])
