"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Every text is cut where its content says so (after a sentence or line end, between
``MIN_CHUNK`` and ``MAX_CHUNK`` characters), so equal passages give equal chunks wherever
they stand. Chunk contents cross the network once, to be deduplicated (and pre-combined
within each task) and to verify that one 64-bit identifier stands for one content. Texts
are then compared by their ordered identifier lists, which are some hundred times shorter.
A text that holds a chunk whose identifier turned out to be shared by two contents is
compared by the SHA-256 of its whole text as well, so no result rests on a 64-bit hash.
Where no identifier is shared (the usual case) nothing is joined to find that out.

Null text counts as empty; empty texts form one group. A null doc_id counts as the smallest. Rows that repeat a doc_id each give
a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_sql import NO_ID, free_name, masked, unmasked

MIN_CHUNK, MAX_CHUNK = 256, 2048


def chunks(text: Column) -> Column:
    """Ordered chunks whose concatenation is the text; none for an empty one."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?\n])|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def collided_chunks(recipes: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk content; normally none."""
    pairs = recipes.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("chunk_id"), "chunk")
    return pairs.distinct().groupBy("chunk_id").count().filter("count > 1").select("chunk_id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256; one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = masked(docs).select("doc_id", text.alias("text")).withColumn("chunks", chunks(F.col("text")))
    shared = Scratch(docs.sparkSession, "exact").put("shared", collided_chunks(cut))
    recipes = cut.select(
        "doc_id",
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )
    if shared.isEmpty():
        # The usual case: every identifier stands for one content, so lists of them are proof enough.
        keyed = recipes.withColumn("proof", F.lit(None).cast("string"))
    else:
        held = F.col("doc_id"), F.col("text_sha256")
        doubtful = recipes.select(*held, F.explode(F.array_distinct("recipe")).alias("chunk_id")).join(shared, "chunk_id", "left_semi").select(*held).distinct()
        keyed = recipes.join(doubtful.withColumn("doubtful", F.lit(True)), ["doc_id", "text_sha256"], "left").select(
            "doc_id", "recipe", "text_sha256", F.when(F.col("doubtful"), F.col("text_sha256")).alias("proof"))
    groups = keyed.groupBy("recipe", "proof").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Most texts stand alone; only groups of two or more are joined back.
    several = groups.filter("group_size > 1").select(
        F.col("recipe").alias("g_recipe"), F.col("proof").alias("g_proof"), "keep_id", "group_size"
    )
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("proof").eqNullSafe(F.col("g_proof"))
    out = keyed.join(several, same, "left")
    keep = F.coalesce("keep_id", "doc_id")
    out = out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id") == keep).alias("kept"),
        "text_sha256",
    )
    return unmasked(out, "doc_id", "keep_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id; one of rows repeating both."""
    kept = exact_groups(docs).filter("kept")
    key, sha = free_name(docs, "_kept_id"), free_name(docs, "_kept_sha")
    wanted = masked(kept).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    own = free_name(docs, "_sha"), free_name(docs, "_id")
    rows = docs.withColumn(own[0], F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn(own[1], F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = rows.join(wanted, (rows[own[1]] == wanted[key]) & (rows[own[0]] == wanted[sha]), "left_semi")
    return rows.dropDuplicates([own[1], own[0]]).drop(*own)


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
