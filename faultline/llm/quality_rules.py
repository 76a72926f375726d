"""Quality rules with cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, digits to 0, runs of spaces to one), hashed, and counted
per host (``source``) over distinct document texts: exact copies of one text count once, so
a mirrored page does not turn its own lines into boilerplate. A line is removed where more
than ``max(min_docs, max_share * texts of the host)`` texts of its host hold it. A document
that loses so many words that fewer than ``min_left_share`` of them stay is rejected.
The base rules (enough words, not too many repeated three-word windows) come first.

Null text has no words and fails the base rules; null and empty are one text of a host;
null hosts form one host. Rows that repeat a doc_id each give a row, judged by its own text. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_sql import NO_ID, free_name, masked, text_hash, unmasked, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(hashes: str, n: Column) -> Column:
    """Words that lie in a three-word window found twice or more, from sorted (hash, place) pairs of the windows.

    Adjacent equal hashes mark the repeated windows; their sorted places then cover
    min(3, distance to the next place) words each.
    """
    col = F.col(hashes)
    size = F.size(col)
    before = F.zip_with(col, F.concat(F.array(F.lit(None).cast(WINDOW)), F.slice(col, 1, F.greatest(size - 1, F.lit(0)))),
                        lambda a, b: a["h"] == b["h"])
    after = F.zip_with(col, F.slice(col, 2, F.greatest(size, F.lit(1))), lambda a, b: a["h"] == b["h"])
    either = F.zip_with(before, after, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    places = F.array_sort(
        F.transform(
            F.filter(F.zip_with(col, either, lambda w, e: F.struct(w["i"].alias("i"), e.alias("e"))), lambda x: x["e"]),
            lambda x: x["i"],
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-3).alias("last"))
    # Runs of places are folded left to right: each adds the words that the one before did not cover.
    return F.when(size < 2, F.lit(0).cast("long")).otherwise(
        F.aggregate(
            places,
            start,
            lambda s, i: F.struct(
                (s["covered"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("covered"), i.alias("last")
            ),
            lambda s: s["covered"],
        )
    )


WINDOW = "struct<h:bigint,i:int>"


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key and the base counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = F.col("w")
    cut = masked(docs).select("doc_id", text_hash(F.col("source")).alias("h"), "source", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = cut.select(
        "doc_id",
        "h",
        "source",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("hw"),
    )
    # Two names are dropped so that the optimiser keeps the hashes of the words as a column of their own.
    n = F.size("hw")
    windows = F.array_sort(
        F.filter(
            F.transform(
                F.arrays_zip(F.col("hw").alias("a"), F.slice("hw", 2, F.greatest(n, F.lit(1))).alias("b"),
                             F.slice("hw", 3, F.greatest(n, F.lit(1))).alias("c")),
                lambda t, i: F.when(t["c"].isNotNull(), F.struct(F.xxhash64(t["a"], t["b"], t["c"]).alias("h"), i.alias("i"))),
            ),
            lambda x: x.isNotNull(),
        )
    )
    windowed = hashed.select(
        "doc_id", "h", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    out = windowed.withColumn("n_repeat_words", repeated_words("windows", F.col("n_words"))).drop("windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def text_key() -> Column:
    """Tells texts apart; null and empty are one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each distinct normalised line of a document, with the words it holds there (repeats summed)."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    exploded = masked(docs).select(
        "doc_id", text_hash(F.col("source")).alias("h"), "source", text_key().alias("text_key"),
        F.explode(F.transform(lines, lambda x: F.struct(
            F.xxhash64(normalised(x)).alias("line"),
            F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("line_words"),
        ))).alias("l"),
    )
    return exploded.select("doc_id", "h", "source", "text_key", "l.line", "l.line_words")


def frequent_lines(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(source, line) of lines above the limits of their host."""
    seen = document_lines(docs).select("source", "line", "text_key").distinct()
    counts = seen.groupBy("source", "line").agg(F.count("*").alias("texts"))
    counts = counts.filter(F.col("texts") > min_docs)
    hosts = (
        docs.select("source", text_key().alias("text_key")).distinct()
        .groupBy("source").agg(F.count("*").alias("host_texts"))
        .withColumnRenamed("source", "host")
    )
    over = counts.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return over.filter(F.col("texts") > F.lit(max_share) * F.col("host_texts")).select("source", "line")


def removed_words(docs: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """doc_id, h, removed_words of documents that hold frequent lines; rows that are alike are summed."""
    hot = frequent_lines(docs, min_docs, max_share).select(F.col("source").alias("hot_source"), F.col("line").alias("hot_line"))
    held = document_lines(docs).join(
        hot, (F.col("line") == F.col("hot_line")) & F.col("source").eqNullSafe(F.col("hot_source"))
    )
    return held.groupBy("doc_id", "h").agg(F.sum("line_words").alias("removed_words"))


def quality(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05, min_left_share: float = 0.3) -> DataFrame:
    """The base counts, removed_words and the verdict of each document."""
    base = base_metrics(docs)
    out = base.join(removed_words(docs, min_docs, max_share), ["doc_id", "h"], "left")
    # Rows alike in id, text and source have the same lines, so each has its share of the sum.
    alike = F.count("*").over(Window.partitionBy("doc_id", "h"))
    out = out.withColumn("removed_words", (F.coalesce("removed_words", F.lit(0)) / alike).cast("long"))
    removed = F.col("removed_words")
    depleted = (F.col("n_words") - removed) < F.lit(min_left_share) * F.col("n_words")
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), removed.alias("removed_words"),
    )
    return unmasked(out)


def strip_lines(docs: DataFrame, min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    """docs with the frequent lines cut out of text."""
    hot = (
        frequent_lines(docs, min_docs, max_share).select(F.col("source").alias("hot_source"), F.col("line").alias("hot_line"))
    )
    held = document_lines(docs).join(
        hot, (F.col("line") == F.col("hot_line")) & F.col("source").eqNullSafe(F.col("hot_source"))
    )
    lines, key, own = free_name(docs, "_cut_lines"), free_name(docs, "_cut_id"), free_name(docs, "_cut_h")
    cut = held.groupBy(F.col("doc_id").alias(key), F.col("h").alias(own)).agg(F.collect_set("line").alias(lines))
    kept = F.array_join(
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1),
                 lambda x: ~F.array_contains(F.col(lines), F.xxhash64(normalised(x)))), "\n",
    )
    return (
        docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(own, text_hash(F.col("source"))).join(cut, [key, own], "left")
        .withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept))
        .select([f"`{c}`" for c in docs.columns])
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id
), ln AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \t-\r]+', ' ', 'g')) AS norm,
         len(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda x: x <> '')) AS line_words
  FROM ln WHERE regexp_matches(line, '[^ \t-\r]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_texts FROM d GROUP BY source
), freq AS (
  SELECT source, norm, count(DISTINCT text) AS texts FROM lw GROUP BY source, norm
), hot AS (
  SELECT f.source, f.norm FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.texts > 20 AND f.texts > 0.05 * h.host_texts
), gone AS (
  SELECT lw.doc_id, sum(line_words) AS removed_words
  FROM lw JOIN hot ON lw.norm = hot.norm AND lw.source IS NOT DISTINCT FROM hot.source GROUP BY lw.doc_id
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(gone.removed_words, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (n_words - removed_words < CAST(0.3 AS DOUBLE) * n_words) AS kept,
       removed_words
FROM m
"""
