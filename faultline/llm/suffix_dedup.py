"""Removal of repeated byte strings by bucket-pointer refinement.

Texts are UTF-8 bytes and matches never cross documents. Every byte in a ``length``-byte
string that also starts earlier (smaller doc_id, or the same document further left) goes;
strings are judged on the input. Of copies of one text only the earliest keeps its bytes.

Which suffixes are bucketed: each window of ``length`` bytes picks one of its q-grams
(``gram`` bytes) as its anchor, the one with the least fingerprint, leftmost on ties. Equal
windows pick the same gram at the same place, so suffixes that start at anchors are enough
(one in thirty or so), and a sketch of all anchor grams drops those that are surely unique.

  1. Anchors are dealt into initial buckets by their gram, and within a bucket into classes
     by all bytes that a window over the anchor can touch. All but the earliest member of a
     class are covered as far as these bytes reach.
  2. In a bucket that holds several classes, the earliest member of each brings these bytes.
     Buckets are then refined by sorting on identifiers at later offsets: of the bytes to the
     right of the gram, and of those to its left. A level is sorted on the identifiers of
     the level before and those one offset further; who is alone in a bucket is done. The
     buckets of windows come from sorting on the identifiers of both parts, which all
     windows over the gram share. Identifiers are ranks, so nothing collides here. Members
     of a last bucket hold equal windows; all but the earliest are covered.
  3. Half the bytes on one side of the anchor split a bucket before it is refined (a window
     reaches that far on one side or the other), so a gram that many texts share is many
     small buckets. One that still has more than ``SPLIT`` classes is not brought together:
     its windows are grouped as rows, by their bytes.
  4. Covered ranges are joined to their document and merged.

A passage in thousands of documents gives one class with thousands of members and rows stay
linear in the anchors. Classes rest on a fingerprint of 64 bits for the gram and another of
64 bits for the bytes around it.

Null counts as empty; texts shorter than ``length`` stay whole. Rows that repeat a doc_id
with other texts are documents of their own, one after the other by a hash of the text;
rows that repeat both are one document and lose the same bytes. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Spans, blocks, byte_values, mixed
from .repeats import anchors, covered_mask, ranges_of
from .scratch import Scratch
from .sketch import maybe_repeated, repeated_bits, seen_bits
from .text_sql import masked, text_hash, unmasked

LENGTH, GRAM = 100, 32
SKETCH_BITS = 27
#: Classes of a split bucket that are brought together at most, and of all buckets in one task (on average).
SPLIT, TOGETHER = 4096, 12_288


def read_bytes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    return byte_values(b.data), b.offsets


def _column(b: Block, name: str) -> np.ndarray:
    return b.batch.column(name).to_numpy(zero_copy_only=False)[b.rows]


def _grams(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in blocks(batches):
            units, first = read_bytes(b)
            yield anchors(units, first, window, gram)[1]

    return run


def _place_key(doc: np.ndarray, h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for a place of a document."""
    with np.errstate(over="ignore"):
        return mixed(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h.astype(np.int64).view(np.uint64) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield _place_key(*(b.column(c).to_numpy() for c in ("doc_id", "h", "place")))


CANDIDATE = "key long, around long, doc_id long, h long, place int, before short, after short"
CONTEXT = "key long, doc_id long, h long, place int, before short, after short, left long, right long, bytes binary"


def _arrow(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "binary": pa.binary()}
    pairs = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64) if k == "long" else c, kinds[k]) for c, (_, k) in zip(columns, pairs, strict=True)], names=[n for n, _ in pairs])


def _candidates(window: int, gram: int, again, bits: int):
    """Anchors whose gram may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - gram
        for b in blocks(batches):
            units, first = read_bytes(b)
            place, key, doc, _ = anchors(units, first, window, gram)
            ok = maybe_repeated(key, again.value, bits)
            place, key, doc = place[ok], key[ok], doc[ok]
            if len(place):
                before = np.minimum(place - first[doc], reach)
                after = np.minimum(first[doc + 1] - place - gram, reach)
                around = Spans(units, 1).of(place - before, place + gram + after) + before.astype(np.uint64)
                yield _arrow(CANDIDATE, [key, around, b.doc_id[doc], _column(b, "h")[doc], place - first[doc], before, after])

    return run


def _contexts(window: int, gram: int, asked, bits: int):
    """The bytes around the anchors that are asked for, and fingerprints of half of them on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - gram
        half = reach // 2
        for b in blocks(batches):
            units, first = read_bytes(b)
            place, key, doc, _ = anchors(units, first, window, gram)
            h = _column(b, "h")
            ok = maybe_repeated(_place_key(b.doc_id[doc], h[doc], place - first[doc]), asked.value, bits)
            place, key, doc = place[ok], key[ok], doc[ok]
            if len(place):
                before = np.minimum(place - first[doc], reach)
                after = np.minimum(first[doc + 1] - place - gram, reach)
                spans = Spans(units, 1)
                left = spans.of(place - np.minimum(before, half), place + gram)
                right = spans.of(place, place + gram + np.minimum(after, half)) + np.uint64(1)
                around = [b.data[p - x : p + gram + y].tobytes() for p, x, y in zip(place.tolist(), before.tolist(), after.tolist(), strict=True)]
                yield _arrow(CONTEXT, [key, b.doc_id[doc], h[doc], place - first[doc], before, after, left, right, around])

    return run


# --- refinement ----------------------------------------------------------------------------


def refined(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers (ranks), sorted on the bucket and on an identifier at a later place; -1 for who is alone in a bucket."""
    _, rank, size = np.unique(bucket.astype(np.int64) * (int(later.max(initial=0)) + 1) + later, return_inverse=True, return_counts=True)
    return np.where(size[rank] > 1, rank, -1)


def levels(bucket: np.ndarray, text: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Identifiers of the rows of a bucket by their first 0, 1, 2, ... bytes; -1 for rows alone in their bucket or without so many bytes (there).

    Each level sorts on the level before and on the byte at the next later place; who is alone is not sorted again.
    """
    out, alive = [bucket], np.arange(len(bucket))
    for k in range(text.shape[1]):
        alive = alive[there[alive] > k]
        own = refined(out[-1][alive], text[alive, k])
        level = np.full(len(bucket), -1, np.int64)
        level[alive] = own
        alive = alive[own >= 0]
        out.append(level)
    return out


def _refined(window: int, gram: int):
    """Covered ranges of the classes of whole split buckets."""
    reach = window - gram
    half = reach // 2

    def run(t: pa.Table) -> pa.Table:
        side, before, after, doc, h, place, sub = (t.column(c).to_numpy() for c in ("side", "before", "after", "doc_id", "h", "place", "sub"))
        before, after = before.astype(np.int64), after.astype(np.int64)
        own = t.column("bytes").combine_chunks().cast(pa.large_binary())
        data = np.frombuffer(own.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        _, doc_rank = np.unique(np.stack([doc, h], axis=1), axis=0, return_inverse=True)
        doc_rank = doc_rank.reshape(-1)
        out: list = []
        for s in (1, 2):
            rows = np.flatnonzero(side == s)
            # How many bytes lie on either side of what all rows of a split bucket share; windows reach left by x and right by the rest.
            near, far = (half, 0) if s == 1 else (0, half)
            width = reach - half
            if not len(rows) or s == 2 and not half:
                continue
            left, right = np.zeros((len(rows), width), np.uint8), np.zeros((len(rows), width), np.uint8)
            base, lead, tail = offsets[rows], before[rows] - near, after[rows] - far
            for k in range(width):
                has = lead > k
                left[has, k] = data[base[has] + lead[has] - 1 - k]
                has = tail > k
                right[has, k] = data[base[has] + before[rows][has] + gram + far + k]
            bucket = np.unique(sub[rows], return_inverse=True)[1].reshape(-1)
            lefts, rights = levels(bucket, left, lead), levels(bucket, right, tail)
            hit = np.zeros((len(rows), width + 2), np.int8)
            # Windows of the right side that reach half or more to the left are the left side's.
            for x in range(width + 1 if s == 1 else min(width, half - 1) + 1):
                own_ = np.flatnonzero((lefts[x] >= 0) & (rights[width - x] >= 0))
                last = refined(lefts[x][own_], rights[width - x][own_])
                own_, last = own_[last >= 0], last[last >= 0]
                # Equal windows, the earliest in front. Two anchors may bring the same window.
                start, of = place[rows][own_] - near - x, doc_rank[rows][own_]
                order = np.lexsort((start, of, last))
                own_, last, start, of = own_[order], last[order], start[order], of[order]
                new = np.concatenate([[True], last[1:] != last[:-1]]) if len(own_) else np.zeros(0, bool)
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                hit[own_, width - x] = (start != start[first]) | (of != of[first])
            # Windows next to each other are one range; column c starts at place - near - width + c.
            edge = np.diff(hit, axis=1, prepend=np.zeros((len(rows), 1), np.int8))
            r, a = np.nonzero(edge == 1)
            b = np.nonzero(edge == -1)[1]
            at = rows[r]
            out.append((doc[at], h[at], place[at] - near - width + a, place[at] - near - width + b - 1 + window))
        doc, h, a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    return run


def _ranges(rows: DataFrame) -> DataFrame:
    pair = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    return rows.groupBy("doc_id", "h").agg(F.collect_set(pair).alias("ranges"))


def repeated_bytes(docs: DataFrame, window: int, gram: int, bits: int, split: int = SPLIT, together: int = TOGETHER) -> DataFrame:
    """doc_id, h, ranges (array of struct<a, b>: bytes a to b - 1) that equal an earlier window; not merged.

    docs has doc_id (long), h (long, a hash of the text) and text (binary).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    again = spark.sparkContext.broadcast(repeated_bits(docs, _grams(window, gram), bits))
    cand = scratch.put("candidates", docs.mapInArrow(_candidates(window, gram, again, bits), CANDIDATE))
    again.unpersist()
    where = F.struct("doc_id", "h", "place")
    classes = scratch.put("classes", cand.groupBy("key", "around").agg(
        F.min(where).alias("first"), F.count("*").alias("members"), F.first("before").alias("before"), F.first("after").alias("after")))
    scratch.drop()
    reach = window - gram
    half = reach // 2
    wide = F.col("before") + F.col("after") >= reach
    later = where > F.col("first")
    covered = cand.join(classes.filter("members > 1").select("key", "around", "first"), ["key", "around"]).filter(later & wide)
    covered = covered.select("doc_id", "h", (F.col("place") - F.col("before")).alias("a"), (F.col("place") + gram + F.col("after")).alias("b"))
    whole = scratch.put("whole", _ranges(covered))
    scratch.drop("candidates")

    # Where classes share the gram, the earliest member of each brings its bytes.
    several = classes.filter(wide).groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key")
    asked = scratch.put("asked", classes.filter(wide).join(several, "key", "left_semi").select("first.doc_id", "first.h", "first.place"))
    scratch.drop("classes")
    some = spark.sparkContext.broadcast(seen_bits(asked, _places, bits))
    found = docs.mapInArrow(_contexts(window, gram, some, bits), CONTEXT)
    contexts = scratch.put("contexts", found.join(asked, ["doc_id", "h", "place"], "left_semi").dropDuplicates(["doc_id", "h", "place"]))
    some.unpersist()
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.xxhash64("key", "left").alias("sub"), (F.col("before") >= half).alias("far")),
        F.struct(F.lit(2).alias("side"), F.xxhash64("key", "right", F.lit(2)).alias("sub"), (F.col("after") >= half).alias("far")))
    halves = contexts.withColumn("s", F.explode(sides)).filter("s.far").select(
        "s.side", "s.sub", "doc_id", "h", "place", "before", "after", "bytes")
    sizes = halves.groupBy("sub").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    shared = scratch.put("shared", halves.join(sizes, "sub"))
    scratch.drop("contexts", "asked")
    small = shared.filter(F.col("kinds") <= split)
    tasks = max(1, -(-small.count() // together))
    parts = small.withColumn("task", F.pmod(F.xxhash64("sub", F.lit(7)), F.lit(tasks)).cast("int")).groupBy("task").applyInArrow(
        _refined(window, gram), "doc_id long, h long, a int, b int")
    part = scratch.put("part", _ranges(parts.unionByName(_as_rows(shared.filter(F.col("kinds") > split), window, gram))))
    scratch.drop("shared")
    return whole.unionByName(part).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _as_rows(hot: DataFrame, window: int, gram: int) -> DataFrame:
    """Covered ranges of the classes of large buckets: their windows as rows, grouped by their bytes."""
    reach = window - gram
    half = reach // 2
    start = F.when(F.col("side") == 1, F.sequence(F.lit(0), F.lit(reach - half))).otherwise(F.sequence(F.lit(reach - half + 1), F.lit(reach)) if half else F.array().cast("array<int>"))
    rows = hot.withColumn("c", F.explode(start)).filter((reach - F.col("c") <= F.col("before")) & (F.col("c") <= F.col("after")))
    rows = rows.select("doc_id", "h", (F.col("place") - reach + F.col("c")).cast("int").alias("a"),
                       F.substring("bytes", F.col("before") - reach + F.col("c") + 1, F.lit(window)).alias("w"))
    where = F.struct("doc_id", "h", "a")
    first = rows.groupBy("w").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w", "first")
    return rows.join(first, "w").filter(where > F.col("first")).select("doc_id", "h", "a", (F.col("a") + window).alias("b"))


# --- the operator --------------------------------------------------------------------------


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for doc, text, ranges in zip(batch.column("doc_id"), batch.column("text"), batch.column("ranges"), strict=True):
            data = np.frombuffer(text.as_py() or b"", np.uint8)
            gone = covered_mask(len(data), ranges_of(ranges))
            out["doc_id"].append(doc.as_py())
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept"].append(data[~gone].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = SKETCH_BITS, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) per row of docs."""
    texts = masked(docs).select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("text"))
    ranges = repeated_bytes(texts, length, gram, bits, **how)
    return unmasked(texts.join(ranges, ["doc_id", "h"], "left").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by definition, for small inputs with unique ids."""
    first: dict[bytes, tuple[int, int]] = {}
    for doc, text in sorted(rows):
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], (doc, i))
    out = {}
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] != (doc, i):
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[doc] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
