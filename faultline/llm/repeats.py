"""Repeated windows of fixed length, found from anchors. The byte remover takes its anchors from here, the word remover all of it.

A sequence is the bytes or the words of one document. Its windows of ``window`` units are
judged; its q-grams ("grams", ``gram`` units) are the initial buckets. Each window picks
the gram with the least fingerprint as its anchor, leftmost on ties, so equal windows pick
the same gram at the same place and an anchor is a place both share.

The identifier of 2k units at a place is made from the identifiers of k units there and k
units further on, over and over, each level reusing the one before. Identifiers are
fingerprints, read where the text is.

  1. a sketch of all anchor grams tells which grams are surely unique (``sketch.py``);
  2. the anchors left are sorted into classes by their gram and by the units around it
     that any window over the anchor can touch; all but the earliest of a class are
     covered as far as that context reaches, with no comparison of pairs;
  3. only where classes share the gram and half the context on one side, the earliest member
     of each spells out the windows that have it as their anchor; a second sketch drops
     those that are surely unique, and the others are grouped exactly (128 bits: two
     independent lanes);
  4. covered ranges are joined to their document and merged.

Work and rows stay linear in the anchors: a passage in thousands of documents gives one
class with thousands of members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Spans, blocks, mixed
from .scratch import Scratch
from .sketch import maybe_repeated, repeated_bits

#: Low bits of a fingerprint that give way to the place, so that the leftmost of equals is least.
PLACE_BITS = 28


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = a * np.uint64(0x9E3779B97F4A7C15)
        out += b
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


class Names:
    """Identifiers of the units from each place on, for lengths that are powers of two, and from them for any length."""

    def __init__(self, units: np.ndarray, longest: int):
        self.levels = [units]
        k = 1
        while 2 * k <= longest:
            last = self.levels[-1]
            if len(last) <= k:
                break
            self.levels.append(_joined(last[:-k], last[k:]))
            k *= 2

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        """All of one length, which is at least 1."""
        level = length.bit_length() - 1
        names = self.levels[level]
        return _joined(names[start], names[start + length - (1 << level)])

    def spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for n in np.unique(length):
            if n:
                own = length == n
                with np.errstate(over="ignore"):
                    out[own] = self.of(start[own], int(n)) + np.uint64(n)
        return out


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by doubling."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(units: np.ndarray, first: np.ndarray, window: int, gram: int, stretch: int = 1 << (PLACE_BITS - 1)) -> tuple[np.ndarray, np.ndarray, Names]:
    """Start of every window, the place of its anchor, and the identifiers of the block. Windows lie within documents."""
    names = Names(units, window)
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return none, none, names
    order = mixed(names.of(np.arange(len(units) - gram + 1), gram))
    order >>= np.uint64(PLACE_BITS)
    order <<= np.uint64(PLACE_BITS)
    width, parts = window - gram + 1, []
    # Places are counted from the begin of a stretch, so they never need more than their bits.
    for s in range(0, len(order) - width + 1, stretch):
        own = order[s : s + stretch + width - 1]
        own = own | np.arange(len(own), dtype=np.uint64)
        parts.append((window_minima(own, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + s)
    least = np.concatenate(parts)
    mark = np.zeros(len(units) + 1, np.int32)
    own = np.diff(first) >= window
    np.add.at(mark, first[:-1][own], 1)
    np.add.at(mark, first[1:][own] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(mark)[: len(least)] > 0)
    return start, least[start], names


def anchors(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Names]:
    """Places of the anchors, their gram identifiers, their document, and the identifiers of the block."""
    _, place, names = minimisers(units, first, window, gram)
    if len(place):
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    key = names.of(place, gram) if len(place) else place.astype(np.uint64)
    return place, key, np.searchsorted(first, place, "right") - 1, names


Reader = Callable[[object], tuple[np.ndarray, np.ndarray]]


def _keys(read: Reader, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in blocks(batches):
            units, first = read(b)
            yield anchors(units, first, window, gram)[1]

    return run


CANDIDATE = "c1 long, c2 long, left long, right long, doc_id long, h long, place int, more array<int>, before short, after short"


def _candidates(read: Reader, window: int, gram: int, again, bits: int):
    """Anchors that may repeat: identifiers of the gram with all units around it, and with half of them on either side.

    Repeats within a document don't count, so its equal anchors are one row with further places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - gram
        half = reach // 2
        for b in blocks(batches):
            units, first = read(b)
            place, key, doc, names = anchors(units, first, window, gram)
            ok = maybe_repeated(key, again.value, bits)
            place, key, doc = place[ok], key[ok], doc[ok]
            if not len(place):
                continue
            before = np.minimum(place - first[doc], reach)
            after = np.minimum(first[doc + 1] - place - gram, reach)
            around = _joined(names.spans(place - before, before), names.spans(place + gram, after) + before.astype(np.uint64))
            c1 = _joined(key, around)
            spans = Spans(units, 1)
            c2 = _joined(spans.of(place - before, place), spans.of(place, place + gram + after))
            near, far = np.minimum(before, half), np.minimum(after, half)
            left = _joined(key, names.spans(place - near, near))
            right = _joined(names.spans(place + gram, far), key)
            place -= first[doc]
            order = np.lexsort((place, c2, c1, doc))
            head = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)])
            begin = np.append(np.flatnonzero(head), len(order))
            own = order[begin[:-1]]
            # Places of a row from its second on; the lists lie end to end.
            rest = np.delete(place[order], begin[:-1]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.diff(begin) - 1)]).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(ends), pa.array(rest))
            c1, c2, left, right, doc, place, before, after = (x[own] for x in (c1, c2, left, right, doc, place, before, after))
            h = b.batch.column("h").to_numpy(zero_copy_only=False)[b.rows]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (c1, c2, left, right)), pa.array(b.doc_id[doc], pa.int64()), pa.array(h[doc], pa.int64()),
                 pa.array(place, pa.int32()), more, pa.array(before, pa.int16()), pa.array(after, pa.int16())],
                names=[x.split()[0] for x in CANDIDATE.split(", ")],
            )

    return run


WINDOW = "w1 long, w2 long, doc_id long, h long, place int"


def _asked_windows(read: Reader, window: int, gram: int, batches: Iterator[pa.RecordBatch]):
    """Per block the windows whose anchor is listed with the document: those with half the context or more on a listed side."""
    half = (window - gram) // 2
    for b in blocks(batches):
        units, first = read(b)
        start, place, names = minimisers(units, first, window, gram)
        if not len(start):
            continue
        sides = np.zeros(len(units) + 1, np.uint8)
        for i in range(len(b.doc_id)):
            cell = b.batch.column("asked")[b.rows.start + i].values
            np.bitwise_or.at(sides, cell.field("place").to_numpy() + first[i], cell.field("side").to_numpy().astype(np.uint8))
        left = place - start
        wanted = ((sides[place] & 1) > 0) & (left >= half) | ((sides[place] & 2) > 0) & (window - gram - left >= half)
        start = start[wanted]
        if len(start):
            yield b, units, first, start, names.of(start, window)


def _window_keys(read: Reader, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, _, _, w1 in _asked_windows(read, window, gram, batches):
            yield w1

    return run


def _windows(read: Reader, window: int, gram: int, again, bits: int):
    """The asked windows that may repeat, with two identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, units, first, start, w1 in _asked_windows(read, window, gram, batches):
            ok = maybe_repeated(w1, again.value, bits)
            start, w1 = start[ok], w1[ok]
            owner = np.searchsorted(first, start, "right") - 1
            w2 = Spans(units, 1).of(start, start + window)
            h = b.batch.column("h").to_numpy(zero_copy_only=False)[b.rows]
            for k in range(0, len(start), 1 << 18):
                own = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1[own].view(np.int64)), pa.array(w2[own].view(np.int64)), pa.array(b.doc_id[owner[own]], pa.int64()), pa.array(h[owner[own]], pa.int64()), pa.array((start - first[owner])[own], pa.int32())],
                    names=[x.split()[0] for x in WINDOW.split(", ")],
                )

    return run


def _ranges(rows: DataFrame) -> DataFrame:
    pair = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    return rows.groupBy("doc_id", "h").agg(F.collect_set(pair).alias("ranges"))


def repeated_ranges(docs: DataFrame, read: Reader, window: int, gram: int, bits: int, operator: str) -> DataFrame:
    """doc_id, h, ranges (array of struct<a, b>: units a to b - 1) that equal a window of a smaller doc_id; not merged.

    docs has doc_id (long), h (long, tells rows of one doc_id apart) and text (binary).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, operator)
    again = spark.sparkContext.broadcast(repeated_bits(docs, _keys(read, window, gram), bits))
    cand = scratch.put("candidates", docs.mapInArrow(_candidates(read, window, gram, again, bits), CANDIDATE))
    all_places = lambda p, m: F.concat(F.array(p), F.coalesce(m, F.array().cast("array<int>")))
    classes = scratch.put("classes", cand.groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "h", "place", "more")).alias("first"), F.max("doc_id").alias("last_doc"), *(F.first(c).alias(c) for c in ("left", "right", "before", "after"))))

    later = F.col("doc_id") > F.col("first.doc_id")
    several = classes.filter("last_doc > first.doc_id")
    reach = window - gram
    wide = F.col("before") + F.col("after") >= reach
    covered = cand.join(several.select("c1", "c2", "first"), ["c1", "c2"]).filter(later & wide).withColumn("place", F.explode(all_places(F.col("place"), F.col("more"))))
    covered = covered.select("doc_id", "h", (F.col("place") - F.col("before")).alias("a"), (F.col("place") + gram + F.col("after")).alias("b"))
    whole = scratch.put("whole", _ranges(covered))
    scratch.drop("candidates")

    # A window reaches half the context or more on one side, so only classes that share a half can share a window.
    halves = classes.filter(wide).select("first", F.explode(F.array(
        F.struct(F.lit(1).cast("byte").alias("side"), F.col("left").alias("half")), F.struct(F.lit(2).cast("byte").alias("side"), F.col("right").alias("half")))).alias("s"))
    halves = halves.select("first.doc_id", "first.h", all_places(F.col("first.place"), F.col("first.more")).alias("places"), "s.side", "s.half")
    shared = halves.groupBy("side", "half").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("side", "half")
    asked = scratch.put("asked", halves.join(shared, ["side", "half"]).select("doc_id", "h", "side", F.explode("places").alias("place"))
                         .groupBy("doc_id", "h").agg(F.collect_list(F.struct("place", "side")).alias("asked")))
    scratch.drop("classes")
    texts = scratch.put("texts", docs.join(asked, ["doc_id", "h"]))
    scratch.drop("asked")
    often = spark.sparkContext.broadcast(repeated_bits(texts, _window_keys(read, window, gram), bits))
    spelled = texts.mapInArrow(_windows(read, window, gram, often, bits), WINDOW)
    earliest = spelled.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "h", "place")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    found = spelled.join(earliest.select("w1", "w2", "first"), ["w1", "w2"]).filter(later).select(
        "doc_id", "h", F.col("place").alias("a"), (F.col("place") + window).alias("b"))
    part = scratch.put("part", _ranges(found))
    scratch.drop("texts")
    return whole.unionByName(part).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def covered_mask(n: int, ranges: np.ndarray) -> np.ndarray:
    """Which of n units lie in a range; ranges is (count, 2)."""
    mark = np.zeros(n + 1, np.int64)
    ranges = np.minimum(ranges, n)
    np.add.at(mark, ranges[:, 0], 1)
    np.add.at(mark, ranges[:, 1], -1)
    return np.cumsum(mark)[:n] > 0


def ranges_of(cell) -> np.ndarray:
    """An Arrow list of struct<a, b> as a (count, 2) array."""
    if cell is None or not cell.is_valid:
        return np.zeros((0, 2), np.int64)
    own = cell.values
    return np.stack([own.field("a").to_numpy(), own.field("b").to_numpy()], axis=1).astype(np.int64)
