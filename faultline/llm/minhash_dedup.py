"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Signatures: the shingle universe has 2^32 places. One permutation (sigma) scatters the
shingles over it; a second one (pi), shifted circularly by k = 0, 1, 2, ..., gives
coordinate k as the least pi(sigma(x) - k). Two permutations thus serve all coordinates.

Links: texts with equal shingle sets collapse to one representative first, so groups of
exact copies never meet in a bucket. Each bucket of a band then elects a pivot, members are
compared with it on their full sets, and links give components. What is left are buckets
that hold several components. In small ones (up to ``SMALL`` members) the pairs across
components are compared one by one; larger ones are dealt into blocks of bounded size, and
each pair of blocks is compared in one task, which returns only links that join components.
A pair is looked at in its first common band only. No pair inside a component is ever
built, and no candidate pair across components is missed. With 18 bands of 4 coordinates a
pair at similarity 0.85 escapes banding with probability 2e-6.

Null and empty texts have an empty set and are linked with nothing. Rows that repeat a
doc_id each give a row and may be in different groups; a component is named by the smallest
doc_id in it. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, blocks, mixed, word_hashes, word_spans
from .components import connected_components
from .scratch import Scratch
from .text_sql import masked, only, text_hash, unmasked

BANDS, ROWS = 18, 4
#: Estimates this far below the threshold (over five standard deviations) are not verified.
SLACK = 0.22
#: Members of a bucket whose pairs are compared one by one; and what a block of a larger bucket holds at most (on average).
SMALL, BLOCK_MEMBERS, BLOCK_SHINGLES = 48, 1024, 400_000


def _pi(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers; changes x."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        if factor is not None:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, end to end; and where each document's begin."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    w = word_hashes(low, starts, ends)
    n = np.diff(first)
    sets, sizes = [], np.zeros(len(n), np.int64)
    with np.errstate(over="ignore"):
        factors = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(width)]
        full = np.zeros(max(len(w) - width + 1, 0), np.uint64)
        for k, f in enumerate(factors):
            full += w[k : k + len(full)] * f
        full = mixed(full)
        for i in range(len(n)):
            if n[i] >= width:
                s = np.unique(full[first[i] : first[i + 1] - width + 1])
            elif n[i]:
                own = w[first[i] : first[i + 1]]
                s = mixed(np.array([sum(int(x) * int(f) for x, f in zip(own, factors, strict=False)) + len(own) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                continue
            sets.append(s)
            sizes[i] = len(s)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(shingles: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents with shingles) x coordinates, of 32-bit minima."""
    with np.errstate(over="ignore"):
        place = (mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # sigma
        out = np.empty((coordinates, len(begin)), np.uint32)
        x, tmp = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.subtract(place, np.uint32(k), out=x)
            out[k] = np.minimum.reduceat(_pi(x, tmp), begin) if len(begin) else out[k]
    return np.ascontiguousarray(out.T)


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets, begin = shingle_sets(b.data, b.offsets, width)
            n = np.diff(begin)
            has = np.flatnonzero(n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig: list = [None] * len(n)
            keys: list = [None] * len(n)
            if len(has):
                at = begin[:-1][has]
                with np.errstate(over="ignore"):
                    f1[has] = np.add.reduceat(sets, at)
                    f2[has] = np.add.reduceat(mixed(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), at)
                    s = signatures(sets, at, bands * rows)
                    k = np.zeros((len(has), bands), np.uint64)
                    for r in range(rows):
                        k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + s[:, r::rows] + np.arange(bands, dtype=np.uint64) * np.uint64(1 << 33))
                for i, d in enumerate(has):
                    sig[d], keys[d] = s[i].tobytes(), k[i].view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(b.doc_id, pa.int64()), "n_shingles": pa.array(n, pa.int64()),
                "f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2.view(np.int64)),
                "sig": pa.array(sig, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())), "h": b.batch.column("h").slice(b.rows.start, len(n)),
            })

    return run


def _verified(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            ok = np.zeros(len(a), bool)
            kept: dict[int, np.ndarray] = {}
            for i in range(len(a)):
                if a[i] not in kept:  # pairs come sorted by a
                    kept = {a[i]: _one_set(ta[i].as_py(), width)}
                x, y = kept[a[i]], _one_set(tb[i].as_py(), width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(ok)), "b": batch.column("b").filter(pa.array(ok))})

    return run


def _one_set(text: bytes | None, width: int) -> np.ndarray:
    data = np.frombuffer(text or b"", np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), width)[0]


def _agreeing(coordinates: int):
    """Estimated similarity of two signatures, vectorised."""

    @F.pandas_udf("double")
    def agree(x, y):
        import pandas as pd

        p = np.frombuffer(b"".join(x), np.uint32).reshape(-1, coordinates)
        q = np.frombuffer(b"".join(y), np.uint32).reshape(-1, coordinates)
        return pd.Series((p == q).mean(axis=1))

    return agree


def grouped(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id (masked), h (text_hash), n_shingles and first (doc_id, h) of its component per row of docs; first is null for an empty set."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    binary = masked(docs).select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("text"))
    signed = scratch.put("signed", binary.mapInArrow(
        _signed(width, bands, rows), "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>, h long"))
    # A set is known by its fingerprints, not by a doc_id, which rows with other texts may repeat.
    reps = scratch.put("reps", signed.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(
        F.min(F.struct("doc_id", "h")).alias("at"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumn("rep", F.xxhash64("f1", "f2", "n_shingles")))

    rows_ = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows_.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    member = scratch.put("member", rows_.join(shared, "key"))
    met = member.select("rep").distinct()
    at = reps.join(met, "rep", "left_semi").select("rep", "at.doc_id", "at.h")
    texts = scratch.put("texts", binary.join(at, ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"]))
    facts = scratch.put("facts", reps.select("rep", "n_shingles", "sig").join(met, "rep", "left_semi"))

    links: DataFrame | None = None
    comp: DataFrame | None = None
    turn = 0

    def verify(pairs: DataFrame, more: DataFrame | None = None) -> None:
        """Adds the links among pairs (a, b), and more links, and renews the components."""
        nonlocal links, comp, turn
        turn += 1
        low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        fa = facts.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
        fb = facts.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
        near = pairs.join(fb, "b").join(fa, "a").filter(100 * low >= percent * high)
        near = near.filter(_agreeing(bands * rows)("sig_a", "sig_b") >= percent / 100 - SLACK).select("a", "b")
        near = scratch.put(f"near{turn}", near)
        full = near.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        full = full.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").sortWithinPartitions("a")
        found = full.select("a", "b", "text_a", "text_b").mapInArrow(_verified(width, percent), "a long, b long")
        for other in (links, more):
            found = found if other is None else found.unionByName(other)
        links = scratch.put(f"links{turn}", found)
        comp = connected_components(links, scratch, f"comp{turn}")

    # A pivot serves at most some BLOCK_MEMBERS members of a bucket; the pivots of its blocks meet the first of them.
    part = F.pmod(F.xxhash64("rep", F.lit(11)), F.ceil(F.col("members") / BLOCK_MEMBERS))
    dealt = member.withColumn("part", part)
    pivots = dealt.groupBy("key", "part").agg(F.min("rep").alias("pivot"))
    heads = pivots.groupBy("key").agg(F.min("pivot").alias("head"))
    pairs = dealt.join(pivots, ["key", "part"]).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    pairs = pairs.unionByName(pivots.join(heads, "key").select(F.col("head").alias("a"), F.col("pivot").alias("b")))
    verify(pairs.filter("a <> b").distinct())

    of = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    sizes = reps.select("rep", "n_shingles")
    open_ = of.join(sizes, "rep").groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.sum("n_shingles").alias("weight")).filter("lo < hi")
    now = scratch.put("open", of.drop("members").join(open_.select("key", "members", "weight"), "key"))
    small = now.filter(F.col("members") <= SMALL)
    left, right = _sided(small, reps, "a"), _sided(small, reps, "b")
    apart = (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = left.join(right, apart & fits & (F.col("key_a") == _first_common(F.col("bands_a"), F.col("bands_b")))).select("a", "b")
    verify(pairs, _large_links(now.filter(F.col("members") > SMALL), reps, texts, width, percent))

    named = reps.select("f1", "f2", "n_shingles", "rep", "at").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    first = named.groupBy("comp").agg(F.min("at").alias("first"))
    of_rep = scratch.put("named", named.join(first, "comp").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("gn"), "first"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") == F.col("gn"))
    return signed.select("doc_id", "h", "n_shingles", "f1", "f2").join(of_rep, same, "left").select("doc_id", "h", "n_shingles", "first")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept per row of docs; links are at 100 * intersection >= percent * union."""
    component = F.coalesce("first.doc_id", "doc_id")
    out = grouped(docs, width, percent, **how).select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return unmasked(out, "doc_id", "component_id")


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            sets, begin = shingle_sets(b.data, b.offsets, width)
            yield pa.RecordBatch.from_arrays([pa.array(b.doc_id, pa.int64()), pa.array([sets[begin[i] : begin[i + 1]].tobytes() for i in range(len(b.doc_id))], pa.binary())], names=["rep", "shingles"])

    return run


def _block_links(percent: int):
    """Links between the components of two blocks of a bucket: enough to join what is linked, not all of them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, i, j = (k.as_py() for k in key)
        rep, comp, n, block = (table.column(c).to_numpy() for c in ("rep", "comp", "n_shingles", "block"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        ra, rb = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out_a, out_b = [], []
        if len(ra) and len(rb):
            size_a, size_b = n[ra][:, None], n[rb][None, :]
            open_ = (comp[ra][:, None] != comp[rb][None, :]) & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))
            if i == j:
                open_ &= rep[ra][:, None] < rep[rb][None, :]
            for k in range(bands.shape[1]):
                if bands[ra[0], k] == bucket:
                    break
                open_ &= bands[ra, k][:, None] != bands[rb, k][None, :]
            if open_.any():
                both = _intersections([sets[x] for x in ra], [sets[x] for x in rb])
                linked = open_ & (100 * both >= percent * (size_a + size_b - both))
                label = {c: c for c in comp.tolist()}

                def root(c: int) -> int:
                    while label[c] != c:
                        label[c] = c = label[label[c]]
                    return c

                for x, y in zip(*np.nonzero(linked), strict=True):
                    p, q = root(int(comp[ra[x]])), root(int(comp[rb[y]]))
                    if p != q:
                        label[max(p, q)] = min(p, q)
                        out_a.append(int(rep[ra[x]]))
                        out_b.append(int(rep[rb[y]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over some of the shingles at a time."""
    def coded(sets: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = np.searchsorted(vocabulary, flat)
        ok = at < len(vocabulary)
        ok[ok] = vocabulary[at[ok]] == flat[ok]
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    vocabulary = np.intersect1d(np.concatenate(a), np.concatenate(b))
    (row_a, at_a), (row_b, at_b) = coded(a, vocabulary), coded(b, vocabulary)
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(vocabulary), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, row, at in ((x, row_a, at_a), (y, row_b, at_b)):
            lo, hi = np.searchsorted(at, [k, k + width])
            m[row[lo:hi], at[lo:hi] - k] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _large_links(now: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) across the components of large buckets, block against block."""
    wanted = texts.join(now.select("rep").distinct(), "rep", "left_semi").withColumnRenamed("rep", "doc_id")
    sets = wanted.mapInArrow(_with_sets(width), "rep long, shingles binary")
    blocks_ = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = now.select("rep", "key", "comp", blocks_.alias("n_blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    paired = paired.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    full = paired.join(reps.select("rep", "n_shingles", "bands"), "rep").join(sets, "rep")
    return full.select("key", "i", "j", "rep", "comp", "n_shingles", "block", "bands", "shingles").groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a long, b long")


def _sided(now: DataFrame, reps: DataFrame, side: str) -> DataFrame:
    facts = reps.select("rep", "n_shingles", "bands")
    out = now.select("rep", "key", "comp").join(facts, "rep")
    return out.select(F.col("rep").alias(side), *(F.col(x).alias(f"{y}_{side}") for x, y in
                      (("key", "key"), ("comp", "comp"), ("n_shingles", "n"), ("bands", "bands"))))


def _first_common(x: Column, y: Column) -> Column:
    return F.get(F.filter(F.zip_with(x, y, lambda p, q: F.when(p == q, p)), lambda k: k.isNotNull()), F.lit(0))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest doc_id (and text hash), and all without shingles."""
    own = F.struct("doc_id", "h")
    stay = grouped(docs, **how).filter(F.col("first").isNull() | (own == F.col("first")))
    return only(docs, stay.select("doc_id", "h", F.col("first").isNull().alias("many")))
