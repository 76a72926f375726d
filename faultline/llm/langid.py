"""Language identification in two steps: the family first, then pairs of languages within it.

Texts are described by hashed byte trigrams (ASCII lower case), as shares of all trigrams.
Languages whose mean descriptions lie close are joined into families (average linkage, cut
where the distance between merges jumps most). One linear support vector machine for each
family tells it from the others; one for each pair of languages of a family votes inside it.
The machines are fitted on the driver from at most ``per_language`` labelled texts of each
language; that sample is drawn by a hash of doc_id. Every
text is then judged whole, in the executors, as a sum of weights over its trigrams.

Null text and text without a letter are ``und`` with score 0, as is everything when no row
is labelled. A null lang is never learned. lang, source and doc_id are not looked at in a
prediction. Rows that repeat a doc_id each give a row. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LOWER, Block, blocks
from .text_sql import NO_ID, free_name, masked, unit_hash, unmasked

BITS = 12
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigrams(data: np.ndarray) -> np.ndarray:
    low = LOWER[data].astype(np.uint32)
    with np.errstate(over="ignore"):
        key = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(32 - BITS)).astype(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        out = []
        for i in range(len(b.doc_id)):
            own = b.data[b.offsets[i] : b.offsets[i + 1]]
            count = np.bincount(trigrams(own), minlength=1 << BITS) if len(own) > 2 else np.zeros(1 << BITS)
            out.append((count / max(1, count.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.batch.column("lang").slice(b.rows.start, len(out)), pa.array(out)], names=["lang", "features"])


def hinge(x: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-4) -> np.ndarray:
    """Weights, and the constant last, of a linear support vector machine (subgradient steps, averaged); y is -1 or 1."""
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        out = y * (x @ w) < 1
        w = (w * (1 - 1 / (t + 1)) + ((weight * y * out) @ x) / (penalty * (t + 1))).astype(np.float32)
        size = np.linalg.norm(w)
        w *= np.float32(min(1, 1 / np.sqrt(penalty) / max(size, 1e-12)))
        mean += w * t
    return mean / (rounds * (rounds + 1) / 2)


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages by average linkage of their mean descriptions."""
    groups = [[i] for i in range(len(means))]
    root = np.sqrt(means)
    apart = 1 - root @ root.T / np.maximum(np.outer(np.linalg.norm(root, axis=1), np.linalg.norm(root, axis=1)), 1e-12)
    states, heights = [list(groups)], [0.0]
    while len(groups) > 1:
        height, i, j = min((np.mean([apart[a, b] for a in groups[i] for b in groups[j]]), i, j) for i, j in combinations(range(len(groups)), 2))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        states.append(list(groups))
        heights.append(height)
    if len(means) < 3:
        return states[-1]
    # Cut before the merge that is most farther than the one before it, with at least one merge done.
    jumps = [heights[k + 1] - heights[k] for k in range(1, len(heights) - 1)]
    return [sorted(g) for g in states[1 + int(np.argmax(jumps))]]


class Model:
    """languages, families and the weights: a column for each family, then one for each pair within a family."""

    def __init__(self, lang: list[str], x: np.ndarray):
        self.languages = sorted(set(lang))
        of = np.array([self.languages.index(v) for v in lang])
        x = x.astype(np.float32)
        scale = 1 / max(np.sqrt((x**2).sum(axis=1).mean()), 1e-12)
        x = np.concatenate([x * scale, np.ones((len(x), 1), np.float32)], axis=1)
        self.families = families(np.stack([x[of == k, :-1].mean(axis=0) for k in range(len(self.languages))]))
        family = np.zeros(len(self.languages), int)
        for k, members in enumerate(self.families):
            family[members] = k
        fit = []
        if len(self.families) > 1:
            fit += [hinge(x, np.where(family[of] == k, 1.0, -1.0)) for k in range(len(self.families))]
        self.pairs = [(a, b) for g in self.families for a, b in combinations(g, 2)]
        for a, b in self.pairs:
            own = (of == a) | (of == b)
            fit.append(hinge(x[own], np.where(of[own] == a, 1.0, -1.0)))
        fit = np.array(fit).reshape(-1, x.shape[1])
        self.weights, self.constant = np.ascontiguousarray(fit[:, :-1] * scale), fit[:, -1]

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins (rows x machines)."""
        n = len(margin)
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        several = len(self.families) > 1
        family = margin[:, : len(self.families)].argmax(axis=1) if several else np.zeros(n, int)
        score = sure[np.arange(n), family] if several else np.ones(n)
        votes, doubt = np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)))
        for k, members in enumerate(self.families):
            votes[np.ix_(family == k, members)] += 0.5
        for m, (a, b) in enumerate(self.pairs, len(self.families) if several else 0):
            p = sure[:, m]
            votes[:, a] += p > 0.5
            votes[:, b] += p <= 0.5
            votes[:, a] += p * 1e-3  # ties between winners of as many pairs
            votes[:, b] += (1 - p) * 1e-3
            doubt[:, a] = np.minimum(doubt[:, a], p)
            doubt[:, b] = np.minimum(doubt[:, b], 1 - p)
        for k, members in enumerate(self.families):
            others = [i for i in range(len(self.languages)) if i not in members]
            votes[np.ix_(family == k, others)] = -1
        best = votes.argmax(axis=1)
        return best, score * doubt[np.arange(n), best]


def fit(docs: DataFrame, per_language: int = 250) -> Model | None:
    """The model from labelled rows of docs (doc_id, text, lang); None where there are none."""
    spark = docs.sparkSession
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    if labelled.isEmpty():
        return None
    order = Window.partitionBy("lang").orderBy(unit_hash(F.col("doc_id"), seed=9), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language)
    chosen = [(r["doc_id"],) for r in ids.select("doc_id").distinct().collect()]  # at most per_language of each language
    sample = labelled.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    rows = sample.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(_described, "lang string, features binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["features"])))
    return Model([r["lang"] for r in rows], np.stack([np.frombuffer(r["features"], np.float32) for r in rows]).astype(float))


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def judged(model: Model | None, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a block."""
    n = len(b.doc_id)
    size = np.diff(b.offsets)
    lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
    letters = np.concatenate([[0], np.cumsum(_LETTER[b.data])])
    known = letters[b.offsets[1:]] > letters[b.offsets[:-1]]
    for i in np.flatnonzero(~known & (size > 1)):
        known[i] = _has_letter(b.data[b.offsets[i] : b.offsets[i + 1]].tobytes())
    if model is not None and known.any():
        margin = np.tile(model.constant, (n, 1))
        long = np.flatnonzero(size > 2)
        if len(long):
            gram = trigrams(b.data)
            # From the first trigram of a document to its last, and from there to the next document's first.
            cut = np.stack([b.offsets[long], b.offsets[long + 1] - 2], axis=1).reshape(-1)
            cut = cut[:-1] if cut[-1] >= len(gram) else cut
            for m, w in enumerate(model.weights):
                margin[long, m] += np.add.reduceat(w[gram], cut)[::2] / (size[long] - 2)
        best, sure = model.decide(margin)
        lang[known] = np.array(model.languages, object)[best[known]]
        score[known] = sure[known]
    return lang, score


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            lang, score = judged(shared.value, b)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(b.doc_id, pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return run


def _known(shared, min_score: float, key: str, text: str):
    """Whole rows whose text (bytes in a column of its own) has a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(key), batch.column(text)], names=["doc_id", "text"])
            keep = [np.zeros(0, bool)]
            for b in blocks([own]):
                lang, score = judged(shared.value, b)
                keep.append((lang != UNKNOWN) & (score >= min_score))
            yield batch.select([c for c in batch.schema.names if c not in (key, text)]).filter(pa.array(np.concatenate(keep)))

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = masked(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_predicted(shared), "doc_id long, lang_pred string, score double")


def fold(doc_id, of: int):
    """crc32 of the doc_id as text, modulo of."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def identify(docs: DataFrame, held_out_fold: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of docs that are not held out."""
    docs = masked(docs)
    model = fit(docs.filter(fold(F.col("doc_id"), of) != held_out_fold))
    out = predict(docs, model)
    return unmasked(out.select("doc_id", (fold(F.col("doc_id"), of) == held_out_fold).alias("held_out"), "lang_pred", "score"))


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of docs with a language: not ``und`` and scored at least min_score. Rows are judged where they lie."""
    own = masked(docs)
    model = fit(own.filter(fold(F.col("doc_id"), 4) != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key, text = free_name(docs, "_judged_id"), free_name(docs, "_judged_text")
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(text, F.col("text").cast("binary"))
    return rows.mapInArrow(_known(shared, min_score, key, text), docs.schema)
