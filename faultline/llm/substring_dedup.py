"""Removal of repeated word windows behind a count-min prefilter (see ``sketch.py`` and ``repeats.py``).

Words are runs of non-spaces, unchanged. Pass one sketches, in every partition, the grams
that stand for the windows (a window's count is at most its gram's); the merged sketches
overestimate, so a window they call unique is unique. Pass two groups exactly only what is
left. Every word in a window of ``length`` words that also starts in a document with a
smaller doc_id goes; windows are judged on the input.

Null has no words; texts with fewer than ``length`` words stay whole. Rows that repeat a
doc_id keep each other's words (neither has the smaller one); each loses its own repeats of
smaller doc_ids. Extra columns are ignored. An empty table gives an empty result. Words that stay are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, word_hashes, word_spans
from .repeats import covered_mask, ranges_of, repeated_ranges
from .text_sql import masked, text_hash, unmasked

LENGTH, GRAM = 50, 25
SKETCH_BITS = 26


def read_words(b: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(b.data, b.offsets)
    return word_hashes(b.data, starts, ends), first


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        for doc, text, ranges in zip(batch.column("doc_id"), batch.column("text"), batch.column("ranges"), strict=True):
            own = (text.as_py() or b"").split()
            gone = covered_mask(len(own), ranges_of(ranges))
            out["doc_id"].append(doc.as_py())
            out["n_words"].append(len(own))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(own if not gone.any() else [own[i] for i in np.flatnonzero(~gone)]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8 of the words that stay) per row of docs."""
    texts = masked(docs).select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("text"))
    ranges = repeated_ranges(texts, read_words, length, gram, bits, "substring")
    return unmasked(texts.join(ranges, ["doc_id", "h"], "left").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept binary"))


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, str]]:
    """The same by definition, for small inputs."""
    first: dict[tuple, int] = {}
    words = {doc: text.split() for doc, text in rows}
    for doc in sorted(words):
        for i in range(len(words[doc]) - length + 1):
            first.setdefault(tuple(words[doc][i : i + length]), doc)
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
