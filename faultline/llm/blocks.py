"""Vectorised views of Arrow batches of texts: blocks of whole documents as one byte array.

A block holds whole documents of about ``BLOCK_BYTES`` together, or one longer document, so
memory per task follows the longest single text and not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: The six ASCII space characters.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """bytes of documents laid end to end; document i is data[offsets[i]:offsets[i + 1]]."""

    doc_id: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    rows: slice
    batch: pa.RecordBatch


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of the columns doc_id (long) and text (binary; null counts as empty)."""
    for batch in batches:
        text = batch.column("text")
        if text.null_count:
            text = text.fill_null(b"")
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            own = offsets[first : last + 1]
            yield Block(doc_id[first:last], data[own[0] : own[-1]], own - own[0], slice(first, last), batch)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; changes x."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class Spans:
    """Fingerprints of any span of a sequence of 64-bit numbers in constant time: prefix sums of a polynomial modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, lane: int = 0):
        base = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane]
        self.up, self.down = self._power(base, len(values) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * self.up[: len(values)], out=self.prefix[1:])

    @classmethod
    def _power(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, BLOCK_BYTES * 5 // 4)
            with np.errstate(over="ignore"):
                have = tuple(
                    np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                    for b in (base, pow(base, -1, 1 << 64))
                )
            if n <= BLOCK_BYTES * 5 // 4:
                cls._powers[base] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self.prefix[end] - self.prefix[start]
            out *= self.down[start]
            out += (end - start).astype(np.uint64)
        return mixed(out)


_BYTES = [np.random.default_rng(lane + 1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for lane in (0, 1)]


def byte_values(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return _BYTES[lane][data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each document's words begin among them (one more at the end)."""
    n = len(data)
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    if n:
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        start[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return Spans(byte_values(data, lane), lane).of(starts, ends)
