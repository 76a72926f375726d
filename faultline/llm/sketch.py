"""Count-min sketch of 64-bit keys with counters that stop at two, merged as a tree.

Each of the ``ROWS`` rows has 2^bits cells; a cell is two bits ("seen", "seen again"), so
merging is bitwise. A key's estimate, the least of its cells, is never below its true
count (up to two): what the sketch calls unique is unique. The sketch has a fixed size,
whatever the input: 2^bits * ROWS / 8 bytes go to the executors. A fuller sketch lets more
unique keys through to the exact pass, which stays right and linear in the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mixed

ROWS = 2
#: Bits of a slice of a row that is merged on its own.
SLICE_BITS = 20
FAN_IN = 16
FORMAT = "slice int, part int, seen binary, again binary"


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x94D049BB133111EB * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


def _set_bits(target: np.ndarray, where: np.ndarray) -> None:
    """Sets the bits at where, which ascends without repeats."""
    if len(where):
        byte = where >> 3
        first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        target[byte[first]] |= np.bitwise_or.reduceat((1 << (where & 7)).astype(np.uint8), first)


def _partial(key_blocks: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
        again = np.zeros_like(seen)
        for keys in key_blocks(batches):
            for row in range(ROWS):
                c = np.sort(cells(keys, row, bits))
                if not len(c):
                    continue
                new = np.concatenate([[True], c[1:] != c[:-1]])
                one, more = c[new], np.unique(c[~new])
                known = one[(seen[row][one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1]
                _set_bits(again[row], more)
                _set_bits(again[row], known)
                _set_bits(seen[row], one)
        step = 1 << (SLICE_BITS - 3)
        per_row = max(1, seen.shape[1] // step)
        for row in range(ROWS):
            for k in range(per_row):
                s = seen[row, k * step : (k + 1) * step]
                if s.any():
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([row * per_row + k], pa.int32()), "part": pa.array([part], pa.int32()),
                        "seen": pa.array([zlib.compress(s.tobytes(), 1)]),
                        "again": pa.array([zlib.compress(again[row, k * step : (k + 1) * step].tobytes(), 1)]),
                    })

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    seen = again = None
    for s, a in zip(table.column("seen"), table.column("again"), strict=True):
        s, a = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (s, a))
        if seen is None:
            seen, again = s.copy(), a.copy()
        else:
            again |= a | (seen & s)
            seen |= s
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "seen": [zlib.compress(seen.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]})


def repeated_bits(texts: DataFrame, key_blocks: Callable, bits: int) -> np.ndarray:
    """ROWS x 2^bits / 8 bytes: bit set where a cell was hit twice or more. Its size is fixed by bits."""
    return _merged_bits(texts, key_blocks, bits, "again")


def seen_bits(rows: DataFrame, key_blocks: Callable, bits: int) -> np.ndarray:
    """The same, set where a cell was hit at all: which keys may be among those of rows."""
    return _merged_bits(rows, key_blocks, bits, "seen")


def _merged_bits(texts: DataFrame, key_blocks: Callable, bits: int, which: str) -> np.ndarray:
    parts = max(texts.rdd.getNumPartitions(), 1)
    merged = texts.mapInArrow(_partial(key_blocks, bits), FORMAT)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = merged.withColumn("part", F.expr(f"cast(floor(part / {FAN_IN}) as int)")).groupBy("slice", "part").applyInArrow(_merged, FORMAT)
    out = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    step = min(1 << (SLICE_BITS - 3), out.shape[1])
    flat = out.reshape(-1)
    for r in merged.select("slice", which).toLocalIterator():
        flat[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r[which]), np.uint8)
    return out


def maybe_repeated(keys: np.ndarray, again: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for row in range(ROWS):
        c = cells(keys, row, bits)
        ok &= (again[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok
