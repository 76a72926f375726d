"""Best-fit packing in bulk-synchronous rounds: token sequences of at most ``capacity`` ids.

A document longer than a sequence is cut into full pieces, the first one taking the rest,
so only its first piece needs a partner. Sequences are opened by the total that waits; what
is left of one is its gap. A round sorts the waiting pieces and the gaps by size and sweeps
them together: largest first, each piece takes its successor, the least gap that holds it
and that no larger piece took. Conflicts for a gap are settled by rank. Matched gaps shrink,
and the round repeats with what waits; when a round places next to nothing, sequences are
opened for the rest. A last rest of items under an eighth of a sequence (at most 3 % of all
ids) is laid end to end.

The sweep is distributed. Pieces count as opening and gaps as closing brackets in the order
of sizes, and a piece's gap is the bracket that closes it. A row's depth follows from its
rank within its size and from prefix sums over sizes (at most ``capacity`` of them, in
shards, whatever the input), and brackets of one depth are matched by a window over the
depth. So every round shuffles only (id, size) rows, by many keys, and no list of sizes
reaches the driver, which counts what waits.

A gap takes one piece a round. So that short documents don't need many rounds, pieces
shorter than a sixteenth of a sequence are first laid end to end to bundles of about that
length, which are packed like pieces.

Null text counts as empty (one end id). Rows that repeat a doc_id are packed each. Extra
columns are ignored. An empty table gives an empty result. Reruns over the same partitions
agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_sql import masked, unmasked
from .tokens import Encoder

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
#: Shards of a size whose rows are ranked apart from each other.
RANK_SHARDS = 16
#: A round that places less than this share of the waiting ids opens sequences for them.
LEAST_SHARE = 0.02
#: A rest of this share, in small items, is no longer matched.
LAST_SHARE = 0.03

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _pieces(file: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        end = end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            out: list = []
            held = 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or b"") + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity)
                    part = ids[4 * start : 4 * stop]
                    out.append((doc.as_py(), piece, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start, piece = stop, piece + 1
                    held += len(part) * with_ids
                if held > 1 << 24:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)

    return run


def pieces(docs: DataFrame, file: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    texts = masked(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_pieces(file, capacity, end_id, with_ids), PIECE)


def matched(waiting: DataFrame, gaps: DataFrame) -> DataFrame:
    """kind (0: piece, 1: gap), id, size, and for pieces that find one the gap: other (its id), other_size; for gaps that are taken the piece.

    waiting: id, size. gaps: id, size. Pieces, largest first, take the least gap that holds them.
    """
    rows = waiting.select(F.lit(0).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(1).alias("kind"), "id", "size"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(RANK_SHARDS)).cast("int"))
    # At most 2 * capacity * RANK_SHARDS rows, whatever the input; they are looked through in one place.
    counts = rows.groupBy("size", "kind", "shard").agg(F.count("*").alias("n")).coalesce(1)
    # Depth before a size, over all smaller ones: at most capacity rows. Pieces come before gaps of their size.
    sizes = counts.groupBy("size").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("opened"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).alias("rise"))
    smaller = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("size", "opened", F.coalesce(F.sum("rise").over(smaller), F.lit(0)).alias("depth"))
    before = Window.partitionBy("size", "kind").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("size", "kind", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(sizes, "size")
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("size", "kind", "shard").orderBy("id"))).join(F.broadcast(base), ["size", "kind", "shard"])
    rank = F.col("base") + F.col("own")
    level = F.when(F.col("kind") == 0, F.col("depth") + rank).otherwise(F.col("depth") + F.col("opened") - rank + 1)
    line = Window.partitionBy("level").orderBy("size", "kind")
    pair = lambda f, kind: F.when(f("kind", 1).over(line) == kind, F.struct(f("id", 1).over(line).alias("id"), f("size", 1).over(line).alias("size")))
    out = ranked.withColumn("level", level).withColumn("other", F.when(F.col("kind") == 0, pair(F.lead, 1)).otherwise(pair(F.lag, 0)))
    return out.select("kind", "id", "size", F.col("other.id").alias("other"), F.col("other.size").alias("other_size"))


def laid_out(rows: DataFrame, capacity: int, total: int, largest: int) -> DataFrame:
    """id, sequence, offset, from 0: small rows (id, size) end to end, a new sequence before the one would overflow."""
    shards = max(1, -(-total // (64 * capacity)))
    room = capacity - largest + 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long"))
    so_far = Window.partitionBy("shard").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(so_far), F.lit(0))).withColumn("turn", F.floor(F.col("at") / room))
    own = Window.partitionBy("shard", "turn")
    return rows.select("id", (F.col("shard") * (128 * capacity) + F.col("turn")).alias("sequence_id"), (F.col("at") - F.min("at").over(own)).cast("long").alias("offset"))


def bundles(rows: DataFrame, capacity: int, total: int) -> DataFrame:
    """pid, item, inner, item_size: short pieces lie in bundles from ``inner`` on; a long piece is an item of its own.

    rows: pid, length. total: ids in short pieces.
    """
    least = max(1, capacity // 16)
    shards = max(1, -(-total // (32 * capacity)))
    short = rows.filter(F.col("length") < least).withColumn("shard", F.pmod(F.xxhash64("pid"), F.lit(shards)).cast("long"))
    so_far = Window.partitionBy("shard").orderBy("length", "pid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("at", F.coalesce(F.sum("length").over(so_far), F.lit(0))).withColumn("bundle", F.floor(F.col("at") / least))
    own = Window.partitionBy("shard", "bundle")
    short = short.select("pid", (-1 - F.col("shard") * (64 * capacity) - F.col("bundle")).alias("item"), (F.col("at") - F.min("at").over(own)).alias("inner"), F.sum("length").over(own).alias("item_size"))
    long = rows.filter(F.col("length") >= least).select("pid", F.col("pid").alias("item"), F.lit(0).cast("long").alias("inner"), F.col("length").alias("item_size"))
    return long.unionByName(short)


def pack(docs: DataFrame, file: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset (their place in the sequence, gapless from 0)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.put("pieces", pieces(docs, file, capacity, end_id, with_ids).withColumn("pid", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.when(F.col("length") < max(1, capacity // 16), F.col("length")))).first()[0] or 0
    items = scratch.put("items", bundles(rows.select("pid", "length"), capacity, total))
    waiting = items.filter("inner = 0").select(F.col("item").alias("id"), F.col("item_size").alias("size"))
    look = (F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min("size"), F.max("size"))
    state = waiting.agg(*look).first()
    all_of_it = state[1]
    placed = spark.createDataFrame([], "id long, sequence_id long, offset long")
    gaps = spark.createDataFrame([], "id long, size long")
    opened, turn, few = 0, 0, True
    while state[0]:
        if few and turn and state[1] <= LAST_SHARE * all_of_it and state[3] <= capacity // 8:
            # A small rest of small items fills sequences of its own.
            rest = laid_out(waiting, capacity, state[1], state[3])
            placed = placed.unionByName(rest.withColumn("sequence_id", F.col("sequence_id") + opened))
            break
        if few:
            new = -(-state[1] // capacity)
            gaps = gaps.unionByName(spark.range(opened, opened + new).select("id", F.lit(capacity).cast("long").alias("size")))
            opened += new
        swept = scratch.put(f"round{turn}", matched(waiting, gaps))
        own = swept.filter("kind = 0 AND other IS NOT NULL").select("id", F.col("other").alias("sequence_id"), (F.lit(capacity) - F.col("other_size")).cast("long").alias("offset"))
        placed = placed.unionByName(own)
        waiting = swept.filter("kind = 0 AND other IS NULL").select("id", "size")
        was = state[1]
        state = waiting.agg(*look).first()
        # A gap that holds nothing of what waits is out.
        left = F.col("size") - F.coalesce("other_size", F.lit(0))
        gaps = swept.filter("kind = 1").select("id", left.alias("size")).filter(F.col("size") >= (state[2] or capacity + 1))
        few = was - state[1] < LEAST_SHARE * was or gaps.isEmpty()
        turn += 1
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset")]
    out = rows.join(items, "pid").join(placed.withColumnRenamed("id", "item"), "item")
    return unmasked(out.select(*cols, *(["ids"] if with_ids else [])))
