"""Streams: file changes as they land, and commits per file and day.

The engine answers from snapshots; a stream keeps one current. State is bounded by a
watermark, and both sinks are idempotent per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.overlay import is_fix
from ..store import SnapshotStore


def daily_activity(commits: DataFrame, late: str = "2 days") -> DataFrame:
    """file, day, commits, fixes from a stream of (committed_at timestamp, file, message)."""
    own = commits.withWatermark("committed_at", late)
    out = own.groupBy(F.window("committed_at", "1 day").alias("w"), "file").agg(F.count("*").alias("commits"), F.count_if(is_fix(F.col("message"))).alias("fixes"))
    return out.select("file", F.col("w.start").alias("day"), "commits", "fixes")


def keep_current(changes: DataFrame, store: SnapshotStore, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts every batch of a stream into a table of the store; available data only."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            store.merge(table, rows.dropDuplicates(keys), keys)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
