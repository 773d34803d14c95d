"""Streaming ingestion into stores and indexes, an extension over batch writes.

Each micro-batch is one write. A batch that Spark replays after a failure changes nothing: set
union is idempotent, and so is newest-by-(epoch, seq) when seq comes from the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.index import Index
from tessera.sources.store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of (key, value, seq[, tombstone])."""

    def batch(rows: DataFrame, _: int) -> None:
        store.write(rows)
        store.flush()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def into_index(stream: DataFrame, index: Index, checkpoint: str, **trigger) -> StreamingQuery:
    """Index a stream of (doc_id, text)."""

    def batch(rows: DataFrame, _: int) -> None:
        index.add(rows)
        index.flush()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
