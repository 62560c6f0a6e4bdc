"""Structured Streaming into a vector store: each micro-batch is one atomic write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernel.sources.store import VectorStore


def upsert_stream(stream: DataFrame, store: VectorStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write ``(vec_id, embedding)`` rows of a stream as they come.  A micro-batch is written under its number, so one
    that is replayed is not written again and cannot undo what others wrote in between."""
    writer = stream.writeStream.foreachBatch(lambda df, n: store.put_batch(df, batch=f"{checkpoint}#{n}") and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
