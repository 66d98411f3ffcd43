"""Continuous ingest: each micro-batch is indexed like any other batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skein.sources.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Indexes a stream of rows; a batch that is delivered again adds nothing, as existing keys are skipped."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: collection.index(batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
