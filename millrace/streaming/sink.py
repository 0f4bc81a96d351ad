"""A stream into a managed table, each micro-batch exactly once."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.lakehouse import Table


def write_table(stream: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Appends every micro-batch under the query's own id, which its checkpoint keeps, and the batch's number.

    A batch that is replayed after a failure has both again and is found in the table.  Another
    stream, or the same one with a new checkpoint, has an id of its own, so none of its batches is lost.
    """
    known: dict[str, str] = {}
    started = Event()

    def put(batch: DataFrame, epoch: int) -> None:
        started.wait()
        if not batch.isEmpty():
            table.refresh().append(batch, fill_missing=True, batch_id=(known["id"], epoch))

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    known["id"] = str(query.id)
    started.set()
    return query


def upsert_table(stream: DataFrame, table: Table, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps the last row of every key: for results in update mode.  A batch that is replayed changes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.merge(batch, keys)

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
