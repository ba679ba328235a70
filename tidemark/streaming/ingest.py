"""Streams into a table, and the live view of a stream.

Each micro-batch is one commit that carries the batch's number, so a batch that is
tried again after a failure is applied once. Maintenance runs after the commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Table


def stream_into(ops: DataFrame, table: Table, checkpoint: str, name: str = "ingest", compact: bool = True, **trigger) -> StreamingQuery:
    """Starts a query that ingests a stream of op, key, value and pos (order within a micro-batch)."""

    def commit(batch: DataFrame, number: int) -> None:
        table.ingest(batch, f"{name}/{number}")
        if compact:
            table.maintain()

    writer = ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_stream(entries: DataFrame) -> DataFrame:
    """The newest entry of each key of a stream (key, seq, value), for update mode; a late entry with a smaller seq loses."""
    return entries.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
