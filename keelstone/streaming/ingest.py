"""A change-log stream as table updates, each micro-batch once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keelstone.operators.table import Table


def ingest(stream: DataFrame, table: Table, name: str = "stream") -> DataStreamWriter:
    """A writer that applies each micro-batch (ordinal, k, op, v, blob) to the table.

    Order within a batch is by ordinal, and batches follow one another. The
    number of the last batch is part of the table's content, and so of its
    snapshots: a batch that is replayed, also by another driver into the table
    reopened from a snapshot, is skipped if the table has it. Streams of a
    table have names of their own.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= dict(table.content.streams).get(name, -1):
            return
        table.updates(batch)
        table.content = replace(table.content, streams=tuple((dict(table.content.streams) | {name: batch_id}).items()))

    return stream.writeStream.foreachBatch(apply)
