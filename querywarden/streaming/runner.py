"""Running a stream over what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def drain(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> None:
    """Hand all input that has arrived since the last call to ``on_batch`` and stop."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )
    query.awaitTermination()


def drain_to_parquet(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Append all input that has arrived since the last call to a parquet folder."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
