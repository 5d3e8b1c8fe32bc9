"""Fitted models on streams: they are projections, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mlframe.operators.base import Model


def score_stream(stream: DataFrame, model: Model, path: str, checkpoint: str, keep: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes the model's outputs for a stream as Parquet; with ``available_now`` it stops when the present input is done."""
    writer = model.transform(stream, keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
