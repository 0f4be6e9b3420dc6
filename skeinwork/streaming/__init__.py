"""Streams: the same operators over ``readStream`` frames, and sinks for their batches.

Stateless operators (project, compute, filter) and grouped aggregates take streaming
frames as they are. What depends on a global order does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregation import AggregationSpecification, group_aggregate
from ..sources import Sink
from ..types import Schema


def stream_input(spark: SparkSession, folder: str, schema: Schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.spark())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_output(df: DataFrame, sink: Sink, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Each batch goes to the sink; with ``available_now`` the query ends when the
    input that is there has been read."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sink.write(batch) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_aggregate(df: DataFrame, time: str, length: str, lateness: str, keys: list[str], spec: AggregationSpecification) -> DataFrame:
    """Grouped aggregates in event-time windows; rows later than ``lateness`` are
    dropped by the watermark."""
    timed = df.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", lateness)
    windowed = timed.withColumn("window_start", F.window("__time", length)["start"])
    return group_aggregate(windowed, ["window_start", *keys], spec)
