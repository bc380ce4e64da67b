"""Frames from a stream through stateless filters to a sink, with figures for each frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Filter = Callable[[DataFrame], DataFrame]


def through(frames: DataFrame, filters: list[Filter]) -> DataFrame:
    """Batch or stream: each filter gives any number of rows for a row. An error in one ends the query before its batch is committed."""
    for f in filters:
        frames = f(frames)
    return frames


def start(frames: DataFrame, filters: list[Filter], path: str, checkpoint: str, metrics: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes what comes through to Parquet, all that is there, then stops. A batch that is run again replaces its own rows.

    metrics gets the batch as written, read back, so that filters run once.
    """

    def put(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        if metrics:
            metrics(batch.sparkSession.read.schema(batch.schema).parquet(at), number)

    return through(frames, filters).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frame_figures(coded: DataFrame) -> DataFrame:
    """(stream, frame_index, bytes, bits) of chunks (stream, frame_index, data): a frame may have several chunks."""
    n = F.length(F.coalesce("data", F.lit(b""))).cast("long")
    return coded.groupBy("stream", "frame_index").agg(F.sum(n).alias("bytes")).withColumn("bits", F.col("bytes") * 8)
