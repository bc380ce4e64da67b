"""Whether coded frames give back their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(source: DataFrame, coded: DataFrame) -> DataFrame:
    """(stream, status, n_source, n_coded, first_bad) of frames (stream, frame_index, data).

    Status: `missing` (a side has no frame), `length` (bytes differ in total), `samples` (a frame differs), `equal`. first_bad is the
    least index whose frame differs or is on one side only. Frames meet by digest, so no payload is shuffled. A frame's data is null as it is empty.
    """
    name = lambda df, k: df.select("stream", "frame_index", F.sha2(F.coalesce("data", F.lit(b"")), 256).alias(f"d{k}"), F.length(F.coalesce("data", F.lit(b""))).cast("long").alias(f"n{k}"))
    both = name(source, 0).join(name(coded, 1), ["stream", "frame_index"], "full")
    g = both.groupBy("stream").agg(
        F.count("d0").alias("n_source"), F.count("d1").alias("n_coded"),
        F.coalesce(F.sum("n0"), F.lit(0)).alias("b0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("b1"),
        F.min(F.when(~F.col("d0").eqNullSafe(F.col("d1")), F.col("frame_index"))).alias("first_bad"),
    )
    status = F.when((F.col("n_source") == 0) | (F.col("n_coded") == 0), "missing").when(F.col("b0") != F.col("b1"), "length").when(F.col("first_bad").isNotNull(), "samples").otherwise("equal")
    return g.select("stream", status.alias("status"), "n_source", "n_coded", "first_bad")
