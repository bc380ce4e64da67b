"""Statistics of blocks and their neighbours: energy split, left and above samples, blocks that repeat within a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.frames import blocks


def residual_energy(s: DataFrame, size: int) -> DataFrame:
    """(frame, gy, gx, total, head, tail): squared samples of a block, those of its first 4 x 4, and the rest."""
    e = F.col("v0") * F.col("v0")
    head = F.when((F.col("y") % size < 4) & (F.col("x") % size < 4), e).otherwise(0)
    g = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.sum(e).alias("total"), F.sum(head).alias("head"))
    return g.withColumn("tail", F.col("total") - F.col("head"))


def neighbours(s: DataFrame) -> DataFrame:
    """(frame, y, x, v0, left, above): the samples beside each, null outside the frame. Windows span one line or one column of a frame."""
    left = F.lag("v0").over(Window.partitionBy("frame", "y").orderBy("x"))
    above = F.lag("v0").over(Window.partitionBy("frame", "x").orderBy("y"))
    return s.select("frame", "y", "x", "v0", left.alias("left"), above.alias("above"))


def copies_within(s: DataFrame, size: int = 8) -> DataFrame:
    """(frame, gy, gx, from_gy, from_gx): full blocks whose samples an earlier block of the same frame has, with the last such block before
    them in raster order. One window over equal contents instead of a join of all their pairs."""
    own = F.array_sort(F.collect_list(F.struct("y", "x", "v0", "v1", "v2")))
    b = blocks(s, size).groupBy("frame", "gy", "gx").agg(own.alias("o"), F.count("*").alias("n")).where(F.col("n") == size * size)
    b = b.select("frame", "gy", "gx", F.sha2(F.to_json(F.transform("o", lambda r: F.struct(r["v0"], r["v1"], r["v2"]))), 256).alias("d"))
    before = F.lag(F.struct("gy", "gx")).over(Window.partitionBy("frame", "d").orderBy("gy", "gx"))
    return b.withColumn("from", before).where("from is not null").select("frame", "gy", "gx", F.col("from.gy").alias("from_gy"), F.col("from.gx").alias("from_gx"))


def copy_statistics(s: DataFrame, size: int = 8) -> DataFrame:
    """(frame, blocks, copied, distance): full blocks of a frame, those that repeat an earlier one, and the sum of their distances in blocks."""
    full = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.count("*").alias("n")).where(F.col("n") == size * size).groupBy("frame").agg(F.count("*").alias("blocks"))
    far = F.abs(F.col("gy") - F.col("from_gy")) + F.abs(F.col("gx") - F.col("from_gx"))
    got = copies_within(s, size).groupBy("frame").agg(F.count("*").alias("copied"), F.sum(far).alias("distance"))
    return full.join(got, "frame", "left").select("frame", "blocks", F.coalesce("copied", F.lit(0)).alias("copied"), F.coalesce("distance", F.lit(0)).alias("distance"))


def simple_leaves(s: DataFrame, leaf: int = 64, depth: int = 8) -> DataFrame:
    """(frame, gy, gx, colours, spread, gradient, simple): features of each leaf's samples at every fourth line and column, brought to 8 bits.

    gradient is the mean difference to the left and upper sample times 256, cut; a leaf is simple with 8 colours or fewer, a spread of 8 or less, or
    16 colours and a gradient of 192 at most. Leaves that an edge cuts count by what they hold. A leaf's samples are one bounded list.
    """
    grid = blocks(s.where((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0)), leaf)
    own = F.array_sort(F.collect_list(F.struct("y", "x", F.shiftright("v0", max(0, depth - 8)).alias("v"))))
    g = grid.groupBy("frame", "gy", "gx").agg(own.alias("o"), F.count_distinct("x").alias("c"), F.count_distinct("y").alias("r"))
    g = g.withColumn("v", F.transform("o", lambda e: e["v"]))
    left = "IF(i % c > 0, abs(e - v[i - 1]), 0)"
    above = "IF(i >= c, abs(e - v[CAST(i - c AS INT)]), 0)"
    total = F.expr(f"aggregate(transform(v, (e, i) -> CAST({left} + {above} AS BIGINT)), CAST(0 AS BIGINT), (a, b) -> a + b)")
    edges = F.col("r") * (F.col("c") - 1) + (F.col("r") - 1) * F.col("c")
    g = g.select("frame", "gy", "gx", F.size(F.array_distinct("v")).cast("long").alias("colours"), (F.array_max("v") - F.array_min("v")).alias("spread"), F.when(edges > 0, F.floor(total * 256 / F.greatest(edges, F.lit(1)))).otherwise(0).alias("gradient"))
    simple = (F.col("colours") <= 8) | (F.col("spread") <= 8) | ((F.col("colours") <= 16) & (F.col("gradient") <= 192))
    return g.withColumn("simple", simple)
