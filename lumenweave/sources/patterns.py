"""Deterministic frames as rows (frame, y, x, v0, v1, v2), generated where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: sample triples of the patterns
CHECKER = ((208, 176, 80), (48, 96, 160))
COLOR_BLOCKS = ((32, 128, 128), (80, 96, 176), (144, 176, 96), (224, 112, 144))
# fixed values: base samples of the bit-depth canary by plane
CANARY = ((32, 96, 160, 224), (80, 144, 208, 48), (112, 176, 64, 240))


def grid(spark: SparkSession, w: int, h: int, frames: int) -> DataFrame:
    i = F.col("id")
    return spark.range(frames * w * h).select(F.floor(i / (w * h)).alias("frame"), (F.floor(i / w) % h).alias("y"), (i % w).alias("x"))


def _pick(index: Column, choices: tuple) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(c[k]).cast("long") for c in choices]), (index + 1).cast("int")) for k in range(3)]


def _tile(step: int) -> Column:
    return F.floor(F.col("x") / 8) + step * F.floor(F.col("y") / 8) + F.col("frame")


def pattern(spark: SparkSession, kind: str, w: int, h: int, frames: int) -> DataFrame:
    """black, checker, gradient or color_blocks."""
    x, y, f = F.col("x"), F.col("y"), F.col("frame")
    if kind == "black":
        v = [F.lit(0).cast("long")] * 3
    elif kind == "checker":
        v = _pick(_tile(1) % 2, CHECKER)
    elif kind == "gradient":
        v = [(x * 7 + y * 5 + f * 17) % 256, (x * 3 + f * 11 + 64) % 256, (y * 4 + f * 13 + 96) % 256]
    elif kind == "color_blocks":
        v = _pick(_tile(2) % 4, COLOR_BLOCKS)
    else:
        raise ValueError(f"no such pattern: {kind}")
    return grid(spark, w, h, frames).select("frame", "y", "x", *[c.alias(f"v{k}") for k, c in enumerate(v)])


def canary(spark: SparkSession, depth: int, w: int, h: int, frames: int) -> DataFrame:
    """Samples whose low bits beyond eight are never all zero, so that a lost bit shows."""
    shift = depth - 8
    x, y, f = F.col("x"), F.col("y"), F.col("frame")
    out = []
    for plane, row in enumerate(CANARY):
        base = F.element_at(F.array(*[F.lit(b).cast("long") for b in row]), (_tile(2) % 4 + 1).cast("int"))
        low = (x % 4).bitwiseOR((y % 4) * 4).bitwiseOR(F.lit(plane * 2)).bitwiseOR(f).bitwiseAND(F.lit((1 << shift) - 1))
        out.append((base * (1 << shift)).bitwiseOR(F.when(low == 0, (1 << shift) - 1).otherwise(low)).cast("long").alias(f"v{plane}"))
    return grid(spark, w, h, frames).select("frame", "y", "x", *out)


def chroma_420(samples: DataFrame) -> DataFrame:
    """(frame, y, x, u, v): means of 2 x 2, cut to integers."""
    return samples.groupBy("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.floor(F.sum("v1") / 4).alias("u"), F.floor(F.sum("v2") / 4).alias("v"))


def chroma_422(samples: DataFrame) -> DataFrame:
    """(frame, y, x, u, v): means of horizontal pairs, cut to integers."""
    return samples.groupBy("frame", "y", F.floor(F.col("x") / 2).alias("x")).agg(F.floor(F.sum("v1") / 2).alias("u"), F.floor(F.sum("v2") / 2).alias("v"))
