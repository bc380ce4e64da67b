"""Choices: a source by its name, a coded form of a block by cost, units whose last decision may stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import blocks


def choose_source(sources: DataFrame, by: list[str], preferred: str, aliases: tuple[str, ...] = ()) -> DataFrame:
    """(by..., source) of sources (by..., position, source): the first, by position, with the preferred name; else the first whose name has it or an alias
    in it. Letter case does not count. A group without one has a null."""
    name = F.lower("source")
    close = name.contains(preferred.lower())
    for a in aliases:
        close = close | name.contains(a.lower())
    rank = F.when(name == preferred.lower(), 0).when(close, 1)
    return sources.groupBy(*by).agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "position", "source"))).alias("m")).select(*by, "m.source")


def cheapest(forms: Column, divisor: int = 4) -> Column:
    """Place of the chosen one among coded forms (rate, sse, loss, extra) of a block: the least rate + (sse + 2 loss) / divisor, cut, the earlier at equal
    cost. A form but the first is open only while its error is within `extra` of the first's."""
    base = F.get(forms, F.lit(0))["sse"]
    cost = F.transform(forms, lambda f, i: F.struct((f["rate"] + F.floor((f["sse"] + 2 * f["loss"]) / divisor)).alias("cost"), i.alias("i"), ((i == 0) | (f["sse"] <= base + f["extra"])).alias("open")))
    return F.array_min(F.transform(F.filter(cost, lambda c: c["open"]), lambda c: F.struct(c["cost"], c["i"])))["i"]


def reusable_units(s: DataFrame, size: int = 64) -> DataFrame:
    """(frame, gy, gx, same, reused): whether a unit of size x size equals the one in the frame before, and whether its decision may be reused: the
    units left of and above it are reused too, so no unit in the rectangle up to it may differ. The first frame has nothing to reuse.

    Units meet the frame before by digest, so samples are not joined; the rectangles need two running minima over a frame's rows.
    """
    place = F.struct((F.col("y") % size).alias("y"), (F.col("x") % size).alias("x"), "v0", "v1", "v2")
    own = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(place))), 256).alias("d"))
    was = Window.partitionBy("gy", "gx").orderBy("frame")
    same = F.coalesce((F.lag("d").over(was) == F.col("d")) & (F.lag("frame").over(was) == F.col("frame") - 1), F.lit(False))
    own = own.select("frame", "gy", "gx", same.alias("same"))
    # the first differing unit of each row of units, then the least of these over the rows up to each
    first = own.groupBy("frame", "gy").agg(F.min(F.when(~F.col("same"), F.col("gx"))).alias("bad"))
    first = first.withColumn("bad", F.min("bad").over(Window.partitionBy("frame").orderBy("gy")))
    return own.join(first, ["frame", "gy"]).select("frame", "gy", "gx", "same", (F.col("bad").isNull() | (F.col("gx") < F.col("bad"))).alias("reused"))
