"""Palettes of 8 x 8 blocks: few colours that lose least, and the colour of each sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 2, 6  # colours of a palette
PROBED = 16  # colours of the cache that are looked at


def medians(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """k of the sorted values such that the summed distance of all samples to the median of their run of values is least.

    Runs are found by dynamic programming over where the last run begins; of equal sums the earliest beginning stands. Medians are lower ones.
    """
    n = len(values)
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * values)])
    lo, hi = np.triu_indices(n)
    mid = np.searchsorted(c[1:], c[lo] + (c[hi + 1] - c[lo] + 1) // 2)
    m = values[mid]
    cost = np.full((n, n), np.iinfo(np.int64).max // 4)
    cost[lo, hi] = m * (2 * c[mid + 1] - c[lo] - c[hi + 1]) - 2 * s[mid + 1] + s[lo] + s[hi + 1]
    median = np.zeros((n, n), np.int64)
    median[lo, hi] = m
    best, cut = cost[0].copy(), [np.zeros(n, np.int64)]
    for _ in range(1, k):
        # a run that begins at b > 0 follows the best of one run less that ends before it
        total = np.full((n, n), np.iinfo(np.int64).max // 2)
        total[1:] = best[:-1, None] + cost[1:]
        cut.append(total.argmin(0))
        best = total.min(0)
    out, end = [], n - 1
    for begin in reversed(cut):
        out.append(median[begin[end], end])
        end = begin[end] - 1
    return np.array(out[::-1])


def palette(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(colours ascending, index of the nearest colour of each sample, the lower at equal distance). A block of one value gets a second colour: the least number that it is not."""
    values, counts = np.unique(samples.astype(np.int64), return_counts=True)
    if len(values) > MOST:
        values = medians(values, counts, MOST)
    elif len(values) < LEAST:
        values = np.sort(np.append(values, 1 if values[0] == 0 else 0))
    return values, np.abs(samples.astype(np.int64)[:, None] - values[None]).argmin(1)


def block_palettes(s: DataFrame) -> DataFrame:
    """(frame, gy, gx, colours, indices in raster order, sad) of each full 8 x 8 block of v0."""
    place = (F.col("y") % 8) * 8 + F.col("x") % 8
    g = s.groupBy("frame", F.floor(F.col("y") / 8).alias("gy"), F.floor(F.col("x") / 8).alias("gx")).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("v0").cast("long").alias("v")))).alias("b"))
    blocks = g.where(F.size("b") == 64).select("frame", "gy", "gx", F.transform("b", lambda r: r["v"]).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(3).flatten().to_numpy().reshape(-1, 64)
            got = [palette(row) for row in x]
            sad = [int(np.abs(row - c[i]).sum()) for row, (c, i) in zip(x, got, strict=True)]
            lists = lambda k: pa.array([g[k] for g in got], pa.list_(pa.int64()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(0), lists(1), pa.array(sad)], names=["frame", "gy", "gx", "colours", "indices", "sad"])

    return blocks.mapInArrow(run, "frame long, gy long, gx long, colours array<long>, indices array<long>, sad long")


def _number(v: Column, bits: Column) -> Column:
    """A number in so many bits, none for none."""
    return F.when(bits <= 0, "").otherwise(F.call_function("lpad", F.bin(v), bits.cast("int"), F.lit("0")))


def _log_up(v: Column) -> Column:
    return F.when(v <= 1, 0).otherwise(F.length(F.bin(v - 1)))


def colour_code(colours: Column, cache: Column, depth: int = 8) -> Column:
    """Bits, as text, of a palette (distinct colours ascending) after the neighbours' colours (an array).

    A bit for each colour of the cache says whether the palette has it, up to the one that completes the palette; only the first 16 are looked at, the others are
    no. Then come the colours not yet there: the first as it is, and steps less one in as many bits as the largest takes, which shrink with the room that is left.
    """
    here = F.transform(cache, lambda c, i: (i < PROBED) & F.array_contains(colours, c) & ~F.exists(F.slice(cache, 1, i), lambda b: b == c))
    whole = F.size(F.filter(here, lambda h: h)) == F.size(colours)
    last = F.size(cache) - F.array_position(F.reverse(here), F.lit(True)).cast("int") + 1
    flags = F.array_join(F.transform(F.when(whole & F.exists(here, lambda h: h), F.slice(here, F.lit(1), last)).otherwise(here), lambda h: F.when(h, "1").otherwise("0")), "")
    rest = F.filter(colours, lambda c: ~F.exists(F.slice(cache, 1, PROBED), lambda b: b == c))

    def code(r: Column) -> Column:
        first, least = F.get(r, F.lit(0)), depth - 3
        steps = F.transform(F.slice(r, F.lit(2), F.size(r)), lambda v, i: v - F.get(r, i))
        bits = F.greatest(_log_up(F.array_max(steps)), F.lit(least))

        def add(state: Column, d: Column) -> Column:
            room = state["room"] - d
            return F.struct(F.concat(state["text"], _number(d - 1, state["bits"])).alias("text"), F.least(state["bits"], _log_up(room)).alias("bits"), room.alias("room"))

        start = F.struct(_number(bits - least, F.lit(2)).alias("text"), bits.alias("bits"), ((1 << depth) - 1 - first).cast("long").alias("room"))
        tail = F.when(F.size(steps) > 0, F.aggregate(steps, start, add, lambda s: s["text"])).otherwise("")
        return F.when(F.size(r) == 0, "").otherwise(F.concat(_number(first, F.lit(depth)), tail))

    return F.concat(flags, F.get(F.transform(F.array(rest), code), F.lit(0)))
