"""Block predictors from reference samples, as array expressions: mean and plane with edge blending, chroma as a line of luma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reciprocal of a difference by its four bits below the leading one
RECIPROCALS = (0, 7, 6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1, 1, 0)

_long = lambda v: F.lit(v).cast("long")
_total = lambda a: F.aggregate(a, _long(0), lambda s, v: s + v)
_right = lambda v, k: F.call_function("shiftright", v, F.lit(k))


def _held(v: Column, depth: int) -> Column:
    return F.least(F.greatest(v, _long(0)), _long((1 << depth) - 1))


def _blended(block: Column, top: Column, left: Column, w: int, h: int, depth: int) -> Column:
    """The block drawn towards its references, less with each sample away from them; blocks with a side under four stay."""
    if min(w, h) < 4:
        return block
    scale = (w.bit_length() + h.bit_length() - 4) >> 2
    weight = lambda n: F.array(*[_long(32 >> min(31, 2 * i >> scale)) for i in range(n)])
    down, across = weight(h), weight(w)

    def draw(v: Column, i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), i % w
        return _held(v + _right(F.get(across, x) * (F.get(left, y) - v) + F.get(down, y) * (F.get(top, x) - v) + 32, 6), depth)

    return F.transform(block, draw)


def mean_block(top: Column, left: Column, w: int, h: int, depth: int = 8) -> Column:
    """w x h samples (sides are powers of two, in raster order) at the rounded mean of the references along the longer side, of both if square."""
    long_ = {w > h: F.slice(top, 1, w), w < h: F.slice(left, 1, h)}.get(True, F.concat(F.slice(top, 1, w), F.slice(left, 1, h)))
    n = 2 * w if w == h else max(w, h)
    return _blended(F.array_repeat(F.floor((_total(long_) + n // 2) / n), w * h), top, left, w, h, depth)


def plane_block(top: Column, left: Column, w: int, h: int, depth: int = 8, corner: Column | None = None) -> Column:
    """w x h samples between the references and the ones just past their ends. top has w + 1 samples, left h + 1.

    With `corner` the references are smoothed first if the block has more than 32 samples; they must then have one sample more.
    """
    if corner is not None and w * h > 32:
        smooth = lambda a, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: _right(F.when(i == 0, corner).otherwise(F.get(a, i - 1)) + 2 * F.get(a, i) + F.get(a, i + 1) + 2, 2))
        top, left = smooth(top, w), smooth(left, h)
    bits = (w * h).bit_length() - 1

    def at(i: Column) -> Column:
        y, x = F.floor(i / w).cast("int"), i % w
        across = (w - 1 - x) * F.get(left, y) + (x + 1) * F.get(top, F.lit(w))
        down = (h - 1 - y) * F.get(top, x) + (y + 1) * F.get(left, F.lit(h))
        return _right(across * h + down * w + (1 << bits), bits + 1)

    return _blended(F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), at), top, left, w, h, depth)


def template(top: Column, left: Column) -> Column:
    """Up to four of the references: two evenly spaced ones of each side, four of one if the other is empty."""

    def some(a: Column, alone: Column) -> Column:
        n, k = F.size(a), F.when(alone, 1).otherwise(0)
        part = lambda e: F.floor(n / F.when(alone, 2 ** (e + 1)).otherwise(2**e)).cast("int")
        at = F.transform(F.sequence(F.lit(0), F.least(n, 2 * (1 + k)) - 1), lambda i: F.get(a, part(2) + i * F.greatest(part(1), F.lit(1))))
        return F.when(n == 0, F.slice(a, 1, 0)).otherwise(at)

    return F.concat(some(top, F.size(left) == 0), some(left, F.size(top) == 0))


def chroma_line(pairs: Column, depth: int = 8) -> Column:
    """(a, b, shift) of the line chroma = (a * luma >> shift) + b through up to four pairs (l, c): it runs through the mean of the two of
    least and of greatest luma. Without pairs it is the middle value, at equal lumas the least pairs' chroma."""
    get = lambda i: F.get(pairs, F.lit(i))
    two = F.size(pairs) == 2
    p = [F.when(two, get(1)).otherwise(get(0)), F.when(two, get(0)).otherwise(get(1)), F.when(two, get(1)).otherwise(get(2)), F.when(two, get(0)).otherwise(get(3))]

    def swapped(when: Column, a: Column, b: Column) -> tuple[Column, Column]:
        return F.when(when, b).otherwise(a), F.when(when, a).otherwise(b)

    (lo0, lo1), (hi0, hi1) = swapped(p[0]["l"] > p[2]["l"], p[0], p[2]), swapped(p[1]["l"] > p[3]["l"], p[1], p[3])
    cross = lo0["l"] > hi1["l"]
    (lo0, hi0), (lo1, hi1) = swapped(cross, lo0, hi0), swapped(cross, lo1, hi1)
    lo1, hi0 = swapped(lo1["l"] > hi0["l"], lo1, hi0)
    mean = lambda a, b, k: _right(a[k] + b[k] + 1, 1)
    ends = F.struct(mean(lo0, lo1, "l").alias("l"), mean(lo0, lo1, "c").alias("c"), (mean(hi0, hi1, "l") - mean(lo0, lo1, "l")).alias("dl"), (mean(hi0, hi1, "c") - mean(lo0, lo1, "c")).alias("dc"))
    line = lambda a, b, shift: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), shift.cast("long").alias("shift"))

    def through(e: Column) -> Column:
        x = F.length(F.bin(F.greatest(e["dl"], _long(1)))) - 1
        part = F.call_function("shiftright", e["dl"] * 16, x).bitwiseAND(_long(15)).cast("int")
        v = F.get(F.array(*[_long(r) for r in RECIPROCALS]), part).bitwiseOR(_long(8))
        y = F.when(e["dc"] == 0, 0).otherwise(F.length(F.bin(F.abs(e["dc"]))))
        a = F.call_function("shiftright", e["dc"] * v + F.call_function("shiftright", F.call_function("shiftleft", _long(1), y), F.lit(1)), y)
        shift = 3 + x + F.when(part != 0, 1).otherwise(0) - y
        steep = shift < 1
        a, shift = F.when(steep, 15 * F.signum(a).cast("long")).otherwise(a), F.when(steep, 1).otherwise(shift)
        return F.when(e["dl"] <= 0, line(_long(0), e["c"], F.lit(0))).otherwise(line(a, e["c"] - F.call_function("shiftright", a * e["l"], shift), shift))

    return F.when(F.size(pairs) == 0, line(_long(0), _long(1 << (depth - 1)), F.lit(0))).otherwise(F.get(F.transform(F.array(ends), through), F.lit(0)))


def on_line(luma: Column, line: Column, depth: int = 8) -> Column:
    """Chroma predicted from an array of luma."""
    return F.transform(luma, lambda v: _held(F.call_function("shiftright", line["a"] * v, line["shift"].cast("int")) + line["b"], depth))
