"""Levels of coefficient blocks as array expressions: rate estimate, pruning, transform-skip levels, inverse transforms, reconstruction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scan order of a 4 x 4 block
SCAN = (0, 4, 1, 8, 5, 2, 12, 9, 6, 3, 13, 10, 7, 14, 11, 15)
# fixed values: scale of a level by quantiser modulo six, for blocks whose sides' logarithms have an even and an odd sum
SCALES = ((40, 45, 51, 57, 64, 72), (57, 64, 72, 80, 90, 102))
# fixed values: 64 sqrt(2) cos(j pi / 64) for j = 1 to 31, as integers
COSINES = (90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)
# fixed values: first rows of the sine transform
SINES = {4: (29, 55, 74, 84), 8: (17, 32, 46, 60, 71, 78, 85, 86)}
# fixed values: (level up to which there is no high range, what is taken off above it) by kind: near the first coefficient, elsewhere
HIGH = {"luma": ((7, 8), (5, 6)), "chroma": ((4, 5), (5, 6)), "skip": ((5, 6), (5, 6))}
NEAR = {"luma": 4, "chroma": 1, "skip": 0}
PAIRS = {0: ("cos", "cos"), 2: ("sin", "sin"), 3: ("flip", "sin"), 4: ("sin", "flip"), 5: ("flip", "flip")}  # (across, down)

_long = lambda v: F.lit(v).cast("long")


def _bits(v: Column) -> Column:
    """Bits of a positive number."""
    return F.length(F.bin(v)).cast("long")


def _shl(v: Column, k: Column) -> Column:
    return F.call_function("shiftleft", v, k.cast("int"))


def _shr(v: Column, k: Column) -> Column:
    return F.call_function("shiftright", v, k.cast("int"))


def _high_bits(value: Column, context: Column) -> Column:
    """Bits of a value in a truncated Rice code whose parameter follows the running average; a long quotient goes on in an exponential code."""
    m = F.when(context < 4, 1).when(context < 8, 2).when(context < 16, 3).when(context < 32, 4).when(context < 64, 5).otherwise(6).cast("long")
    most = F.least(m + 4, _long(6))
    q = _shr(value, m)
    n = _bits(value - _shl(most, m) + _shl(_long(1), m + 1))
    return F.when(q >= most, most + 2 * n - 2 - m).otherwise(q + 1 + m)


def rate_estimate(levels: Column, kind: str) -> Column:
    """Estimated rate of a 4 x 4 block of levels (an array in raster order) of kind luma, chroma or skip. An all-zero block costs 16.

    Of a skip block the scan from its first level to the end counts, else the scan up to its last level, whose high ranges are taken backwards.
    """
    scanned = F.transform(F.array(*map(F.lit, SCAN)), lambda p: F.struct(F.abs(F.get(levels, p)).cast("long").alias("a"), (F.floor(p / 4) + p % 4 < NEAR[kind]).alias("near")))
    some = F.array_position(F.transform(scanned, lambda r: r["a"] > 0), F.lit(True)).cast("int")
    last = 17 - F.array_position(F.reverse(F.transform(scanned, lambda r: r["a"] > 0)), F.lit(True)).cast("int")
    part = F.slice(scanned, some, 17 - some) if kind == "skip" else F.reverse(F.slice(scanned, F.lit(1), last))
    (t1, o1), (t2, o2) = HIGH[kind]

    def add(state: Column, r: Column) -> Column:
        a = r["a"]
        high = a > F.when(r["near"], t1).otherwise(t2)
        over = F.greatest(a - F.when(r["near"], o1).otherwise(o2), _long(0))
        score = state["score"] + 10 + F.when(a > 0, 80 + 14 * F.least(a, _long(12))).otherwise(0) + F.when(high, 64 * _high_bits(over, state["mean"])).otherwise(0)
        return F.struct(score.cast("long").alias("score"), F.when(high, _shr(state["mean"] + over, F.lit(1))).otherwise(state["mean"]).alias("mean"))

    total = F.aggregate(part, F.struct(_long(96).alias("score"), _long(0).alias("mean")), add, lambda s: s["score"])
    return F.when(some == 0, _long(16)).otherwise(total)


def prune_threshold(qindex: Column, depth: Column, full_chroma: Column, variance: Column) -> Column:
    """Largest magnitude that is dropped: with eight bits 1, and only in smooth blocks of full chroma at coarse steps; deeper, by the step."""
    deep = F.when(qindex < 72, 0).when(qindex < 160, 3).otherwise(4)
    return F.when(depth > 8, deep).when(full_chroma & (qindex >= 72) & (variance <= 16384), 1).otherwise(0)


def prune_small(levels: Column, threshold: Column) -> Column:
    """Levels but the first that are not over the threshold become zero."""
    return F.transform(levels, lambda v, i: F.when((i > 0) & (F.abs(v) <= threshold), F.lit(0).cast("long")).otherwise(v))


def prune_tail(levels: Column, most: int) -> Column:
    """The last levels in scan order become zero while they are 1 or -1, at most `most` of them and never the first; zeros between do not end it."""
    order = F.array(*map(F.lit, SCAN))
    rank = lambda i: F.array_position(order, i.cast("int"))
    scanned = F.transform(order, lambda p: F.abs(F.get(levels, p)))

    def goes(v: Column, i: Column) -> Column:
        later = F.slice(scanned, (rank(i) + 1).cast("int"), F.lit(16))
        return (i > 0) & (F.abs(v) == 1) & F.forall(later, lambda a: a <= 1) & (F.size(F.filter(later, lambda a: a == 1)) < most)

    return F.transform(levels, lambda v, i: F.when(goes(v, i), F.lit(0).cast("long")).otherwise(v))


def _skip_scale(depth: Column, qp: Column) -> tuple[Column, Column]:
    q = F.greatest(qp + (depth - 8) * 6, F.lit(4))
    return F.get(F.array(*[_long(s) for s in SCALES[0]]), (q % 6).cast("int")), (6 - F.floor(q / 6)).cast("long")


def _held(v: Column) -> Column:
    return F.least(F.greatest(v, _long(-32768)), _long(32767))


def skip_value(level: Column, depth: Column, qp: Column) -> Column:
    """What a transform-skip level stands for, held to 16 bits."""
    scale, down = _skip_scale(depth, qp)
    return _held(F.when(down > 0, _shr(level * scale + _shl(_long(1), down - 1), down)).otherwise(_shl(level * scale, -down)))


def skip_level(residual: Column, depth: Column, qp: Column, radius: int = 1) -> Column:
    """The level nearest to a residual among those within `radius` of the rounded quotient: least squared error, then least magnitude, then the quotient itself."""
    scale, down = _skip_scale(depth, qp)
    num = F.when(down > 0, _shl(F.abs(residual).cast("long"), F.greatest(down, _long(0)))).otherwise(F.abs(residual).cast("long"))
    den = F.when(down > 0, scale).otherwise(_shl(scale, F.greatest(-down, _long(0))))
    about = F.signum(residual).cast("long") * F.floor((num + F.floor(den / 2)) / den)

    def weigh(d: Column) -> Column:
        level = _held(about + d)
        miss = residual - skip_value(level, depth, qp)
        return F.struct((miss * miss).alias("e"), F.abs(level).alias("a"), (d != 0).alias("other"), d.alias("d"), level.alias("level"))

    best = F.array_min(F.transform(F.array(*[_long(d) for d in range(-radius, radius + 1)]), weigh))["level"]
    return F.when(residual == 0, _long(0)).otherwise(best)


def basis(kind: str, n: int, k: int, i: int) -> int:
    """Sample i of basis k: `cos` for sides of 4 to 32; `sin` and its mirror `flip` for 4 and 8."""
    if kind == "cos":
        a = (2 * i + 1) * k * (32 // n) % 128
        a = min(a, 128 - a)
        return 64 if a == 0 else COSINES[a - 1] if a < 32 else -COSINES[63 - a] if a > 32 else 0
    if kind == "flip":
        return (-1) ** k * basis("sin", n, k, n - 1 - i)
    a, turn = (2 * k + 1) * (i + 1) % (4 * n + 2), 2 * n + 1
    sign, a = (1, a) if a < turn else (-1, a - turn)
    return sign * (0 if a == 0 else SINES[n][min(a, turn - a) - 1])


def dequantise(levels: Column, w: int, h: int, qp: Column) -> Column:
    """Levels of a w x h block times the quantiser's scale."""
    logs = (w * h).bit_length() - 1
    scale = 16 * F.get(F.array(*[_long(s) for s in SCALES[logs % 2]]), (qp % 6).cast("int")) * _shl(_long(1), F.floor(qp / 6))
    down = 3 + logs % 2 + logs // 2
    return F.transform(levels, lambda v: F.call_function("shiftright", v * scale + (1 << (down - 1)), F.lit(down)))


def inverse_transform(c: Column, w: int, h: int, depth: int, pair: int = 0) -> Column:
    """Residual of a w x h block of dequantised coefficients (arrays in raster order): columns first, rounded off by 7 bits, then rows by 20 - depth.

    `pair` names the transforms: 0 cosine both ways, 2 to 5 sines and mirrored sines (across, down), which take sides of 4 and 8. Sides of 16 and
    32 take coefficients of the lowest four rows and columns only; others count as zero. Values must fit 16 bits, as those of coded streams do.
    """
    across, down = PAIRS[pair]
    table = lambda kind, n: F.array(*[F.array(*[_long(basis(kind, n, k, i)) for k in range(min(n, 4) if n > 8 else n)]) for i in range(n)])
    kept = lambda n: F.sequence(F.lit(0), F.lit((4 if n > 8 else n) - 1))
    dot = lambda row, n, at: F.aggregate(kept(n), _long(0), lambda a, k: a + F.get(row, k) * at(k))
    place = F.sequence(F.lit(0), F.lit(w * h - 1))
    ver, hor, off = table(down, h), table(across, w), 20 - depth
    col = lambda i: F.call_function("shiftright", dot(F.get(ver, F.floor(i / w).cast("int")), h, lambda k: F.get(c, k * w + i % w)) + 64, F.lit(7))
    mid = F.transform(place, col)
    row = lambda m: F.transform(place, lambda i: F.call_function("shiftright", dot(F.get(hor, i % w), w, lambda k: F.get(m, F.floor(i / w).cast("int") * w + k)) + (1 << (off - 1)), F.lit(off)))
    return F.get(F.transform(F.array(mid), row), F.lit(0))


def reconstruct(predicted: Column, residual: Column, depth: int = 8) -> Column:
    """Predictor plus residual, held to the depth's range."""
    return F.zip_with(predicted, residual, lambda p, r: F.least(F.greatest(p + r, _long(0)), _long((1 << depth) - 1)))
