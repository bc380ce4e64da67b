"""Hashes of sample blocks bit for bit, as integer expressions; products and sums are kept to 32-bit limbs, so nothing overflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = (1 << 32) - 1
# fixed values: starts and multiplier of the hashes, salt of a plane
START64, START32 = 0xCBF29CE484222325, 0x811C9DC5
PRIME_LOW, PRIME_SHIFT = 0x1B3, 44  # the multiplier is 2^44 + 0x1b3
SALT = 0x9E3779B97F4A7C15


def _low(v: Column) -> Column:
    return v.bitwiseAND(F.lit(M))


def _left(v: Column, k: int) -> Column:
    return F.call_function("shiftleft", v, F.lit(k))


def _right(v: Column, k: int) -> Column:
    return F.call_function("shiftrightunsigned", v, F.lit(k))


def _turn(v: Column, k: int) -> Column:
    return _low(_left(v, k)).bitwiseOR(_right(v, 32 - k))


def _pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def step64(h: Column, hi: Column, lo: Column) -> Column:
    """(h xor word) times the multiplier, modulo 2^64; h and the word are (hi, lo)."""
    a, b = h["hi"].bitwiseXOR(hi), h["lo"].bitwiseXOR(lo)
    low = b * PRIME_LOW
    return _pair(_low(a * PRIME_LOW + _right(low, 32) + _low(_left(b, PRIME_SHIFT - 32))), _low(low))


def mixed32(h: Column, hi: Column, lo: Column, meta: Column) -> Column:
    """A packet of eight bytes (hi, lo) mixed into h by turns and shifts."""
    r = h.bitwiseXOR(lo).bitwiseXOR(_turn(hi, 5)).bitwiseXOR(meta)
    return r.bitwiseXOR(_turn(r, 13)).bitwiseXOR(_low(_left(r, 7))).bitwiseXOR(_right(r, 11))


def shifted32(h: Column, byte: Column) -> Column:
    """A byte taken into h by three shifts."""
    a = h.bitwiseXOR(byte)
    a = a.bitwiseXOR(_low(_left(a, 13)))
    a = a.bitwiseXOR(_right(a, 17))
    return a.bitwiseXOR(_low(_left(a, 5)))


def _words(b: Column) -> Column:
    """Groups of eight bytes as (hi, lo, at), at being the first byte's place; the last group may be short."""
    half = lambda i, k: sum((_left(F.coalesce(F.get(b, i * 8 + k + j), F.lit(0).cast("long")), 8 * j) for j in range(1, 4)), F.coalesce(F.get(b, i * 8 + k), F.lit(0).cast("long")))
    groups = F.sequence(F.lit(0), F.floor((F.size(b) - 1) / 8).cast("int"))
    return F.transform(groups, lambda i: F.struct(half(i, 4).alias("hi"), half(i, 0).alias("lo"), (i * 8).cast("long").alias("at")))


def block_hashes(s: DataFrame, size: int = 8, depth: int = 8) -> DataFrame:
    """(frame, gy, gx, hi, lo, mixed, shifted) of full blocks of three planes of one size: the 64-bit region hash as two halves and both
    32-bit block hashes. `size` is a multiple of eight; samples of more than eight bits are two bytes, the low one first. Partial blocks are left out."""
    if size <= 0 or size % 8:
        raise ValueError("block hashes take sizes that are multiples of eight")
    place = (F.col("y") % size) * size + F.col("x") % size
    g = s.groupBy("frame", F.floor(F.col("y") / size).alias("gy"), F.floor(F.col("x") / size).alias("gx")).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "v0", "v1", "v2"))).alias("b"))
    g = g.where(F.size("b") == size * size)
    as_bytes = lambda k: F.transform("b", lambda r: r[f"v{k}"].cast("long")) if depth <= 8 else F.flatten(F.transform("b", lambda r: F.array(r[f"v{k}"].cast("long").bitwiseAND(F.lit(255)), _right(r[f"v{k}"].cast("long"), 8))))
    g = g.select("frame", "gy", "gx", *[as_bytes(k).alias(f"b{k}") for k in range(3)])
    region = _pair(F.lit(START64 >> 32).cast("long"), F.lit(START64 & M).cast("long"))
    mixed, shifted = F.lit(START32).cast("long"), F.lit(START32).cast("long")
    for k in range(3):
        salt = k * SALT % (1 << 64)
        region = step64(region, F.lit(salt >> 32).cast("long"), F.lit(salt & M).cast("long"))
        g = g.withColumn("_w", _words(F.col(f"b{k}"))).withColumns({
            "_r": F.aggregate("_w", region if k == 0 else step64(F.col("_r"), F.lit(salt >> 32).cast("long"), F.lit(salt & M).cast("long")), lambda h, w: step64(h, w["hi"], w["lo"])),
            "_m": F.aggregate("_w", mixed if k == 0 else F.col("_m"), lambda h, w: mixed32(h, w["hi"], w["lo"], F.lit(k << 10).cast("long").bitwiseOR(_left(w["at"], 4)).bitwiseOR(F.lit(8).cast("long")))),  # noqa: B023
            "_s": F.aggregate(f"b{k}", shifted if k == 0 else F.col("_s"), shifted32),
        })
    return g.select("frame", "gy", "gx", F.col("_r.hi").alias("hi"), F.col("_r.lo").alias("lo"), F.col("_m").alias("mixed"), F.col("_s").alias("shifted"))
