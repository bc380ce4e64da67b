"""Bloom filters as one-row tables of 64-bit words: built by aggregation, read as scalar subqueries; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: bits of the largest filter: 8 MB, gathered in one task and sent to every executor
MOST_BITS = 1 << 26


@dataclass
class Level:
    bits: DataFrame  # one row, one array of longs
    size: int
    hashes: int
    seed: int

    def says(self, key: Column) -> Column:
        """Whether the filter takes the key for one of its own."""
        word = self.bits.scalar()
        tests = []
        for j in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(1000 * self.seed + j)), F.lit(self.size))
            shifted = F.call_function("shiftrightunsigned", F.get(word, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int"))
            tests.append(shifted.bitwiseAND(F.lit(1)) == 1)
        return reduce(lambda a, b: a & b, tests)


def bloom(keys: DataFrame, n: int, seed: int, bits_per_key: int, hashes: int, most_bits: int = MOST_BITS) -> Level:
    """A filter over `keys` (key), n of them, of at most most_bits bits."""
    size = max(64, -(-min(n * bits_per_key, most_bits) // 64) * 64)
    at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(1000 * seed + j)), F.lit(size)) for j in range(hashes)]))
    words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    # words without a bit are zero; the row's size is bounded by most_bits
    all_words = keys.sparkSession.range(size // 64).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    row = all_words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))
    return Level(cut(row), size, hashes, seed)


def without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key, the columns `on`, is not among gone's; null is a key like any other. gone may have any size.

    Rows that a filter of bounded size rules out go through without a shuffle; the rest meet gone in an exact anti join.
    """
    gone = cut(gone.select(F.xxhash64(*on).alias("key"), *on).distinct())
    n = gone.count()
    if n == 0:
        return rows
    says = bloom(gone, n, 31, 12, 4).says(F.xxhash64(*on))
    other = gone.select(*[F.col(c).alias(f"__gone_{c}") for c in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__gone_{c}")) for c in on])
    return rows.where(~says).union(rows.where(says).join(other, same, "left_anti"))
