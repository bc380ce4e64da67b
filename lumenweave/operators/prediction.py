"""Prediction of 4 x 4 blocks from the samples around them, and the choice among predictors, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4
MODES = ("dc", "vertical", "horizontal", "paeth")  # in order of preference at equal error


def _edges(s: DataFrame) -> DataFrame:
    """(frame, gy, gx, v, left, above, corner): blocks with all their neighbours. Each sample goes to its own block and, as an edge,
    to the blocks right of, below and diagonally after it, so blocks are gathered by one aggregation instead of joins."""
    y, x, n = F.col("y"), F.col("x"), SIZE
    gy, gx = F.floor(y / n), F.floor(x / n)
    end_y, end_x = y % n == n - 1, x % n == n - 1
    to = lambda role, dy, dx, at: F.struct(F.lit(role).alias("role"), (gy + dy).alias("gy"), (gx + dx).alias("gx"), at.cast("int").alias("at"))
    parts = F.array(
        to("v", 0, 0, (y % n) * n + x % n),
        F.when(end_x, to("left", 0, 1, y % n)), F.when(end_y, to("above", 1, 0, x % n)), F.when(end_x & end_y, to("corner", 1, 1, F.lit(0))),
    )
    rows = s.select("frame", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"), "v0").select("frame", "p.*", "v0")
    pick = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("at", F.col("v0").cast("long").alias("v0"))))), lambda r: r["v0"]).alias(role)
    g = rows.groupBy("frame", "gy", "gx").agg(*[pick(r) for r in ("v", "left", "above", "corner")])
    return g.where((F.size("v") == n * n) & (F.size("left") == n) & (F.size("above") == n) & (F.size("corner") == 1)).withColumn("corner", F.col("corner")[0])


def _predict(mode: str, left: Column, above: Column, corner: Column) -> Column:
    if mode == "dc":
        total = F.aggregate(F.concat(left, above), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.array_repeat(F.floor((total + SIZE) / (2 * SIZE)), SIZE * SIZE)
    at = F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1))
    row = lambda i: left[F.floor(i / SIZE).cast("int")]
    col = lambda i: above[i % SIZE]
    if mode == "vertical":
        return F.transform(at, col)
    if mode == "horizontal":
        return F.transform(at, row)

    def nearest(i: Column) -> Column:
        """Of left, above and corner the one nearest to left + above - corner, the first at equal distance."""
        dl, da, dc = F.abs(col(i) - corner), F.abs(row(i) - corner), F.abs(row(i) + col(i) - 2 * corner)
        return F.when((dl <= da) & (dl <= dc), row(i)).when(da <= dc, col(i)).otherwise(corner)

    return F.transform(at, nearest)


def intra_modes(s: DataFrame) -> DataFrame:
    """(frame, gy, gx, mode, sse): squared error of each predictor for blocks that have samples left of and above them."""
    e = _edges(s)
    err = lambda m: F.aggregate(F.zip_with("v", _predict(m, F.col("left"), F.col("above"), F.col("corner")), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    return e.select("frame", "gy", "gx", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), err(m).alias("sse")) for m in MODES])).alias("r")).select("frame", "gy", "gx", "r.*")


def short_list(modes: DataFrame, k: int) -> DataFrame:
    """The k best predictors of each block in order, as an array: at most as many as there are predictors, so a group is small."""
    rank = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode"))
    best = F.slice(F.array_sort(F.collect_list(F.struct("sse", rank.alias("at"), "mode"))), 1, k)
    return modes.groupBy("frame", "gy", "gx").agg(F.array_join(F.transform(best, lambda r: r["mode"]), ",").alias("modes"), F.min("sse").alias("sse"))
