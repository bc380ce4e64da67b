"""Frame algebra on rows (frame, y, x, v...): crop, scale, distortion, blocks, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def crop(s: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    return s.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def scale(s: DataFrame, was: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest sample: destination d takes d * was / to, cut. The grid's coordinates are expanded, then joined on the source's."""
    (w, h), (nw, nh) = was, to
    spark = s.sparkSession
    xs = spark.range(nw).select(F.floor(F.col("id") * w / nw).alias("x"), F.col("id").alias("nx"))
    ys = spark.range(nh).select(F.floor(F.col("id") * h / nh).alias("y"), F.col("id").alias("ny"))
    return s.join(F.broadcast(xs), "x").join(F.broadcast(ys), "y").drop("x", "y").withColumnsRenamed({"nx": "x", "ny": "y"})


def sse(a: DataFrame, b: DataFrame) -> DataFrame:
    """(frame, n, sse0, sse1, sse2) of samples at equal places."""
    two = a.join(b.withColumnsRenamed({f"v{k}": f"w{k}" for k in range(3)}), ["frame", "y", "x"])
    return two.groupBy("frame").agg(F.count("*").alias("n"), *[F.sum((F.col(f"v{k}") - F.col(f"w{k}")) * (F.col(f"v{k}") - F.col(f"w{k}"))).alias(f"sse{k}") for k in range(3)])


def psnr(distortion: DataFrame, peak: int = 255) -> DataFrame:
    """psnr0..2 and psnr_all; infinite where nothing differs."""
    value = lambda e, n: F.when(e == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(peak * peak)) * n / F.when(e != 0, e)))
    n = F.col("n")
    return distortion.select("frame", *[value(F.col(f"sse{k}"), n).alias(f"psnr{k}") for k in range(3)], value(F.col("sse0") + F.col("sse1") + F.col("sse2"), 3 * n).alias("psnr_all"))


def blocks(s: DataFrame, size: int) -> DataFrame:
    return s.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})


def histogram(s: DataFrame, size: int = 8) -> DataFrame:
    """(frame, gy, gx, v0, n, first): each full block's values, their counts and first raster place in the block. Blocks cut by an edge are left out."""
    place = (F.col("y") % size) * size + F.col("x") % size
    g = blocks(s, size).groupBy("frame", "gy", "gx", "v0").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return g.withColumn("all", F.sum("n").over(Window.partitionBy("frame", "gy", "gx"))).where(F.col("all") == size * size).drop("all")


def palette_worthy(s: DataFrame, size: int = 8) -> DataFrame:
    """(frame, gy, gx, colours, worthy) of full blocks: worthy with two to four values."""
    return histogram(s, size).groupBy("frame", "gy", "gx").agg(F.count("*").alias("colours")).withColumn("worthy", F.col("colours").between(2, 4))


def mean_sse(s: DataFrame, size: int) -> DataFrame:
    """(frame, gy, gx, mean, sse): rounded integer mean and squared error to it, both by partial aggregation:
    sum (v - m)^2 = sum v^2 - 2 m sum v + n m^2."""
    v = F.col("v0")
    g = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.count("*").alias("n"), F.sum(v).alias("t"), F.sum(v * v).alias("q"))
    m = F.floor((F.col("t") + F.floor(F.col("n") / 2)) / F.col("n"))
    return g.withColumn("mean", m).select("frame", "gy", "gx", "mean", (F.col("q") - 2 * F.col("mean") * F.col("t") + F.col("n") * F.col("mean") * F.col("mean")).alias("sse"))


def split_gain(s: DataFrame, size: int) -> DataFrame:
    """What quartering a full block saves in squared error, not under zero. Blocks cut by an edge are left out."""
    kids = mean_sse(s, size // 2).groupBy("frame", F.floor(F.col("gy") / 2).alias("gy"), F.floor(F.col("gx") / 2).alias("gx")).agg(F.sum("sse").alias("kids"))
    n = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.count("*").alias("n")).where(F.col("n") == size * size)
    return mean_sse(s, size).join(n, ["frame", "gy", "gx"], "left_semi").join(kids, ["frame", "gy", "gx"]).select("frame", "gy", "gx", F.greatest(F.lit(0), F.col("sse") - F.col("kids")).alias("gain"))


def repeated_frames(s: DataFrame) -> DataFrame:
    """(frame, same): whether a frame equals the one before it. Frames are named by a digest of their samples in raster order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v0", "v1", "v2"))), lambda r: F.concat_ws(",", r["v0"].cast("string"), r["v1"].cast("string"), r["v2"].cast("string"))), ";")
    named = s.groupBy("frame").agg(F.sha2(text, 256).alias("d"))
    return named.select("frame", F.coalesce(F.col("d") == F.lag("d").over(Window.orderBy("frame")), F.lit(False)).alias("same"))


def motion(s: DataFrame, size: int = 8, most: int = 8) -> DataFrame:
    """(frame, gy, gx, from_gy, from_gx): blocks of the frame before with equal samples, nearest first, joined on content.

    A content that more than `most` blocks of a frame have is no candidate.
    """
    place = (F.col("y") % size) * size + F.col("x") % size
    body = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("v0"), F.col("v1"), F.col("v2")))), lambda r: F.struct(r["v0"], r["v1"], r["v2"]))
    own = blocks(s, size).groupBy("frame", "gy", "gx").agg(F.sha2(F.to_json(body), 256).alias("d"))
    rare = own.groupBy("frame", "d").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("frame", "d")
    was = own.join(rare, ["frame", "d"]).select((F.col("frame") + 1).alias("frame"), "d", F.col("gy").alias("from_gy"), F.col("gx").alias("from_gx"))
    far = F.abs(F.col("gy") - F.col("from_gy")) + F.abs(F.col("gx") - F.col("from_gx"))
    best = own.join(was, ["frame", "d"]).groupBy("frame", "gy", "gx").agg(F.min(F.struct(far.alias("far"), "from_gy", "from_gx")).alias("m"))
    return best.select("frame", "gy", "gx", "m.from_gy", "m.from_gx")


def deltas(s: DataFrame, size: int, across: bool = True) -> DataFrame:
    """Differences to the left (or upper) sample of the block, the first to 128."""
    step, fixed = ("x", "y") if across else ("y", "x")
    w = Window.partitionBy("frame", fixed, F.floor(F.col(step) / size)).orderBy(step)
    return s.select("frame", "y", "x", (F.col("v0") - F.coalesce(F.lag("v0").over(w), F.lit(128))).alias("d"))


def sad(a: DataFrame, b: DataFrame, size: int = 8) -> DataFrame:
    """(frame, gy, gx, sad): summed absolute differences of blocks."""
    two = a.join(b.select("frame", "y", "x", F.col("v0").alias("w0")), ["frame", "y", "x"])
    return blocks(two, size).groupBy("frame", "gy", "gx").agg(F.sum(F.abs(F.col("v0") - F.col("w0"))).alias("sad"))


def cells(spark, w: int, h: int, size: int) -> DataFrame:
    """The grid of coding units: address, x, y, w, h, clipped at the edges."""
    cols, rows = -(-w // size), -(-h // size)
    i = F.col("id")
    g = spark.range(cols * rows).select(i.alias("address"), ((i % cols) * size).alias("x"), (F.floor(i / cols) * size).alias("y"))
    return g.select("address", "x", "y", F.least(F.lit(size), w - F.col("x")).alias("w"), F.least(F.lit(size), h - F.col("y")).alias("h"))
