"""Fixture vectors: crops of sources, pictures as planes, sweeps of drawn crops, discovery of statistics files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators.frames import crop


class PictureError(ValueError):
    """A picture that is not 8-bit colour without interlacing, or not whole."""


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) red, green, blue of an 8-bit colour PNG; its alpha is dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PictureError("no PNG")
    at, head, body = 8, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise PictureError("8-bit colour without interlacing is wanted")
    w, h, n = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if len(raw) != h * (1 + w * n):
        raise PictureError("not the announced size")
    raw = raw.reshape(h, 1 + w * n)
    out, up = np.zeros((h, w, n), np.int64), np.zeros((w, n), np.int64)
    for y in range(h):
        x = raw[y, 1:].reshape(w, n).astype(np.int64)
        kind = raw[y, 0]
        if kind == 0:
            row = x
        elif kind == 1:
            row = np.cumsum(x, 0) & 255
        elif kind == 2:
            row = (x + up) & 255
        else:
            row, left, corner = np.zeros_like(x), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(w):
                if kind == 3:
                    guess = (left + up[i]) >> 1
                elif kind == 4:
                    near = np.stack([left, up[i], corner])
                    guess = near[np.abs(near - (left + up[i] - corner)).argmin(0), np.arange(n)]
                else:
                    raise PictureError("no such filter")
                left, corner = (x[i] + guess) & 255, up[i]
                row[i] = left
        out[y] = up = row
    return out[..., :3]


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, y, x, v0, v1, v2) of PNG files: green, blue and red are the three planes. A file is one task's work and is given out by rows of samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = decode_png(data)
                h, w, _ = p.shape
                step = max(1, 65536 // max(w, 1))
                for y in range(0, h, step):
                    part = p[y : y + step].reshape(-1, 3)
                    i = np.arange(len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(i * 0), pa.array(y + i // w), pa.array(i % w), *[pa.array(part[:, k]) for k in (1, 2, 0)]], names=["path", "frame", "y", "x", "v0", "v1", "v2"])

    return files.mapInArrow(run, "path string, frame long, y long, x long, v0 long, v1 long, v2 long")


def source_crop(s: DataFrame, x: int, y: int, w: int, h: int, depth: int = 8, canary: bool = False) -> DataFrame:
    """A crop of the first frame at a depth: samples are shifted up, and with `canary` their low bits are filled so that a lost bit shows."""
    if canary and depth <= 8:
        raise ValueError("a canary needs more than eight bits")
    shift = depth - 8
    out = crop(s.where("frame = 0"), x, y, w, h)
    if shift == 0:
        return out
    col, row, mask = F.col("x"), F.col("y"), (1 << shift) - 1
    low = lambda k: (col % 4).bitwiseOR((row % 4) * 4).bitwiseOR(F.lit(2 * k)).bitwiseAND(F.lit(mask)).cast("long")
    fill = lambda k: F.when(low(k) == 0, mask).otherwise(low(k)) if canary else F.lit(0)
    return out.withColumns({f"v{k}": (F.col(f"v{k}") * (1 << shift) + fill(k)).cast("long") for k in range(3)})


def _draw(seed: int, what: str, below: Column) -> Column:
    """A whole number from 0 to below - 1, by a digest of seed, source, size and purpose."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("w").cast("string"), F.col("h").cast("string"), F.lit(what)).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % below


def crop_sweep(sources: DataFrame, seed: int = 1, most: int = 64) -> DataFrame:
    """(source, w, h, start, x, y, name, place): a drawn crop of every size 8, 16, ... most by the same, of each source (source, width, height, frames,
    sampling), with two frames to follow, at an origin that its chroma allows. place is the drawn order. A source under three frames or smaller than a crop ends the query."""
    sizes = F.sequence(F.lit(8), F.lit(most), F.lit(8))
    s = sources.select("*", F.explode(sizes).alias("w")).select("*", F.explode(sizes).alias("h"))
    good = (F.col("frames") >= 3) & (F.col("width") >= F.col("w")) & (F.col("height") >= F.col("h"))
    s = s.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too short or small: "), "source")).cast("boolean")))
    ax, ay = F.when(F.col("sampling").isin("420", "422"), 2).otherwise(1), F.when(F.col("sampling") == "420", 2).otherwise(1)
    slots = lambda side, n, a: F.floor((F.col(side) - F.col(n)) / a) + 1
    s = s.select("source", "w", "h", _draw(seed, "start", F.col("frames") - 2).alias("start"), (_draw(seed, "x", slots("width", "w", ax)) * ax).alias("x"), (_draw(seed, "y", slots("height", "h", ay)) * ay).alias("y"), _draw(seed, "place", F.lit(1 << 31)).alias("place"))
    return s.withColumn("name", F.format_string("%s_%dx%d_f%03d_x%04d_y%04d", "source", "w", "h", "start", "x", "y"))


def statistics_files(spark: SparkSession, folder: str, matrix: DataFrame, codecs: list[str]) -> DataFrame:
    """(path, codec, mode, vector, format, named): the statistics files of a run: those that rows of `matrix` (path, codec, mode, vector, format) name and
    that are there, then the others under stats/ whose name begins with a codec. What a row does not say is read from the file's name."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    named = matrix.where("path is not null").dropDuplicates(["path"]).withColumn("named", F.lit(True))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.]jsonl$", "")
    first = F.when(stem.contains("_"), F.substring_index(stem, "_", 1)).otherwise("unknown")
    mode = F.when(stem.contains("_lossless_"), "lossless").when(stem.contains("_lossy_"), "lossy").otherwise("unknown")
    both = there.join(named, "path", "left")
    named_ = F.coalesce("named", F.lit(False))
    both = both.where(named_ | (F.col("path").rlike("/stats/[^/]*$") & first.isin(*codecs)))
    return both.select("path", F.coalesce("codec", first).alias("codec"), F.coalesce("mode", mode).alias("mode"), F.coalesce("vector", stem).alias("vector"), F.coalesce("format", F.lit("")).alias("format"), named_.alias("named"))
