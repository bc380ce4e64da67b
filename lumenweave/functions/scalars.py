"""Scalar functions as column expressions: formats, rates, scores, labels, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLINGS = ("400", "420", "422", "444")


def max_sample(depth: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), depth) - 1


def convert_depth(v: Column, was: int, to: int) -> Column:
    """Rounded rescale of a sample between bit depths; samples above the source's largest count as it."""
    a, b = (1 << was) - 1, (1 << to) - 1
    return F.floor((F.least(v, F.lit(a)) * b + a // 2) / a).cast("long")


def frame_bytes(w: Column, h: Column, sampling: Column, depth: Column) -> Column:
    """Bytes of a frame: sampling is '400', '420', '422', '444' or 'rgb'."""
    luma = w * h
    chroma = F.when(sampling == "420", F.floor(luma / 4)).when(sampling == "422", F.floor(luma / 2)).when(sampling.isin("444", "rgb"), luma).otherwise(0)
    return ((luma + 2 * chroma) * F.when(depth > 8, 2).otherwise(1)).cast("long")


def bitrate_kbps(size: Column, frames: Column, fps: Column) -> Column:
    """Null without a positive rate or frames."""
    return F.when((fps > 0) & (frames > 0), size * 8 / (frames / fps) / 1000)


def _finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _rate(c: Column) -> Column:
    return _finite(c) & F.coalesce(c > 0, F.lit(False))


def tradeoff_score(fps_ratio: Column, byte_ratio: Column, d_psnr: Column) -> Column:
    """Each term counts only where it is finite, and positive if a ratio; null where no term counts."""
    term = lambda c, x: F.coalesce(F.when(c, x), F.lit(0.0))
    score = term(_rate(fps_ratio), 10 * F.log2(fps_ratio)) + term(_rate(byte_ratio), 4 * F.log2(1 / byte_ratio)) + term(_finite(d_psnr), 8 * d_psnr)
    return F.when(_rate(fps_ratio) | _rate(byte_ratio) | _finite(d_psnr), score)


def tradeoff_status(score: Column, fps_ratio: Column, byte_ratio: Column, d_psnr: Column) -> Column:
    """Hard regressions first, then by score; what is watched is never accepted outright. A term that does not count in the score decides nothing; null without a score."""
    hard = (_rate(fps_ratio) & (fps_ratio < 0.90)) | (_rate(byte_ratio) & (byte_ratio > 1.20)) | (_finite(d_psnr) & (d_psnr < -1.0))
    watched = (_finite(d_psnr) & (d_psnr < -0.30)) | (_rate(byte_ratio) & (byte_ratio > 1.05))
    fast = ~_rate(fps_ratio) | (fps_ratio >= 1.10)
    return F.when(score.isNull(), None).when(hard, "regress").when((score >= 2) & fast, F.when(watched, "watch").otherwise("accept")).when(score >= 0, "watch").otherwise("regress")


def parse_pixel_format(text: Column) -> Column:
    """(sampling, depth) of a planar format name, null where it is none: yuv420p, i420, gray8, yuv422p10le, gbrp8, rgb24."""
    t = F.lower(F.trim(text))
    t = F.when(t == "i420", "yuv420p8").when(t == "y8", "gray8").when(t.isin("gbrp", "rgb24"), "gbrp8").otherwise(t)
    t = F.regexp_replace(t, "^i0(\\d\\d)$", "yuv420p$1")
    layout = F.regexp_extract(t, "^(yuv420p|yuv422p|yuv444p|gray|gbrp)(\\d*)(le)?$", 1)
    digits = F.regexp_extract(t, "^(yuv420p|yuv422p|yuv444p|gray|gbrp)(\\d*)(le)?$", 2)
    depth = F.when(digits == "", 8).when(F.length(digits) < 4, digits.try_cast("int"))
    sampling = F.when(layout == "gray", "400").when(layout == "gbrp", "rgb").otherwise(F.substring(layout, 4, 3))
    return F.when((layout != "") & depth.between(8, 16), F.struct(sampling.alias("sampling"), depth.alias("depth")))


def base_qindex(qp: Column) -> Column:
    return F.least(F.lit(255), F.ceil(qp * 10 / 3)).cast("int")


def exp_golomb(v: Column) -> Column:
    """Unsigned exponential Golomb code as a string of bits."""
    b = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def signed_exp_golomb(v: Column) -> Column:
    return exp_golomb(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def leb128(v: Column) -> Column:
    """Hex of the little-endian base-128 code of a value under 2^63."""
    n = F.greatest(F.lit(1), F.floor((F.length(F.bin(v)) + 6) / 7)).cast("int")
    group = lambda k: F.call_function("shiftrightunsigned", v, (7 * (k - 1)).cast("int")).bitwiseAND(F.lit(127)) + F.when(k < n, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.lpad(F.hex(group(k)), 2, "0")), "")
