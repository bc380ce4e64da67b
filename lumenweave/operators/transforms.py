"""4 x 4 block transforms in Arrow batches: integer Walsh-Hadamard and cosine both ways, quantisation, running sums with saturation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: step of the quantiser for index 0 to 24; every 24 more double it
STEPS = (64, 40, 41, 43, 44, 45, 47, 48, 49, 51, 52, 54, 55, 57, 59, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78)
# fixed values: largest quantiser index by bit depth
LAST_INDEX = {8: 255, 10: 303, 12: 351}
# fixed values: rows are basis functions, forward in units of 2^-14, inverse in units of 2^-7
FORWARD = np.array([[11585, 11585, 11585, 11585], [15137, 6270, -6270, -15137], [11585, -11585, -11585, 11585], [6270, -15137, 15137, -6270]])
INVERSE = np.array([[64, 64, 64, 64], [83, 35, -35, -83], [64, -64, -64, 64], [35, -83, 83, -35]])


def _lift(a, b, c, d):
    """One forward lifting step on four lines."""
    s, t = a + b, d - c
    e = (s - t) >> 1
    p, q = e - b, e - c
    return s - q, q, t + p, p


def _drop(a, c, d, b):
    """Undoes _lift."""
    s, t = a + c, d - b
    e = (s - t) >> 1
    b, c = e - b, e - c
    return s - b, b, c, t + c


def forward_wht(x: np.ndarray, unit: int = 8) -> np.ndarray:
    """x: (n, 4, 4) integers; columns, then rows, times unit."""
    x = np.stack(_lift(*(x[:, k, :] for k in range(4))), 1)
    return np.stack(_lift(*(x[:, :, k] for k in range(4))), 2) * unit


def inverse_wht(y: np.ndarray, unit_bits: int = 3) -> np.ndarray:
    y = y >> unit_bits
    y = np.stack(_drop(*(y[:, :, k] for k in range(4))), 2)
    return np.stack(_drop(*(y[:, k, :] for k in range(4))), 1)


def quantise(c: np.ndarray, step: int) -> np.ndarray:
    """Dead-zone quantiser: magnitudes are rounded down after half a step less an eighth."""
    return np.sign(c) * ((np.abs(c) + step * 3 // 8) // step)


def _rounded(v: np.ndarray, bits: int) -> np.ndarray:
    return (v + (1 << (bits - 1))) >> bits


def forward_dct(x: np.ndarray) -> np.ndarray:
    """x: (n, 4, 4) integers; columns, then rows. Samples are scaled by 16, and a first sample that is not zero by one more."""
    x = x.astype(np.int64) * 16
    x[:, 0, 0] += x[:, 0, 0] != 0
    down = _rounded(FORWARD @ x, 14)
    return (_rounded(down @ FORWARD.T, 14) + 1) >> 2


def inverse_dct(c: np.ndarray, depth: int = 8) -> np.ndarray:
    """Rows, then columns, held to the range of the depth after each."""
    wide, narrow = 1 << (depth + 7), 1 << depth
    across = np.clip(_rounded(np.clip(c.astype(np.int64), -wide, wide - 1) @ INVERSE, 7), -wide, wide - 1)
    return np.clip(_rounded(INVERSE.T @ across, 10), -narrow, narrow - 1)


def step_size(index: int, depth: int = 8) -> int:
    i = min(max(index, 1), LAST_INDEX[depth])
    return STEPS[i] if i < len(STEPS) else STEPS[(i - 1) % 24 + 1] << ((i - 1) // 24)


def levels(c: np.ndarray, step: int) -> np.ndarray:
    """Coefficients to levels by a reciprocal of 20 bits; under a sixteenth of the step they are zero."""
    a = np.abs(c.astype(np.int64))
    return np.sign(c) * np.where(a * 16 >= step, ((a + (64 * step >> 10)) * ((1 << 23) // step)) >> 20, 0)


def from_levels(q: np.ndarray, step: int) -> np.ndarray:
    return np.sign(q) * _rounded(np.abs(q.astype(np.int64)) * step, 3)


def bdpcm(levels: np.ndarray) -> np.ndarray:
    """Running sums along the last axis, held to 16 bits at each step."""
    out, total = np.empty_like(levels), np.zeros(levels.shape[:-1], levels.dtype)
    for k in range(levels.shape[-1]):
        total = np.clip(total + levels[..., k], -32768, 32767)
        out[..., k] = total
    return out


def _blocks(samples: DataFrame) -> DataFrame:
    """(frame, gy, gx, b array of 16) of each full 4 x 4 block of v0."""
    place = (F.col("y") % 4) * 4 + F.col("x") % 4
    g = samples.groupBy("frame", F.floor(F.col("y") / 4).alias("gy"), F.floor(F.col("x") / 4).alias("gx")).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("v0").alias("v")))).alias("b"))
    return g.where(F.size("b") == 16).select("frame", "gy", "gx", F.transform("b", lambda r: r["v"]).alias("b"))


def _column(a: np.ndarray) -> pa.Array:
    return pa.array(list(a.reshape(-1, 16)), pa.list_(pa.int64()))


def block_coefficients(samples: DataFrame) -> DataFrame:
    """(frame, gy, gx, c array of 16): transform of each full 4 x 4 block of v0, less 128, and whether it inverts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(3).flatten().to_numpy().reshape(-1, 4, 4).astype(np.int64) - 128
            y = forward_wht(x)
            ok = (inverse_wht(y) == x).all((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _column(y), pa.array(ok)], names=["frame", "gy", "gx", "c", "exact"])

    return _blocks(samples).mapInArrow(run, "frame long, gy long, gx long, c array<long>, exact boolean")


def block_levels(samples: DataFrame, index: int, depth: int = 8) -> DataFrame:
    """(frame, gy, gx, c, q, sse): cosine transform of each full block less the middle value, its levels, and the squared error they leave."""
    step, middle = step_size(index, depth), 1 << (depth - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(3).flatten().to_numpy().reshape(-1, 4, 4).astype(np.int64) - middle
            c = forward_dct(x)
            q = levels(c, step)
            sse = ((inverse_dct(from_levels(q, step), depth) - x) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _column(c), _column(q), pa.array(sse)], names=["frame", "gy", "gx", "c", "q", "sse"])

    return _blocks(samples).mapInArrow(run, "frame long, gy long, gx long, c array<long>, q array<long>, sse long")
