"""Binary frames as lines of planes and back: crop, scale and distortion for every format, chroma at its own size.

`decode` gives a row for each line of each plane, so work on it is Spark's own: a crop filters lines and slices arrays, a scale
picks lines by a small table of their places, distortion zips lines. Only decoding and encoding run in Arrow batches, many frames at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.sources.video import FrameError, frame_size

KEY = ("path", "frame_index", "width", "height", "format")
LINES = "path string, frame_index bigint, width int, height int, format string, plane int, y int, samples array<int>"
PACKED = LINES.replace("samples array<int>", "line binary")
FRAMES = "path string, frame_index bigint, width int, height int, format string, data binary"
SAMPLES = 1 << 20  # fixed value: samples of lines that are given on at once, or one frame's


def layout(fmt: str) -> tuple[int, int, int, int]:
    """(planes, bits of a sample, columns and lines of luma for one of chroma); rgb24 has three interleaved planes, gbrp8 three in a row."""
    if fmt in ("rgb24", "gbrp8"):
        return 3, 8, 1, 1
    m = re.fullmatch(r"(yuv420p|yuv422p|yuv444p|gray)(\d+)(?:le)?", fmt)
    if not m or not 8 <= int(m[2]) <= 16:
        raise FrameError(f"no such format: {fmt}")
    return 1 if m[1] == "gray" else 3, int(m[2]), 2 if m[1] in ("yuv420p", "yuv422p") else 1, 2 if m[1] == "yuv420p" else 1


def planes_of(data: bytes | pa.Buffer, w: int, h: int, fmt: str) -> list[np.ndarray]:
    """The planes of a frame, each an array of lines."""
    n, depth, sx, sy = layout(fmt)
    if len(data) != frame_size(w, h, fmt):
        raise FrameError(f"a frame of {w}x{h} {fmt} has {frame_size(w, h, fmt)} bytes, not {len(data)}")
    v = np.frombuffer(data, "<u2" if depth > 8 else np.uint8)
    if fmt == "rgb24":
        return [v[k::3].reshape(h, w) for k in range(3)]
    out, at = [], 0
    for k in range(n):
        pw, ph = (w // sx, h // sy) if k else (w, h)
        out.append(v[at : at + pw * ph].reshape(ph, pw))
        at += pw * ph
    return out


def bytes_of(planes: list[np.ndarray], fmt: str) -> bytes:
    """The frame of its planes. A sample beyond the format's bytes raises."""
    depth = layout(fmt)[1]
    kind, most = ("<u2", 65535) if depth > 8 else (np.uint8, 255)
    if any(p.size and (p.min() < 0 or p.max() > most) for p in planes):
        raise FrameError(f"a sample does not fit {fmt}")
    if fmt == "rgb24":
        return np.stack(planes, -1).astype(kind).tobytes()
    return b"".join(p.astype(kind).tobytes() for p in planes)


def decode(frames: DataFrame) -> DataFrame:
    """LINES of frames (path, frame_index, width, height, format, data). Frames whose bytes do not fit their size and format raise."""
    return frames.select(*KEY, "data").mapInArrow(_lines, LINES)


def encode(lines: DataFrame) -> DataFrame:
    """Frames (path, frame_index, width, height, format, data) of LINES. Missing lines, and lines of another length, raise.

    Lines are packed to bytes before they are dealt out by frame, and come sorted, so a frame's bytes are those of its lines as they stand; only rgb24 is woven.
    """
    packed = lines.select(*KEY, "plane", "y", "samples").mapInArrow(_packed, PACKED)
    order = ("frame_index", *(c for c in KEY if c != "frame_index"), "plane", "y")
    return packed.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(_joined, FRAMES)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = list(zip(*(batch.column(c).to_pylist() for c in range(2, 5)), strict=True))
        held, rows, size = [], [], 0
        for r, (w, h, fmt) in enumerate(dims):
            planes = planes_of(batch.column(5)[r].as_buffer(), w, h, fmt)
            held.append(planes)
            rows.append(r)
            size += sum(p.size for p in planes)
            if size >= SAMPLES or r == len(dims) - 1:
                yield _lines_of(batch, rows, held)
                held, rows, size = [], [], 0


def _lines_of(batch: pa.RecordBatch, rows: list[int], held: list[list[np.ndarray]]) -> pa.RecordBatch:
    flat = [p for planes in held for p in planes]
    high, wide = (np.array([p.shape[k] for p in flat], np.int64) for k in (0, 1))
    plane = np.array([k for planes in held for k in range(len(planes))], np.int32)
    y = np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
    ends = np.concatenate([[0], np.cumsum(np.repeat(wide, high))]).astype(np.int32)
    samples = np.concatenate([p.reshape(-1) for p in flat], dtype=np.int32, casting="unsafe")
    of = pa.array(np.repeat(np.repeat(rows, [len(planes) for planes in held]), high))
    cols = [batch.column(c).take(of) for c in range(5)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(plane, high)), pa.array(y.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(samples))], names=[*KEY, "plane", "y", "samples"])


def _layouts(fmt: pa.Array) -> np.ndarray:
    """`layout` of each row, a row for each of its values."""
    coded = fmt.dictionary_encode(null_encoding="encode")
    known = np.array([layout(f) for f in coded.dictionary.to_pylist()], np.int64).reshape(-1, 4)
    return known[coded.indices.to_numpy()].T


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their samples as bytes. A sample beyond the format's bytes raises."""
    for batch in batches:
        if not batch.num_rows:
            continue
        samples = batch.column(7)
        v = samples.flatten()
        if samples.null_count or v.null_count:
            raise FrameError("a line lacks samples")
        v, n, deep = v.to_numpy(), pc.list_value_length(samples).to_numpy().astype(np.int64), _layouts(batch.column(4))[1] > 8
        at, parts = np.concatenate([[0], np.cumsum(n)]), []
        turns = np.flatnonzero(np.diff(deep, prepend=~deep[:1]))
        for a, b in zip(turns, [*turns[1:], len(n)], strict=True):
            part = v[at[a] : at[b]]
            kind, most = ("<u2", 65535) if deep[a] else (np.uint8, 255)
            if part.size and (part.min() < 0 or part.max() > most):
                raise FrameError(f"a sample does not fit {batch.column(4)[int(a)].as_py()}")
            parts.append(part.astype(kind).view(np.uint8))
        ends = np.concatenate([[0], np.cumsum(n * (1 + deep))])
        data = np.concatenate(parts)
        lines = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(7)), lines], names=[*KEY, "plane", "y", "line"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of lines that come frame by frame; a frame may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch)
        if held and _key(batch, 0) != _key(held[0], 0):
            yield _frames_of(held)
            held = []
        if len(starts) > 1:
            last = int(starts[-1])
            yield _frames_of([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield _frames_of(held)


def _key(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in range(5))


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The first rows of frames."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in range(5):
        col = rows.column(c)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        code = col.dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _frames_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    starts = _starts(t)
    counts = np.diff(starts, append=t.num_rows)
    keys = [t.column(c).combine_chunks().take(pa.array(starts)) for c in range(5)]
    if keys[2].null_count or keys[3].null_count:
        raise FrameError("a frame has no size")
    w, h = (keys[c].to_numpy().astype(np.int64) for c in (2, 3))
    n, depth, sx, sy = _layouts(keys[4])
    chroma = np.where(n > 1, h // sy, 0)
    # what each line must be, by its place in its frame
    i = np.arange(t.num_rows) - np.repeat(starts, counts)
    each = lambda v: np.repeat(v, counts)
    luma, step = i < each(h), np.maximum(each(chroma), 1)
    plane, y = np.where(luma, 0, 1 + (i - each(h)) // step), np.where(luma, i, (i - each(h)) % step)
    said_plane, said_y = (t.column(c).combine_chunks().fill_null(-1).to_numpy() for c in (5, 6))
    lacks = np.zeros(len(starts), bool)
    lacks[np.repeat(np.arange(len(starts)), counts)[(plane != said_plane) | (y != said_y)]] = True
    lacks |= counts != h + (n - 1) * chroma
    if lacks.any():
        bad = int(np.flatnonzero(lacks)[0])
        raise FrameError(f"frame {keys[1][bad].as_py()} of {keys[0][bad].as_py()} lacks lines")
    lines = t.column(7).combine_chunks().cast(pa.binary())
    wide = np.where(luma, each(w), each(w // sx)) * each(np.where(depth > 8, 2, 1))
    if (pc.binary_length(lines).to_numpy() != wide).any():
        raise FrameError("a line has not the length of its plane")
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    ends = ends[np.append(starts, len(lines))]
    data = lines.buffers()[2]
    woven = np.flatnonzero(pc.equal(keys[4], "rgb24").to_numpy(zero_copy_only=False))
    if len(woven):
        v = np.frombuffer(data, np.uint8).copy()
        for k in woven:
            v[ends[k] : ends[k + 1]] = v[ends[k] : ends[k + 1]].reshape(3, -1).T.reshape(-1).copy()
        data = pa.py_buffer(v)
    out = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])
    return pa.RecordBatch.from_arrays([*keys, out], names=[*KEY, "data"])


def _steps(plane: Column, fmt: Column) -> tuple[Column, Column]:
    """Columns and lines of luma for one sample of the plane."""
    sx = F.when((plane > 0) & fmt.rlike("^yuv42[02]p"), 2).otherwise(1)
    return sx, F.when((plane > 0) & fmt.startswith("yuv420p"), 2).otherwise(1)


def crop(lines: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The window at x, y of luma, chroma by its own step. Filters and slices; no shuffle. A window that is empty, outside or between chroma samples raises."""
    sx, sy = _steps(F.col("plane"), F.col("format"))
    odd = F.col("format").rlike("^yuv42[02]p") & F.lit(bool(x % 2 or w % 2)) | F.col("format").startswith("yuv420p") & F.lit(bool(y % 2 or h % 2))
    bad = odd | F.lit(min(x, y) < 0 or min(w, h) <= 0) | (F.col("width") < x + w) | (F.col("height") < y + h)
    lines = lines.withColumn("width", F.when(bad, F.raise_error(F.lit("the crop does not fit the frame")).cast("int")).otherwise(F.col("width")))
    top = (F.lit(y) / sy).cast("int")
    kept = lines.where((F.col("y") >= top) & (F.col("y") < top + (F.lit(h) / sy).cast("int")))
    samples = F.slice("samples", (F.lit(x) / sx).cast("int") + 1, (F.lit(w) / sx).cast("int"))
    return kept.select("path", "frame_index", (F.lit(w) + F.col("width") * 0).alias("width"), F.lit(h).alias("height"), "format", "plane", (F.col("y") - top).alias("y"), samples.alias("samples"))


def scale(lines: DataFrame, w: int, h: int) -> DataFrame:
    """Nearest-sample scale of every plane: sample i of n comes from i * was div n. No shuffle: a line gives the lines that are taken from it."""
    sx, sy = _steps(F.col("plane"), F.col("format"))
    ow, oh = (F.lit(w) / sx).cast("int"), (F.lit(h) / sy).cast("int")
    ih, iw = F.floor(F.col("height") / sy).cast("int"), F.size("samples")
    # the target lines taken from line y are those t with t * ih div oh = y
    first, last = F.ceil(F.col("y") * oh / ih).cast("int"), (F.ceil((F.col("y") + 1) * oh / ih) - 1).cast("int")
    taken = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    own = F.transform(F.sequence(F.lit(0), ow - 1), lambda i: F.get("samples", F.floor(i * iw / ow).cast("int")))
    return lines.select("path", "frame_index", F.lit(w).alias("width"), F.lit(h).alias("height"), "format", "plane", F.explode(taken).alias("y"), own.alias("samples"))


def distortion(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, frame_index, plane, n, sse, psnr of each plane that both have, psnr infinite where nothing differs."""
    on = ["path", "frame_index", "plane", "y"]
    both = a.select(*on, "format", F.col("samples").alias("p")).join(b.select(*on, F.col("samples").alias("q")), on)
    line = F.aggregate(F.zip_with("p", "q", lambda u, v: (u - v).cast("long") * (u - v)), F.lit(0).cast("long"), lambda s, v: s + v)
    digits = F.regexp_extract("format", "p?(\\d+)(le)?$", 1)
    depth = F.when(F.col("format") == "rgb24", 8).otherwise(digits.try_cast("int"))
    out = both.groupBy("path", "frame_index", "plane").agg(F.sum(F.size("p")).alias("n"), F.sum(line).alias("sse"), F.max(depth).alias("depth"))
    peak = F.pow(F.lit(2.0), "depth") - 1
    psnr = F.when(F.col("sse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak * F.col("n") / F.when(F.col("sse") != 0, F.col("sse"))))
    return out.select("path", "frame_index", "plane", "n", "sse", psnr.alias("psnr"))
