"""Decode, crop, scale, distortion and encode of binary frames against numpy, for every kind of format."""

import time

import numpy as np
import pyarrow as pa
import pytest

from lumenweave import catalog
from lumenweave.operators import features, planes
from lumenweave.sources.video import FrameError, frame_size
from lumenweave.streaming import delays

FRAME = "path string, frame_index bigint, width int, height int, format string, data binary"
FORMATS = ("yuv420p8", "yuv422p10le", "yuv444p16le", "gray8", "gray12le", "gbrp8", "rgb24", "yuv420p12le")


def frames_of(spark, fmt, w=20, h=12, n=3):
    rng = np.random.default_rng(len(fmt))
    depth = planes.layout(fmt)[1]
    count = frame_size(w, h, fmt) // (2 if depth > 8 else 1)
    rows = [("a", k, w, h, fmt, rng.integers(0, 1 << depth, count).astype("<u2" if depth > 8 else np.uint8).tobytes()) for k in range(n)]
    return rows, spark.createDataFrame(rows, FRAME)


@pytest.mark.parametrize("fmt", FORMATS)
def test_crop_and_scale(spark, fmt):
    rows, df = frames_of(spark, fmt)
    lines = planes.decode(df)
    assert sorted(map(tuple, planes.encode(lines).collect())) == sorted(rows)
    n, _, sx, sy = planes.layout(fmt)
    got = {r["frame_index"]: bytes(r["data"]) for r in planes.encode(planes.scale(planes.crop(lines, 4, 2, 12, 8), 16, 6)).collect()}
    for _, k, w, h, _, data in rows:
        own = planes.planes_of(data, w, h, fmt)
        out = []
        for j, p in enumerate(own):
            ax, ay = (sx, sy) if j else (1, 1)
            c = p[2 // ay : 10 // ay, 4 // ax : 16 // ax]
            ow, oh = 16 // ax, 6 // ay
            out.append(c[np.arange(oh) * c.shape[0] // oh][:, np.arange(ow) * c.shape[1] // ow])
        assert got[k] == planes.bytes_of(out, fmt)


@pytest.mark.parametrize("fmt", ["yuv420p8", "yuv422p10le", "rgb24"])
def test_distortion(spark, fmt):
    rows, df = frames_of(spark, fmt)
    other = [(*r[:5], r[5] if k == 0 else bytes(len(r[5]))) for k, r in enumerate(rows)]
    got = {(r["frame_index"], r["plane"]): r for r in planes.distortion(planes.decode(df), planes.decode(spark.createDataFrame(other, FRAME))).collect()}
    peak = (1 << planes.layout(fmt)[1]) - 1
    for _, k, w, h, _, data in rows:
        for j, p in enumerate(planes.planes_of(data, w, h, fmt)):
            e = 0 if k == 0 else int((p.astype(np.int64) ** 2).sum())
            r = got[k, j]
            assert (r["sse"], r["n"]) == (e, p.size)
            assert r["psnr"] == float("inf") if e == 0 else abs(r["psnr"] - 10 * np.log10(peak * peak * p.size / e)) < 1e-9


def test_errors(spark):
    _, df = frames_of(spark, "yuv420p8")
    for bad in ((1, 0, 4, 4), (0, 0, 0, 4), (0, 0, 40, 4)):
        with pytest.raises(Exception, match="does not fit"):
            planes.crop(planes.decode(df), *bad).collect()
    with pytest.raises(FrameError):
        planes.planes_of(b"12", 4, 4, "gray8")
    with pytest.raises(FrameError):
        planes.bytes_of([np.array([[256]])], "gray8")


def batches(rows, schema, size):
    return [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + size]], schema) for k in range(0, len(rows), size)]


ARROW = pa.schema([("path", pa.string()), ("frame_index", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("format", pa.string()), ("data", pa.binary())])


def test_frames_of_all_formats_together(spark):
    """Sizes and formats mixed, no path, the same number on several paths; in any batches, lines in any order."""
    rows = [(None if k == 1 else fmt, k, w, h, fmt, np.random.default_rng(k).integers(0, 256, frame_size(w, h, fmt), np.uint8).tobytes()) for fmt in FORMATS for k, (w, h) in enumerate(((4, 2), (6, 4), (20, 12), (2, 8)))]
    rows += [("b", 0, 3, 1, "gray8", b"abc")]
    df = spark.createDataFrame(rows, FRAME)
    lines = planes.decode(df)
    want = sorted(rows, key=repr)
    assert sorted((tuple(r[:5]) + (bytes(r[5]),) for r in planes.encode(lines.repartition(5, "samples")).collect()), key=repr) == want
    for size in (1, 3, len(rows)):
        made = [r for b in planes._lines(iter(batches(rows, ARROW, size))) for r in b.to_pylist()]
        assert len(made) == lines.count()
        kept = pa.Table.from_batches(planes._packed(iter([pa.RecordBatch.from_pylist(made, pa.schema([*list(ARROW)[:5], ("plane", pa.int32()), ("y", pa.int32()), ("samples", pa.list_(pa.int32()))]))])))
        kept = kept.sort_by([(c, "ascending") for c in (*planes.KEY, "plane", "y")])
        got = [tuple(r.values()) for b in planes._joined(iter(kept.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got, key=repr) == want


def test_lines_that_do_not_make_frames(spark):
    line = lambda y=0, v=(1, 2), w=2, h=1, fmt="gray8", k=0: ("a", 1, w, h, fmt, k, y, None if v is None else list(v))
    for bad, why in (
        ([line(1)], "lacks lines"), ([line(), line()], "lacks lines"), ([line(h=2)], "lacks lines"), ([line(), line(k=1)], "lacks lines"), ([line(None)], "lacks lines"), ([line(h=4, fmt="yuv420p8", y=y) for y in range(4)], "lacks lines"),
        ([line(v=(1,))], "length"), ([line(v=(1, 2, 3))], "length"), ([line(v=(1, 256))], "does not fit"), ([line(v=(-1, 2))], "does not fit"), ([line(v=(1, 65536), fmt="gray12le")], "does not fit"),
        ([line(v=(1, None))], "lacks samples"), ([line(v=None)], "lacks samples"), ([line(fmt="gray7")], "no such format"),
    ):
        with pytest.raises(Exception, match=why):
            planes.encode(spark.createDataFrame(bad, planes.LINES)).collect()


def test_samples_cost_little():
    """Packing and joining lines costs less than it takes to make a Python number of each sample."""
    n, w = 400, 5000
    v = pa.array(np.random.default_rng(4).integers(0, 256, n * w).astype(np.int32))
    keys = [pa.array(["a"] * n), pa.array(range(n), pa.int64()), pa.array([w] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(["gray8"] * n), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int32())]
    batch = pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), v)], names=[*planes.KEY, "plane", "y", "samples"])
    began = time.process_time()
    assert sum(b.num_rows for b in planes._joined(planes._packed(iter([batch])))) == n
    took, began = time.process_time() - began, time.process_time()
    batch.to_pylist()
    assert 4 * took < time.process_time() - began


def test_round_trip_deals_out_bytes(spark):
    """What is dealt out by frame are a line's bytes; lists of numbers are neither shuffled nor gathered."""
    plan = catalog.QUERIES["planar_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def test_residual_energy_and_simple_blocks(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random((16, 24)) < 0.5, 60, 200)
    v[:, 8:16] = rng.integers(0, 256, (16, 8))
    v[8:, 16:] = rng.integers(100, 108, (8, 8))
    s = spark.createDataFrame([(0, y, x, int(v[y, x])) for y in range(16) for x in range(24)], "frame long, y long, x long, v0 long")
    for r in features.residual_energy(s, 8).collect():
        b = v[r["gy"] * 8 : r["gy"] * 8 + 8, r["gx"] * 8 : r["gx"] * 8 + 8] ** 2
        assert (r["total"], r["head"], r["tail"]) == (b.sum(), b[:4, :4].sum(), b.sum() - b[:4, :4].sum())
    near = {(r["y"], r["x"]): (r["left"], r["above"]) for r in features.neighbours(s).collect()}
    assert near[0, 0] == (None, None) and all(near[y, x] == (v[y, x - 1], v[y - 1, x]) for y in range(1, 16) for x in range(1, 24))


def test_repeats_within_a_frame(spark):
    """A block seen before in the same frame points back at the nearest earlier copy, in raster order."""
    rng = np.random.default_rng(9)
    v = rng.integers(0, 256, (16, 32))
    v[0:8, 8:16] = v[0:8, 0:8]
    v[8:16, 24:32] = v[0:8, 0:8]
    s = spark.createDataFrame([(0, y, x, int(v[y, x]), 0, 0) for y in range(16) for x in range(32)], "frame long, y long, x long, v0 long, v1 long, v2 long")
    got = {(r["gy"], r["gx"]): (r["from_gy"], r["from_gx"]) for r in features.copies_within(s, 8).collect()}
    assert got == {(0, 1): (0, 0), (1, 3): (0, 1)}
    assert features.copy_statistics(s, 8).first().asDict() == {"frame": 0, "blocks": 8, "copied": 2, "distance": 1 + 3}


def test_flush_in_order():
    """Stages that hold frames back give them up at the end of the stream, each through the stages after it."""
    held = delays.Delay(2)
    out = list(delays.chain([held, delays.Delay(1), lambda f: [f, -f]], range(5)))
    assert out == [y for x in range(5) for y in (x, -x)] and held.held == []
