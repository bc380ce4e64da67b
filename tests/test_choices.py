"""Predictors, choices, configurations and fixtures against plain versions."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenweave.operators import choice, predictors
from lumenweave.sources import fixtures


def blended(block, top, left, w, h):
    if min(w, h) < 4:
        return block
    scale = (w.bit_length() - 1 - 2 + h.bit_length() - 1 - 2 + 2) >> 2
    out = []
    for i, v in enumerate(block):
        y, x = divmod(i, w)
        out.append(min(255, max(0, v + ((32 >> min(31, x * 2 >> scale)) * (left[y] - v) + (32 >> min(31, y * 2 >> scale)) * (top[x] - v) + 32 >> 6))))
    return out


def test_blocks(spark):
    rnd = random.Random(2)
    for w, h in ((4, 4), (8, 4), (4, 16), (16, 16), (2, 8)):
        rows = [([rnd.randrange(256) for _ in range(w + 2)], [rnd.randrange(256) for _ in range(h + 2)], rnd.randrange(256)) for _ in range(4)]
        top, left = F.col("top"), F.col("left")
        got = spark.createDataFrame(rows, "top array<long>, left array<long>, corner long").select("*", predictors.mean_block(top, left, w, h).alias("mean"), predictors.plane_block(top, left, w, h).alias("plane"), predictors.plane_block(top, left, w, h, corner=F.col("corner")).alias("smooth")).collect()
        for r in got:
            t, s = r["top"], r["left"]
            used = t[:w] + s[:h] if w == h else t[:w] if w > h else s[:h]
            assert r["mean"] == blended([(sum(used) + len(used) // 2) // len(used)] * (w * h), t, s, w, h)

            def plane(t, s):
                n = (w * h).bit_length() - 1
                block = [(((w - 1 - x) * s[y] + (x + 1) * t[w]) * h + ((h - 1 - y) * t[x] + (y + 1) * s[h]) * w + w * h) >> (n + 1) for y in range(h) for x in range(w)]  # noqa: B023
                return blended(block, t, s, w, h)  # noqa: B023

            assert r["plane"] == plane(t, s)
            if w * h > 32:
                c = r["corner"]
                t, s = ([((a[i - 1] if i else c) + 2 * a[i] + a[i + 1] + 2) >> 2 for i in range(len(a) - 1)] for a in (t, s))  # noqa: B023
            assert r["smooth"] == plane(t, s)


def test_chroma_line(spark):
    rnd = random.Random(4)
    rows = [([],), ([(5, 9), (5, 9), (5, 9), (5, 9)],)] + [([(rnd.randrange(0, 256, 1 + k % 90), rnd.randrange(256)) for _ in range(rnd.choice((2, 4)))],) for k in range(200)]
    got = spark.createDataFrame(rows, "p array<struct<l:long,c:long>>").select("p", predictors.chroma_line(F.col("p")).alias("r"), predictors.on_line(F.array(*[F.lit(v).cast("long") for v in (0, 100, 255)]), predictors.chroma_line(F.col("p"))).alias("c")).collect()
    for r in got:
        p, (a, b, k) = [tuple(x) for x in r["p"]], r["r"]
        if not p:
            assert (a, b, k) == (0, 128, 0) and r["c"] == [128] * 3
            continue
        if len(p) == 2:
            p = [p[1], p[0], p[1], p[0]]
        lo, hi = [0, 2], [1, 3]
        if p[lo[0]][0] > p[lo[1]][0]:
            lo.reverse()
        if p[hi[0]][0] > p[hi[1]][0]:
            hi.reverse()
        if p[lo[0]][0] > p[hi[1]][0]:
            lo, hi = hi, lo
        if p[lo[1]][0] > p[hi[0]][0]:
            lo[1], hi[0] = hi[0], lo[1]
        (l0, c0), (l1, c1) = [tuple((p[g[0]][j] + p[g[1]][j] + 1) >> 1 for j in (0, 1)) for g in (lo, hi)]
        if l1 <= l0:
            assert (a, b, k) == (0, c0, 0)
            continue
        assert abs((a * l0 >> k) + b - c0) == 0 and k >= 1
        if a not in (15, -15):  # the slope is near the true one
            assert abs(a / 2**k - (c1 - c0) / (l1 - l0)) <= 0.13 * abs((c1 - c0) / (l1 - l0)) + 2**-k
        assert r["c"] == [min(255, max(0, (a * v >> k) + b)) for v in (0, 100, 255)]


def test_template(spark):
    rows = [(list(range(8)), list(range(10, 18))), (list(range(16)), []), ([], list(range(4))), ([], []), (list(range(2)), list(range(10, 12)))]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<long>, l array<long>").select(predictors.template(F.col("t"), F.col("l"))).collect()]
    assert got == [[2, 6, 12, 16], [2, 6, 10, 14], [0, 1, 2, 3], [], [0, 1, 10, 11]]


def test_reusable_units(spark):
    v = lambda f, y, x: 1 if f == 1 and (y, x) == (3, 5) else 0
    s = spark.createDataFrame([(f, y, x, v(f, y, x), 0, 0) for f in range(3) for y in range(8) for x in range(8)], "frame long, y long, x long, v0 long, v1 long, v2 long")
    got = {(r["frame"], r["gy"], r["gx"]): (r["same"], r["reused"]) for r in choice.reusable_units(s, 4).collect()}
    for f in range(3):
        assert [got[f, *g] for g in ((0, 0), (0, 1), (1, 0), (1, 1))] == ([(False, False)] * 4 if f == 0 else [(True, True), (False, False), (True, True), (True, False)])


def test_choose_source(spark):
    rows = [(1, 0, "Lib-X"), (1, 1, "x"), (2, 0, "other"), (2, 1, "has X in it"), (3, 0, "other"), (4, 5, "own two"), (4, 3, "own one")]
    got = dict(choice.choose_source(spark.createDataFrame(rows, "g int, position int, source string"), ["g"], "X", ("own",)).collect())
    assert got == {1: "x", 2: "has X in it", 3: None, 4: "own one"}


def png(rows, alpha=False):
    """Encodes rows of pixels, each row with the next of the five filters."""
    n = 4 if alpha else 3
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw, up = b"", [0] * (len(rows[0]) * n)
    for y, row in enumerate(rows):
        flat = [c for p in row for c in (*p, 200)[:n]]
        left, corner = [0] * n + flat[:-n], [0] * n + up[:-n]
        guess = [[0, a, b, (a + b) // 2, min((a, b, c), key=lambda g: abs(a + b - c - g))][y % 5] for a, b, c in zip(left, up, corner)]  # noqa: B023
        raw, up = raw + bytes([y % 5]) + bytes((v - g) % 256 for v, g in zip(flat, guess)), flat
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_pictures(spark, tmp_path):
    rnd = random.Random(6)
    rows = [[tuple(rnd.randrange(256) for _ in range(3)) for _ in range(7)] for _ in range(11)]
    for alpha in (False, True):
        assert fixtures.decode_png(png(rows, alpha)).tolist() == [[list(p) for p in r] for r in rows]
    (tmp_path / "a.png").write_bytes(png(rows))
    s = fixtures.pictures(spark, str(tmp_path))
    assert {(r["y"], r["x"]): (r["v2"], r["v0"], r["v1"]) for r in s.collect()} == {(y, x): rows[y][x] for y in range(11) for x in range(7)}
    part = {(r["y"], r["x"]): r["v0"] for r in fixtures.source_crop(s, 2, 4, 4, 2, 10, canary=True).collect()}
    assert part == {(y, x): rows[4 + y][2 + x][1] * 4 + ((x | y * 4) & 3 or 3) for y in range(2) for x in range(4)}
    for bad in (b"x", png(rows)[:60]):
        with pytest.raises((fixtures.PictureError, zlib.error)):
            fixtures.decode_png(bad)


def test_crop_sweep(spark):
    src = spark.createDataFrame([("a", 64, 70, 3, "420"), ("b", 200, 90, 40, "444")], "source string, width int, height int, frames int, sampling string")
    rows = fixtures.crop_sweep(src, 7).collect()
    assert len({r["name"] for r in rows}) == len(rows) == 128
    assert all(r["x"] + r["w"] <= (64 if r["source"] == "a" else 200) and r["y"] + r["h"] <= (70 if r["source"] == "a" else 90) for r in rows)
    assert all(r["start"] == 0 and r["x"] % 2 == r["y"] % 2 == 0 for r in rows if r["source"] == "a") and any(r["x"] % 2 for r in rows)
    with pytest.raises(Exception, match="too short or small"):
        fixtures.crop_sweep(src.withColumn("frames", F.lit(2))).collect()


def test_statistics_files(spark, tmp_path):
    for n in ("stats/av_lossy_clip.jsonl", "stats/av_x_lossless_a.jsonl", "stats/zz_lossy_clip.jsonl", "other/named.jsonl", "other/left.jsonl"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("{}\n")
    matrix = spark.createDataFrame([(f"{tmp_path}/other/named.jsonl", "vv", "lossy", "clip1", "yuv420p8"), (f"{tmp_path}/gone.jsonl", "vv", "", "", ""), (None, "vv", "", "", "")], "path string, codec string, mode string, vector string, format string")
    got = sorted(tuple(r)[1:] for r in fixtures.statistics_files(spark, str(tmp_path), matrix, ["av", "vv"]).collect())
    assert got == [("av", "lossless", "av_x_lossless_a", "", False), ("av", "lossy", "av_lossy_clip", "", False), ("vv", "lossy", "clip1", "yuv420p8", True)]
