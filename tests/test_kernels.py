"""Hashes, levels, inverse transforms, partitions and palettes against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.functions import hashes
from lumenweave.operators import coefficients as C
from lumenweave.operators import palettes, partitioning


def test_block_hashes(spark):
    rnd = random.Random(5)
    for depth in (8, 10):
        v = [[[rnd.randrange(1 << depth) for _ in range(3)] for _ in range(17)] for _ in range(8)]
        s = spark.createDataFrame([(0, y, x, *v[y][x]) for y in range(8) for x in range(17)], "frame long, y long, x long, v0 long, v1 long, v2 long")
        got = {r["gx"]: r for r in hashes.block_hashes(s, 8, depth).collect()}
        assert set(got) == {0, 1}  # the third is partial
        for gx, r in got.items():
            a, b, c = 0xCBF29CE484222325, 0x811C9DC5, 0x811C9DC5
            for k in range(3):
                raw = b"".join(v[y][x][k].to_bytes(1 if depth == 8 else 2, "little") for y in range(8) for x in range(gx * 8, gx * 8 + 8))
                a = (a ^ k * 0x9E3779B97F4A7C15 % 2**64) * 0x1000000001B3 % 2**64
                for i in range(0, len(raw), 8):
                    a = (a ^ int.from_bytes(raw[i : i + 8], "little")) * 0x1000000001B3 % 2**64
                    lo, hi = int.from_bytes(raw[i : i + 4], "little"), int.from_bytes(raw[i + 4 : i + 8], "little")
                    t = b ^ lo ^ (hi << 5 | hi >> 27) & 0xFFFFFFFF ^ (k << 10 | i << 4 | 8)
                    b = t ^ (t << 13 | t >> 19) & 0xFFFFFFFF ^ t << 7 & 0xFFFFFFFF ^ t >> 11
                for x in raw:
                    c ^= x
                    c ^= c << 13 & 0xFFFFFFFF
                    c ^= c >> 17
                    c ^= c << 5 & 0xFFFFFFFF
            assert (r["hi"] << 32 | r["lo"], r["mixed"], r["shifted"]) == (a, b, c)
    with pytest.raises(ValueError):
        hashes.block_hashes(s, 4)


def rate(q, kind):
    scan = [abs(q[p]) for p in C.SCAN]
    some = [i for i, a in enumerate(scan) if a]
    if not some:
        return 16
    at = range(some[0], 16) if kind == "skip" else range(some[-1], -1, -1)
    score, mean = 96, 0
    for i in at:
        score += 10
        if scan[i]:
            score += 80 + 14 * min(scan[i], 12)
        near = sum(divmod(C.SCAN[i], 4)) < {"luma": 4, "chroma": 1, "skip": 0}[kind]
        most, off = C.HIGH[kind][0 if near else 1]
        if scan[i] > most:
            over = scan[i] - off
            m = 1 + sum(mean >= t for t in (4, 8, 16, 32, 64))
            cap = min(m + 4, 6)
            if over >> m < cap:
                bits = (over >> m) + 1 + m
            else:
                n = (over - (cap << m) + (2 << m)).bit_length()
                bits = cap + n - 1 - (m + 1) + n
            score += 64 * bits
            mean = (mean + over) >> 1
    return score


def test_rate_and_pruning(spark):
    rnd = random.Random(7)
    rows = [([0] * 16,)] + [([rnd.choice((0, 0, 1, -1, 2, 9, -40, 700)) for _ in range(16)],) for _ in range(60)] + [([5, 1] + [rnd.choice((0, 1, -1)) for _ in range(14)],) for _ in range(20)]
    df = spark.createDataFrame(rows, "q array<long>")
    q = F.col("q")
    got = df.select("q", *[C.rate_estimate(q, k).alias(k) for k in ("luma", "chroma", "skip")], C.prune_tail(q, 3).alias("tail"), C.prune_small(q, F.lit(1)).alias("small")).collect()
    for r in got:
        assert [r[k] for k in ("luma", "chroma", "skip")] == [rate(r["q"], k) for k in ("luma", "chroma", "skip")]
        want, n = list(r["q"]), 0
        for p in C.SCAN[:0:-1]:
            if abs(want[p]) > 1 or n == 3:
                break
            n += want[p] != 0
            want[p] = 0
        assert r["tail"] == want
        assert r["small"] == [x if i == 0 or abs(x) > 1 else 0 for i, x in enumerate(r["q"])]


def test_basis():
    for n in (4, 8):
        for kind in ("cos", "sin", "flip"):
            m = np.array([[C.basis(kind, n, k, i) for i in range(n)] for k in range(n)])
            g = m @ m.T / (64 * 64 * n)
            assert np.abs(g - np.eye(n)).max() < 0.02  # rows are orthogonal and alike long
    assert [C.basis("cos", 16, 3, i) for i in range(4)] == [87, 57, 9, -43] and C.basis("sin", 4, 1, 2) == 0


def test_inverse_transform(spark):
    rnd = random.Random(9)
    for w, h, pair in ((4, 4, 0), (8, 4, 3), (4, 8, 4), (8, 8, 5), (16, 4, 0)):
        kept = lambda n: 4 if n > 8 else n
        rows = [([rnd.randrange(-900, 900) if i % w < kept(w) and i // w < kept(h) else 0 for i in range(w * h)],) for _ in range(3)]
        across, down = C.PAIRS[pair]
        for (c, r) in spark.createDataFrame(rows, "c array<long>").select("c", C.inverse_transform(F.col("c"), w, h, 8, pair)).collect():
            a = np.array([[C.basis(down, h, k, i) for i in range(h)] for k in range(h)])
            b = np.array([[C.basis(across, w, k, i) for i in range(w)] for k in range(w)])
            mid = (a.T @ np.array(c).reshape(h, w) + 64) >> 7
            assert r == ((mid @ b + (1 << 11)) >> 12).reshape(-1).tolist()


def plain_tree(x, y, w, h, depth, spare, vw, vh, most):
    if x >= vw or y >= vh:
        return []
    right, bottom = x + w > vw, y + h > vh
    if not right and not bottom and w <= most and h <= most:
        return [(x, y, w, h)]
    quarters = depth == 0 and w > 8 and h > 8

    def halves(down):
        size = w if down else h
        if size <= 4 or w > 32 or h > 32 or depth >= 5 + spare:
            return False
        if down and bottom or not down and right and not bottom:
            return False
        return not (right and bottom and w > 8)

    if right or bottom:
        if right and bottom:
            kind = "q"
        elif bottom and quarters and w > most and h > most:
            kind = "q"
        elif bottom and halves(False):
            kind = "h"
        elif right and halves(True):
            kind = "v"
        else:
            kind = "q"
    elif quarters:
        kind = "q"
    else:
        kind = "v" if w > most and (h <= most or w >= h) else "h"
    out = []
    if kind == "q":
        for j, i in itertools.product(range(2), range(2)):
            out += plain_tree(x + i * w // 2, y + j * h // 2, w // 2, h // 2, 0, 0, vw, vh, most)
    else:
        for i in range(2):
            if kind == "h":
                out += plain_tree(x, y + i * h // 2, w, h // 2, depth + 1, spare + bottom, vw, vh, most)
            else:
                out += plain_tree(x + i * w // 2, y, w // 2, h, depth + 1, spare + right, vw, vh, most)
    return out


def test_coding_tree(spark):
    sizes = [(w, h) for w in range(4, 65, 12) for h in range(4, 65, 20)] + [(8, 64), (40, 56)]
    for most in (8, 32):
        got = {}
        for r in partitioning.coding_tree(spark.createDataFrame(sizes, "width int, height int"), most).collect():
            got.setdefault((r["width"], r["height"]), []).append((r["leaf"], r["x"], r["y"], r["w"], r["h"]))
        for w, h in sizes:
            leaves = [t[1:] for t in sorted(got[w, h])]
            assert leaves == plain_tree(0, 0, 64, 64, 0, 0, w, h, most)
            assert sum(a * b for _, _, a, b in leaves) == w * h


def test_leaf_partition(spark):
    sizes = [(w, h) for w in range(8, 65, 8) for h in range(8, 65, 8)]
    got = {}
    for r in partitioning.leaf_partition(spark.createDataFrame(sizes, "width int, height int")).collect():
        got.setdefault((r["width"], r["height"]), []).append((r["leaf"], r["x"], r["y"], r["w"], r["h"]))
    for w, h in sizes:
        leaves = [t[1:] for t in sorted(got[w, h])]
        assert len(set(leaves)) == len(leaves) and all((a, b) == (8, 8) for _, _, a, b in leaves)
        assert {(x, y) for x, y, _, _ in leaves} == {(x, y) for x in range(0, w, 8) for y in range(0, h, 8)}
    # a square goes into rows first, those into columns
    assert [t[1:3] for t in sorted(got[16, 16])] == [(0, 0), (8, 0), (0, 8), (8, 8)]


def test_palettes(spark):
    rnd = random.Random(11)
    for values in ([3, 5, 8, 13, 21, 34, 55], [0, 1, 2, 3, 4, 90, 91, 200, 201]):
        x = np.array([rnd.choice(values) for _ in range(64)])
        u = np.unique(x)
        least = min(sum(int(np.abs(run - np.sort(run)[(len(run) - 1) // 2]).sum()) for run in np.split(np.sort(x), np.searchsorted(np.sort(x), u[list(c)]))) for c in itertools.combinations(range(1, len(u)), 5))
        colours = palettes.medians(*np.unique(x, return_counts=True), 6)
        assert len(set(colours)) == 6 and set(colours) <= set(u)
        assert np.abs(x[:, None] - colours).min(1).sum() <= least
    assert palettes.palette(np.zeros(64))[0].tolist() == [0, 1] and palettes.palette(np.full(64, 7))[0].tolist() == [0, 7]
    c, i = palettes.palette(np.array([10] * 10 + [20] * 10 + [30, 40, 50, 60, 61] * 8 + [15] * 4))
    assert i[-1] == list(c).index(c[np.abs(c - 15).argmin()])
    s = spark.createDataFrame([(0, y, x, (x * y) % 11) for y in range(8) for x in range(9)], "frame long, y long, x long, v0 long")
    (r,) = palettes.block_palettes(s).collect()
    assert len(r["colours"]) == 6 and r["sad"] == sum(abs((k % 8) * (k // 8) % 11 - r["colours"][i]) for k, i in enumerate(r["indices"]))


def test_colour_code(spark):
    rnd = random.Random(13)
    rows = [(sorted(rnd.sample(range(256), n)), [rnd.randrange(256) for _ in range(m)]) for n in (1, 2, 6, 8) for m in (0, 3, 20)]
    rows += [(c, [*c[:3], 0, 0, *c[3:], 9]) for c, _ in rows] + [([1, 2, 3], [9] * 16 + [1, 2, 3]), ([250, 251, 254, 255], [])]
    log = lambda v: (v - 1).bit_length() if v > 1 else 0
    for c, k, got in spark.createDataFrame(rows, "c array<long>, k array<long>").select("c", "k", palettes.colour_code(F.col("c"), F.col("k"))).collect():
        want, left = "", list(c)
        for i, v in enumerate(k):
            want += str(int(i < 16 and v in left))
            if i < 16 and v in left:
                left.remove(v)
                if not left:
                    break
        if left:
            want += f"{left[0]:08b}"
            steps = [b - a for a, b in itertools.pairwise(left)]
            if steps:
                bits, room = max(5, log(max(steps))), 255 - left[0]
                want += f"{bits - 5:02b}"
                for d in steps:
                    want += f"{d - 1:0{bits}b}" if bits else ""
                    room -= d
                    bits = min(bits, log(room))
        assert got == want
