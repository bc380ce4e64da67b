"""Operators on records, leaves and motion candidates, against plain versions and at their edges."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweave import catalog
from lumenweave.operators import features, motion
from lumenweave.plans import records

SF = "/root/testdata/sf0.001"


def test_symbols(spark):
    rows = [(1, "context", 5 << 8), (1, "context", 304 << 8), (1, "context", 400 << 8), (1, "context", (24 << 8) | 7), (1, "bypass", 0), (1, "bypass_run", 64 + 9), (1, "terminate", 0), (1, "direct", 42 << 8), (1, None, 3), (2, "start", 9)]
    got = {(r[0], r[1]): r[2] for r in records.symbol_bits(spark.createDataFrame(rows, "unit int, kind string, data int"), ["unit"]).collect()}
    assert got == {(1, "residual"): 11, (1, "chroma_mode"): 1, (1, "other"): 3, (1, "partition"): 1, (2, "other"): 0}


def test_every_context_has_one_category():
    seen = [c for _, ranges in records.CONTEXTS for lo, hi in ranges for c in range(lo, hi + 1)]
    assert sorted(seen) == list(range(314))


def test_lines(spark):
    rows = [("c", None, "stats A a=1 b=2 a=5"), ("c", "", "  stats A b=+3 x=1.5 =7 y"), ("c", "s", "stats A a=-1"), ("c", None, "stats B none"), ("c", None, "other A a=1"), ("c", None, "stats"), ("c", None, None), ("c", None, "")]
    got = {tuple(r) for r in records.merge_lines(spark.createDataFrame(rows, '"case" string, source string, line string'.replace('"', "`")), "stats").collect()}
    assert got == {("c", "own", "A", "=7, a=5, b=5"), ("c", "s", "A", "a=-1"), ("c", "own", "B", "")}


def test_top_fields_and_ties(spark):
    rows = [("c", "s", "p", n, b, 1) for n, b in (("x", 3), ("y", 5), ("x", 2), ("w", 5), ("z", 1))]
    got = records.field_totals(spark.createDataFrame(rows, "`case` string, source string, phase string, name string, bits long, count long"), 3).collect()
    assert [(r["name"], r["bits"], r["count"]) for r in got] == [("w", 5, 1), ("x", 5, 2), ("y", 5, 1)]


def test_units(spark):
    rows = [(1, "angular", 3, True, 0), (1, "dc", None, False, 7), (1, None, None, None, None)]
    got = {r["counter"]: r["n"] for r in records.unit_counters(spark.createDataFrame(rows, "g int, mode string, angle int, skip boolean, pair int"), ["g"]).collect()}
    assert got == {"mode_angular": 1, "angle_03": 1, "residual_skip": 1, "mode_dc": 1, "residual_transformed": 2, "pair_explicit": 1}


def test_modules(spark):
    rows = [("a", None), ("a::b", "a"), ("a::b", "a"), ("a::a", "a"), ("x::y", "x")]
    got = {r[0]: r[1] for r in records.children(spark.createDataFrame(rows, "module string, parent string")).collect()}
    assert got == {"a": ["a::a", "a::b"], "a::b": [], "a::a": [], "x::y": []}


def test_leaves_of_equal_samples_and_deep_ones(spark):
    s = spark.range(72 * 70).select(F.lit(0).cast("long").alias("frame"), F.floor(F.col("id") / 72).alias("y"), (F.col("id") % 72).alias("x"))
    flat = features.simple_leaves(s.withColumn("v0", F.lit(7).cast("long"))).collect()
    assert len(flat) == 4 and all(r["simple"] and r["colours"] == 1 and r["gradient"] == 0 for r in flat)
    noisy = features.simple_leaves(s.withColumn("v0", F.pmod(F.xxhash64("x", "y"), F.lit(1024))), depth=10).where("gy = 0 and gx = 0").first()
    assert not noisy["simple"] and 200 < noisy["spread"] < 256


def blocks(spark, frames):
    rows = [(f, y, x, v) for f, grid in frames for y, line in enumerate(grid) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame long, gy long, gx long, d string")


def test_repeated_and_shifted_frames(spark):
    grid = [[f"{y},{x}" for x in range(6)] for y in range(5)]
    moved = [[f"{y},{x - 1}" for x in range(6)] for y in range(5)]
    got = {r["frame"]: r for r in motion.statistics(motion.candidates(blocks(spark, [(3, grid), (4, grid), (5, moved)]))).collect()}
    assert set(got) == {4, 5} and got[4]["zero"] == got[4]["blocks"] == got[4]["checks"] == 30
    # the first column is new; of the rest the first block finds its motion by a local step, others by a neighbour
    assert got[5]["zero"] == 0 and got[5]["local"] + got[5]["neighbour"] == 25 and got[5]["neighbour"] >= 20


def plain(now, was):
    """Candidates listed in full, then tried in order."""
    done, out = {}, []
    for y in range(len(now)):
        for x in range(len(now[y])):
            wanted = [((0, 0), "zero")] + [(done[p], "neighbour") for p in ((y, x - 1), (y - 1, x), (y - 1, x - 1), (y - 1, x + 1)) if done.get(p)]
            first = list(dict.fromkeys(m for m, _ in wanted))
            for my, mx in first:
                wanted += [((my + s * a, mx + s * b), "local") for s in (1, 2, 4, 8) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))]
            seen, got, n = set(), None, 0
            for m, kind in wanted:
                if m in seen or got:
                    continue
                seen.add(m)
                n += 1
                r, c = y + m[0], x + m[1]
                if 0 <= r < len(was) and 0 <= c < len(was[r]) and was[r][c] == now[y][x]:
                    got = (*m, kind)
            done[y, x] = got and got[:2]
            out.append((y, x, *(got or (None, None, None)), n))
    return out


def test_candidates_against_a_plain_version(spark):
    import random

    rng = random.Random(5)
    a, b = ([[str(rng.randrange(40)) for _ in range(12)] for _ in range(10)] for _ in range(2))
    got = motion.candidates(blocks(spark, [(0, a), (1, b)])).orderBy("gy", "gx").collect()
    assert [(r["gy"], r["gx"], r["dy"], r["dx"], r["kind"], r["checks"]) for r in got] == plain(b, a)
    assert {r["kind"] for r in got} >= {"zero", "local", None}


def test_motion_of_texts(spark):
    got = catalog.QUERIES["motion_of_texts"](spark, SF)
    assert got.where("checks <> outside + unequal + zero + neighbour + local").count() == 0 and got.count() > 0


def grids(rng):
    """Frames and references: of few or many contents, with holes, without content, moved, far from the origin."""
    for trial in range(60):
        w, h, most, gaps, far = rng.choice([(8, 20), (1, 30), (12, 10), (3, 3), (20, 20)]) + (rng.choice([2, 5, 20, 40]), rng.choice([0, 0.1, 0.5]), rng.choice([0, -5, 7]))
        now, was = ({(y + far, x + far): None if rng.random() < 0.02 else str(rng.randrange(most)) for y in range(h) for x in range(w + k) if rng.random() >= gaps} for k in (0, trial % 3))
        if trial % 3 == 0:
            dy, dx = rng.randrange(-12, 13), rng.randrange(-6, 7)
            now = {(y, x): was.get((y + dy + (y // 7 if trial % 2 else 0), x + dx), d) for (y, x), d in now.items()}
        yield now, was
    yield {(0, 0): "a", (0, 10**9): "b"}, {(0, 0): "a", (-1, 10**9): "b"}


def table(now, was):
    rows = [(y, x, d, back) for back, side in enumerate((now, was)) for (y, x), d in side.items()]
    return pa.table(dict(zip(("gy", "gx", "d", "back"), (pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)), strict=True)))


@pytest.mark.parametrize("rounds", [0, 2, motion.ROUNDS])
def test_many_blocks_at_once_as_one_by_one(monkeypatch, rounds):
    monkeypatch.setattr(motion, "ROUNDS", rounds)
    for now, was in grids(random.Random(3)):
        cols = [c.to_pylist() if isinstance(c, pa.Array) else list(c) for c in motion._one_frame(table(now, was))]
        assert list(zip(*cols, strict=True)) == motion.decide(now, was)


def test_blocks_cost_little():
    """A large frame without matches: all candidates of every block. One block at a time took some 25 us a block."""
    now, was = ({(i // 8, i % 8): f"{k}{i}" for i in range(40_000)} for k in "ab")
    rows, began = table(now, was), time.process_time()
    assert len(motion._one_frame(rows)[0]) == 40_000
    took, began = time.process_time() - began, time.process_time()
    motion.decide(now, was)
    assert 4 * took < time.process_time() - began


def texts(rng):
    words = lambda n, most: " ".join(rng.choice(["", "a", "b"]) if rng.random() < 0.1 else str(rng.randrange(most)) for _ in range(n))
    rows = [(k, words(rng.randrange(1, 300), rng.choice([3, 30, 300]))) for k in (*range(-70, -60), *range(0, 140), 200, 255, 256, -(2**63), 2**63 - 2)]
    return rows + [(201, ""), (202, "  "), (203, rows[-1][1]), (204, rows[-1][1] + " x"), (None, "a"), (300, None), (5, "0 1 2"), (64, words(400, 9))]


def plain_totals(rows):
    sides = {}
    for k, t in sorted((k, t) for k, t in rows if k is not None and t is not None):
        sides.setdefault(k, {}).update({divmod(i, 8): d for i, d in enumerate(t.split(" "))})
    out = []
    for k in sorted(sides):
        if k - 1 in sides:
            got = motion.decide(sides[k], sides[k - 1])
            out.append((k, len(got), *(sum(r[i] for r in got) for i in (5, 6, 7)), *(sum(r[4] == kind for r in got) for kind in motion.KINDS)))
    return out


def test_texts_as_frames(spark):
    """Texts at the edges of what is dealt out together, with the same number, without words, numbers far apart; and whatever is in hand at once."""
    rows = texts(random.Random(8))
    want = plain_totals(rows)
    df = motion.text_statistics(spark.createDataFrame(rows, "frame long, text string").repartition(7), 8)
    assert sorted(map(tuple, df.collect())) == want
    assert df.columns == ["frame", "blocks", "checks", "outside", "unequal", "zero", "neighbour", "local"]
    known = sorted(r for r in rows if None not in r)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in b], pa.int64()), pa.array([True] * len(b)), pa.array([r[1] for r in b])], names=["frame", "own", "text"]) for b in (known[:50], known[50:51], known[51:])]
    for part in (1, 700, 10**6):
        assert [tuple(r.values()) for out in motion._totals(iter(batches), 8, part) for r in out.to_pylist()] == want


def test_motion_of_texts_deals_out_texts(spark):
    """Texts are dealt out whole: there is no row for a word."""
    plan = catalog.QUERIES["motion_of_texts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
