"""Motion of blocks by candidates: no motion, that of decided neighbours, and steps around them; with the statistics of the search."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = (1, 2, 4, 8)  # fixed values: distances of local candidates, in blocks
AROUND = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))  # fixed order: (rows, columns)
KINDS = ("zero", "neighbour", "local")
SCHEMA = "frame long, gy long, gx long, dy int, dx int, kind string, checks int, outside int, unequal int"
LOCAL = [(dy * s, dx * s) for s in STEPS for dy, dx in AROUND]  # the moves around a centre in their order: 32, a bit each
REACH = max(STEPS) + 1  # a candidate is at most so far outside of the reference
NONE = 1 << 40  # no move
WIDEST, SPARSE = 4096, 8  # fixed values: blocks of the widest line, and places for each block, up to which `search` is used
NEAR, PART, LANES = 6, 1 << 21, 1 << 16  # fixed values: 2 ** NEAR frames are dealt out together; bytes of text in hand at once; blocks in one step
ROUNDS = 12  # fixed value: rounds in which all waiting blocks of a frame are settled
TOTALS = ("blocks", "checks", "outside", "unequal", *KINDS)


def decide(now: dict, was: dict) -> list[tuple]:
    """(gy, gx, dy, dx, kind, checks, outside, unequal) of each block of `now` in raster order; both map (gy, gx) to a content.

    The first candidate whose block in `was` has the same content is taken. Candidates come in the order: none, then those of the blocks to
    the left, above, above left and above right, then the eight directions around each of these at each distance; one said twice is tried once.
    """
    chosen, out = {}, []
    for y, x in sorted(now):
        own, tried, near, got = now[y, x], set(), [], None
        checks = outside = unequal = 0

        def attempt(dy: int, dx: int, kind: str) -> bool:
            nonlocal checks, outside, unequal, got
            if got or (dy, dx) in tried:
                return False
            tried.add((dy, dx))
            checks += 1
            there = was.get((y + dy, x + dx))
            if there is None:
                outside += 1
            elif there != own:
                unequal += 1
            else:
                got = (dy, dx, kind)
            return True

        for place in (None, (y, x - 1), (y - 1, x), (y - 1, x - 1), (y - 1, x + 1)):
            move = (0, 0) if place is None else chosen.get(place)
            if move and attempt(*move, KINDS[place is not None]):
                near.append(move)
        for my, mx in near:
            for step in STEPS:
                for dy, dx in AROUND:
                    attempt(my + dy * step, mx + dx * step, KINDS[2])
        if got:
            chosen[y, x] = got[:2]
        out.append((y, x, *(got or (None, None, None)), checks, outside, unequal))
    return out


@functools.cache
def _repeats(m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For a move a and an earlier one b, by (a - b) as a number of `m` columns: the bits of the moves around a that are b, and of those that are b or around b.
    Both are read at the number plus the third value, clipped."""
    middle = 2 * max(STEPS) * (m + 1) + 1
    one, all_ = np.zeros(2 * middle + 1, np.uint32), np.zeros(2 * middle + 1, np.uint32)
    for j, (dy, dx) in enumerate(LOCAL):
        one[middle - dy * m - dx] |= np.uint32(1 << j)
        for ey, ex in [(0, 0), *LOCAL]:
            all_[middle + (ey - dy) * m + ex - dx] |= np.uint32(1 << j)
    return one, all_, middle


def search(now: np.ndarray, was: np.ndarray, p: np.ndarray, frame: np.ndarray, pitch: int) -> tuple[np.ndarray, ...]:
    """dy, dx (both 0 without a match), kind (-1: none, else of KINDS), checks, outside of the blocks at `p`: as `decide`, for many frames at once.

    now and was: contents as numbers on one plane of lines of `pitch`, frames under each other with REACH free columns and lines between and around them; was has -1 where
    there is no block, now is never equal there. p is in raster order frame by frame; frame: which of them each is in.

    What a block takes depends on four blocks before it. All are settled as if these had the moves known so far, then again those after a block whose move
    has changed, until none has. The order has no cycles, so this ends with the moves that one pass in order finds. A change that travels on and on could settle the rest of a frame each time, so
    after some rounds only the first waiting wave of each frame is settled, and then each block once more at most.
    """
    shift = (4 * (pitch + REACH)).bit_length()
    m = 1 << shift  # columns of a move's number: no two differences of moves have the same
    one, all_, middle = _repeats(m)
    offsets = np.array([dy * pitch + dx for dy, dx in LOCAL])
    numbers = np.array([dy * m + dx for dy, dx in LOCAL])
    before = (-1, -pitch, -pitch - 1, -pitch + 1)
    chosen = np.full(len(now), NONE)

    def at(move: np.ndarray) -> np.ndarray:
        return move - ((move + m // 2) >> shift) * (m - pitch)

    def around(q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits of the moves around q that are equal, and of those outside."""
        equal, out = np.empty(len(q), np.uint32), np.empty(len(q), np.uint32)
        for k in range(0, len(q), LANES):
            there = was[q[k : k + LANES, None] + offsets]
            equal[k : k + LANES] = np.packbits(there == own[k : k + LANES, None], axis=1, bitorder="little").view("<u4")[:, 0]
            out[k : k + LANES] = np.packbits(there < 0, axis=1, bitorder="little").view("<u4")[:, 0]
        return equal, out

    zero = was[p] == now[p]
    chosen[p[zero]] = 0
    open_ = np.flatnonzero(~zero)
    q = p[open_]
    own = now[q]
    equal0, out0 = around(q, own)
    beyond = was[q] < 0
    place = np.full(len(now), -1, np.int64)
    place[q] = np.arange(len(q))
    got, kind, checks, outside = np.full(len(q), NONE), np.full(len(q), -1, np.int8), np.zeros(len(q), np.int32), np.zeros(len(q), np.int32)

    def settle(i: np.ndarray) -> None:
        at_i, own_i = q[i], own[i]
        moves = [chosen[at_i + b] for b in before]
        valid = []
        for k, v in enumerate(moves):
            ok = (v != NONE) & (v != 0)
            for u in moves[:k]:
                ok &= v != u
            valid.append(ok)
        n, o, g, t = np.ones(len(i), np.int32), beyond[i].astype(np.int32), np.full(len(i), NONE), np.full(len(i), -1, np.int8)
        for v, ok in zip(moves, valid, strict=True):
            x = np.flatnonzero(ok & (t < 0))
            there = was[at_i[x] + at(v[x])]
            n[x] += 1
            o[x] += there < 0
            hit = x[there == own_i[x]]
            g[hit], t[hit] = v[hit], 1

        def local(x: np.ndarray, centre: np.ndarray | int, equal: np.ndarray, out: np.ndarray, seen: np.ndarray) -> None:
            equal = equal & ~seen
            tried = ~seen & (equal ^ (equal - np.uint32(1)))  # up to the first that is equal
            n[x] += np.bitwise_count(tried)
            o[x] += np.bitwise_count(tried & out)
            hit = equal != 0
            first = np.bitwise_count((equal & (~equal + np.uint32(1)))[hit] - np.uint32(1))
            g[x[hit]] = (centre[hit] if isinstance(centre, np.ndarray) else centre) + numbers[first]
            t[x[hit]] = 2

        said = lambda table, d: table.take(d + middle, mode="clip")
        x = np.flatnonzero(t < 0)
        seen = np.zeros(len(x), np.uint32)
        for v in moves:
            seen |= said(one, -v[x])
        local(x, 0, equal0[i[x]], out0[i[x]], seen)
        for k in range(4):
            x = np.flatnonzero(valid[k] & (t < 0))
            if not len(x):
                continue
            v = moves[k][x]
            seen = said(all_, v)
            for j in range(4):
                if j != k:
                    seen |= said(all_ if j < k else one, v - moves[j][x])
            local(x, v, *around(at_i[x] + at(v), own_i[x]), seen)
        got[i], kind[i], checks[i], outside[i] = g, t, n, o

    # a first guess: the moves around none; then all by what is known
    hit = equal0 != 0
    chosen[q[hit]] = numbers[np.bitwise_count((equal0 & (~equal0 + np.uint32(1)))[hit] - np.uint32(1))]
    waiting = np.ones(len(q), bool)
    wave = (q % pitch) + 2 * (q // pitch)
    own_frame = frame[open_]
    rounds = 0
    while len(i := np.flatnonzero(waiting)):
        if rounds >= ROUNDS:
            starts = np.flatnonzero(np.diff(own_frame[i], prepend=-1))
            first = np.minimum.reduceat(wave[i], starts)
            i = i[wave[i] == np.repeat(first, np.diff(starts, append=len(i)))]
        waiting[i] = False
        for k in range(0, len(i), LANES):
            settle(i[k : k + LANES])
        i = i[got[i] != chosen[q[i]]]
        chosen[q[i]] = got[i]
        for b in before:
            after = place[q[i] - b]
            waiting[after[after >= 0]] = True
        rounds += 1

    out = [np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), np.int8), np.ones(len(p), np.int32), np.zeros(len(p), np.int32)]
    move = np.where(kind < 0, 0, got)
    out[0][open_] = (move + m // 2) >> shift
    out[1][open_] = move - out[0][open_] * m
    out[2][open_], out[3][open_], out[4][open_] = kind, checks, outside
    return tuple(out)


def _numbers(d: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal contents have equal numbers; none has -1."""
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _unmatched(ids: np.ndarray) -> np.ndarray:
    """Numbers of blocks that are looked for: no content is not equal to anything."""
    return np.where(ids < 0, -2, ids)


def _one_frame(rows: pa.Table) -> list:
    """Columns of SCHEMA after the frame, of the blocks of one frame (back 0) and of its reference (back 1)."""
    back = rows["back"].to_numpy()
    if not len(back) or back.min() or not back.max():
        return [[]] * 8
    gy, gx = rows["gy"], rows["gx"]
    if not gy.null_count and not gx.null_count:
        y, x = gy.to_numpy(), gx.to_numpy()
        h, w = int(y.max()) - int(y.min()) + 1, int(x.max()) - int(x.min()) + 1
        if w <= WIDEST and (h + 2 * REACH) * (w + REACH) <= SPARSE * len(y) + (1 << 16):
            pitch = w + REACH
            at = (y - y.min() + REACH + 1) * pitch + x - x.min()
            ids, planes = _numbers(rows["d"]), np.full((2, (h + 2 * REACH + 2) * pitch), -1, np.int64)
            there = np.zeros(planes.shape[1], bool)
            there[at[back == 0]] = True
            planes[0, at[back == 0]], planes[1, at[back == 1]] = _unmatched(ids[back == 0]), ids[back == 1]
            p = np.flatnonzero(there)
            dy, dx, kind, checks, outside = search(*planes, p, np.zeros(len(p), np.int64), pitch)
            none = kind < 0
            named = pa.array([*KINDS]).take(pa.array(kind.astype(np.int32), mask=none))
            return [p // pitch - REACH - 1 + y.min(), p % pitch + x.min(), pa.array(dy.astype(np.int32), mask=none), pa.array(dx.astype(np.int32), mask=none), named, checks, outside, checks - outside - ~none]
    sides = ({}, {})
    for y, x, d, b in zip(*(rows[c].to_pylist() for c in ("gy", "gx", "d", "back")), strict=True):
        sides[b][y, x] = d
    got = decide(*sides)
    return [[r[i] for r in got] for i in range(8)]


def candidates(blocks: DataFrame) -> DataFrame:
    """(frame, gy, gx, dy, dx, kind, checks, outside, unequal) of blocks (frame, gy, gx, d), d being a name of the block's content.

    A block's reference is the frame with the number before its own; a frame without one has no rows. Decisions depend on those before them in
    raster order, so a frame is one group: its blocks and its reference's, which a frame's size bounds. Blocks without an equal candidate
    have null dy, dx and kind; `frames.motion` looks for their content in the whole reference.
    """
    own = blocks.select("frame", "gy", "gx", "d", F.lit(0).alias("back"))
    both = own.union(blocks.select((F.col("frame") + 1).alias("frame"), "gy", "gx", "d", F.lit(1).alias("back")))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(_one_frame(rows), kinds, strict=True)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(cols[0]), pa.int64()), *cols], names=["frame", "gy", "gx", "dy", "dx", "kind", "checks", "outside", "unequal"])

    return both.groupBy("frame").applyInArrow(run, SCHEMA)


def statistics(found: DataFrame) -> DataFrame:
    """(frame, blocks, checks, outside, unequal, zero, neighbour, local) of what `candidates` gives."""
    named = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    return found.groupBy("frame").agg(F.count("*").alias("blocks"), *[F.sum(c).alias(c) for c in ("checks", "outside", "unequal")], *named)


def _of_texts(frame: np.ndarray, own: np.ndarray, text: pa.Array, width: int, after: int | None, last: int) -> list[np.ndarray]:
    """frame and TOTALS of the frames after `after` up to `last`, of rows in the order of frames; rows that are not `own` are references alone."""
    words = pc.split_pattern(text, " ")
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, starts = _numbers(pc.list_flatten(words)), np.cumsum(n) - n
    names, k = np.unique(frame, return_inverse=True)
    lines = np.zeros(len(names), np.int64)
    np.maximum.at(lines, k, -(-n // width))
    has = np.zeros(len(names), bool)
    has[k[own]] = True
    wanted = has & (names <= last) & (names > after if after is not None else True)
    wanted[1:] &= names[1:] - 1 == names[:-1]
    wanted[:1] = False
    # a frame's place on the plane is as high as the higher of it and its reference
    tall = np.where(wanted, np.maximum(lines, np.concatenate([[0], lines[:-1]])) + REACH, 0)
    pitch, top = width + REACH, np.cumsum(tall) - tall + REACH + 1
    now, was, slots = np.full((3, (int(tall.sum()) + 2 * REACH + 2) * pitch), -1, np.int64)

    def lay(rows: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of rows go, their numbers and their slots."""
        each = n[rows]
        i = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(top[slot] * pitch, each) + i // width * pitch + i % width, ids[np.repeat(starts[rows], each) + i], np.repeat(slot, each)

    rows = np.flatnonzero(own & wanted[k])
    at, now[at], slots[at] = lay(rows, k[rows])
    rows = np.flatnonzero(np.append(wanted[1:], False)[k])
    at, was[at], _ = lay(rows, k[rows] + 1)
    p = np.flatnonzero(slots >= 0)
    f = slots[p]
    _, _, kind, checks, outside = search(now, was, p, f, pitch)
    total = lambda v: np.bincount(f, v, len(names)).astype(np.int64)[wanted]
    found = kind >= 0
    return [names[wanted], total(np.ones(len(p))), total(checks), total(outside), total(checks - outside - found), *(total(kind == t) for t in range(3))]


def _totals(batches: Iterator[pa.RecordBatch], width: int, part: int = PART) -> Iterator[pa.RecordBatch]:
    """frame and TOTALS of rows (frame, own, text) in the order of frames. What is in hand is settled every `part` bytes; the last two frames stay, as one may go on
    and one is the next one's reference."""
    held, after, size = [], None, 0

    def settle(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, after, size
        t = pa.Table.from_batches(held)
        frame = t["frame"].to_numpy()
        done = frame if end else frame[frame < frame[-1]]
        if len(done) and (after is None or done[-1] > after):
            t = t.combine_chunks()
            cols = _of_texts(frame, t["own"].to_numpy(), t["text"].combine_chunks(), width, after, done[-1])
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["frame", *TOTALS])
            after = int(done[-1])
            t = t.slice(int(np.searchsorted(frame, after)))
        held, size = t.to_batches(), 0

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + part - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - done)
            at = to
            if size >= part or at < batch.num_rows:
                yield from settle(False)
    if held:
        yield from settle(True)


def text_statistics(texts: DataFrame, width: int) -> DataFrame:
    """What `statistics` gives of `candidates` for the words of texts (frame, text), `width` blocks to a line; of texts with the same frame the last in their order counts.

    A text is dealt out whole, with those of the 2 ** NEAR numbers around its own; the last of these also goes to the next ones, as a reference. So few texts are sent twice,
    and memory holds the words of about PART bytes, or of two frames.
    """
    texts = texts.where("frame is not null and text is not null").select(F.col("frame").cast("long").alias("frame"), "text", F.shiftright(F.col("frame").cast("long"), NEAR).alias("near"))
    edge = texts.where(F.col("frame").bitwiseAND((1 << NEAR) - 1) == (1 << NEAR) - 1).withColumn("near", F.col("near") + 1)
    dealt = texts.withColumn("own", F.lit(True)).union(edge.withColumn("own", F.lit(False))).repartition("near").sortWithinPartitions("frame", "text").select("frame", "own", "text")

    return dealt.mapInArrow(lambda batches: _totals(batches, width), ", ".join(f"{c} long" for c in ("frame", *TOTALS)))
