"""Tiles, coding trees and leaf partitions from geometry alone: one row in, its regions out, as expressions without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 64  # side of a superblock and of a coding-tree unit
# fixed values: width and area in superblocks that a tile may have, tiles along a side, widths and heights that ask for more tiles
MOST_WIDE, MOST_AREA, MOST_ALONG = 64, 2304, 64
WIDE, WIDER, TALL = 1024, 1920, 1080
# fixed values: least side of a quartered block, least side and most depth of a halved one
QUARTERED, HALVED, DEPTH = 8, 4, 5

_int = lambda v: F.lit(v).cast("long")


def _log_up(v: Column) -> Column:
    """Least k with 2^k >= v, for v above zero."""
    return F.when(v <= 1, 0).otherwise(F.length(F.bin(v - 1))).cast("long")


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", _int(1), k.cast("int"))


def _up(v: Column, n: int) -> Column:
    return F.floor((v + n - 1) / n)


def tiles(geometry: DataFrame) -> DataFrame:
    """All columns of geometry (width, height: positive) and a row for each tile: tile (number in raster order), x, y, w, h.

    Two columns of tiles from 1024 samples on, four from 1920; two rows from 1080; more where a tile would be too wide or large, fewer where there are not enough superblocks.
    Columns and rows differ by one superblock at most, the larger ones first; a partial superblock belongs to the last.
    """
    W, H = F.col("width").cast("long"), F.col("height").cast("long")
    aligned = lambda v: _up(v, 8) * 8
    g = geometry.withColumns({"_cols": _up(aligned(W), UNIT), "_rows": _up(aligned(H), UNIT), "_fw": F.floor(aligned(W) / UNIT), "_fh": F.floor(aligned(H) / UNIT)})
    least_cols = _log_up(_up(F.col("_cols"), MOST_WIDE))
    least = F.greatest(_log_up(_up(F.col("_cols") * F.col("_rows"), MOST_AREA)), least_cols)
    most = lambda n: _log_up(F.least(n, _int(MOST_ALONG)))
    lc = F.least(F.greatest(F.when(W >= WIDER, 2).when(W >= WIDE, 1).otherwise(0).cast("long"), least_cols), most(F.col("_cols")))
    g = g.withColumn("_lc", lc)
    lr = F.least(F.greatest(F.when(H >= TALL, 1).otherwise(0).cast("long"), least - F.col("_lc")), most(F.col("_rows")))
    g = g.withColumn("_lr", lr)

    def starts(count: Column, full: Column, log: Column) -> Column:
        base = F.floor(full / _power(log))
        extra = full - base * _power(log) + F.when(base == 0, count - full).otherwise(0)
        at = F.transform(F.sequence(_int(0), _power(log) - 1), lambda i: i * base + F.least(i, extra))
        return F.concat(F.filter(at, lambda s: s < count), F.array(count))

    spans = lambda s, side: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.struct((F.get(s, i) * UNIT).alias("at"), (F.least(F.get(s, i + 1) * UNIT, side) - F.get(s, i) * UNIT).alias("n")))
    g = g.withColumns({"_xs": starts(F.col("_cols"), F.col("_fw"), F.col("_lc")), "_ys": starts(F.col("_rows"), F.col("_fh"), F.col("_lr"))})
    g = g.withColumns({"_xs": spans(F.col("_xs"), W), "_ys": spans(F.col("_ys"), H)})
    every = F.flatten(F.transform("_ys", lambda r: F.transform(F.col("_xs"), lambda c: F.struct(c["at"].alias("x"), r["at"].alias("y"), c["n"].alias("w"), r["n"].alias("h")))))
    return g.select(*geometry.columns, F.posexplode(every).alias("tile", "_t")).select(*geometry.columns, F.col("tile").cast("long").alias("tile"), "_t.x", "_t.y", "_t.w", "_t.h")


def _grow(units: DataFrame, rule: Callable[[Column, Column, Column], Column], rounds: int) -> DataFrame:
    """Leaves of the tree that `rule(node, width, height)` grows from a unit of (width, height) visible samples, in depth-first order.

    The rule says `leaf`, `quarter`, `across` (two rows), `down` (two columns) or null, for a node that is not visible. Each
    round splits all open nodes at once; a leaf's order is the text of its ways down.
    """
    vw, vh = F.col("width").cast("long"), F.col("height").cast("long")

    def node(x, y, w, h, depth, spare, way):
        return F.struct(*[c.alias(n) for c, n in zip((x, y, w, h, depth, spare, way), ("x", "y", "w", "h", "depth", "spare", "way"), strict=True)])

    def kids(p: Column) -> Column:
        n, kind = p["n"], p["kind"]
        quarter, across = kind == "quarter", kind == "across"
        # a halving that takes away what lies outside does not count against the depth
        outside = F.when(across, n["y"] + n["h"] > vh).otherwise(n["x"] + n["w"] > vw)
        w = F.when(across, n["w"]).otherwise(F.floor(n["w"] / 2))
        h = F.when(quarter | across, F.floor(n["h"] / 2)).otherwise(n["h"])

        def kid(i: Column) -> Column:
            right = F.when(quarter, i % 2).when(across, 0).otherwise(i).cast("long")
            below = F.when(quarter, F.floor(i / 2)).when(across, i).otherwise(0).cast("long")
            return node(n["x"] + right * w, n["y"] + below * h, w, h, F.when(quarter, _int(0)).otherwise(n["depth"] + 1), F.when(quarter, _int(0)).otherwise(n["spare"] + outside.cast("long")), F.concat(n["way"], i.cast("string")))

        return F.transform(F.sequence(F.lit(0), F.when(quarter, 3).otherwise(1)), kid)

    def round_(state: Column, _: Column) -> Column:
        judged = F.transform(state["open"], lambda n: F.struct(n.alias("n"), rule(n, vw, vh).alias("kind")))
        done = F.transform(F.filter(judged, lambda p: p["kind"] == "leaf"), lambda p: p["n"])
        return F.struct(F.flatten(F.transform(F.filter(judged, lambda p: p["kind"].isNotNull() & (p["kind"] != "leaf")), kids)).alias("open"), F.concat(state["done"], done).alias("done"))

    root = F.array(node(_int(0), _int(0), _int(UNIT), _int(UNIT), _int(0), _int(0), F.lit("")))
    leaves = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(root.alias("open"), F.filter(root, lambda n: F.lit(False)).alias("done")), round_, lambda s: s["done"])
    ordered = F.array_sort(F.transform(leaves, lambda n: F.struct(n["way"].alias("way"), n.alias("n"))))
    return units.select(*units.columns, F.posexplode(ordered).alias("leaf", "_p")).select(*units.columns, F.col("leaf").cast("long").alias("leaf"), *[f"_p.n.{c}" for c in ("x", "y", "w", "h")])


def coding_tree(units: DataFrame, most: int = 8) -> DataFrame:
    """All columns of units (width, height: visible samples of a 64 x 64 unit) and a row for each leaf of its coding tree: leaf, x, y, w, h.

    Leaves are wholly visible and have sides of at most `most`. A node that fits is quartered while it may be, then halved along its larger
    side; one that crosses an edge is quartered or halved by which of its corners are outside. Visible sides must be multiples of four.
    """

    def rule(n: Column, vw: Column, vh: Column) -> Column:
        x, y, w, h = n["x"], n["y"], n["w"], n["h"]
        right, bottom = x + w > vw, y + h > vh
        quarters = (n["depth"] == 0) & (w > QUARTERED) & (h > QUARTERED)
        may = (w <= 4 * QUARTERED) & (h <= 4 * QUARTERED) & (n["depth"] < n["spare"] + DEPTH) & ~(right & bottom & (w > QUARTERED))
        rows = may & (h > HALVED) & (bottom | ~right)
        cols = may & (w > HALVED) & ~bottom
        small = (w <= most) & (h <= most)
        larger = F.when((w > most) & ((h <= most) | (w >= h)), "down").otherwise("across")
        inside = F.when(small, "leaf").when(quarters, "quarter").otherwise(larger)
        edge = F.when(right & bottom, "quarter").when(bottom & quarters & (w > most) & (h > most), "quarter").when(bottom & rows, "across").when(right & cols, "down").otherwise("quarter")
        return F.when((x < vw) & (y < vh), F.when(right | bottom, edge).otherwise(inside))

    return _grow(units, rule, 12)


def leaf_partition(units: DataFrame) -> DataFrame:
    """All columns of units (width, height: visible samples, multiples of 8, of a 64 x 64 superblock) and a row for each leaf: leaf, x, y, w, h.

    Blocks are halved down to 8 x 8: by what an edge implies, if that is allowed, else by the only way allowed, else along the
    larger side, a square into two rows. Blocks four times as long as wide take only cuts across their length, those eight times are leaves.
    """

    def rule(n: Column, vw: Column, vh: Column) -> Column:
        x, y, w, h = n["x"], n["y"], n["w"], n["h"]
        has_rows, has_cols = y + h / 2 < vh, x + w / 2 < vw
        long_, tall = w >= 4 * h, h >= 4 * w
        whole, rows, cols = has_rows & has_cols, ~long_, ~tall
        by_square = F.when(has_rows, "down").otherwise("across")
        by_tall = F.when(~has_rows | ((w >= 16) & (x + w / 4 >= vw)), "across")
        by_wide = F.when(~has_cols | ((h >= 16) & (y + h / 4 >= vh)), "down")
        implied = F.when(whole, None).when(w == h, by_square).when(h > w, by_tall).otherwise(by_wide)
        implied = F.when((implied == "across") & rows | (implied == "down") & cols, implied)
        only = F.when(whole & ~rows & ~cols, "leaf").when(~whole & rows & ~cols, "across").when(~whole & ~rows & cols, "down")
        larger = F.when((w > h) & (w > 8) & cols | ~((h > 8) & rows) & (w > 8) & cols, "down").when((h > 8) & rows, "across").when(whole, "leaf").when(rows, "across").otherwise("down")
        small = (w == 8) & (h == 8) | (w == 8 * h) | (h == 8 * w)
        return F.when((x < vw) & (y < vh), F.when(small, "leaf").otherwise(F.coalesce(implied, only, larger)))

    return _grow(units, rule, 8)
