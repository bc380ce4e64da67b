"""Reports over the records of an encoder's run: symbols, fields, statistics lines, units, clips, modules.

Each operator takes a DataFrame of its records and returns one; the queries feed them records made from whole tables, and their SQL says the
same from the records' definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (category, first and last context number of each range).
CONTEXTS = [
    ("partition", [(0, 3), (19, 20), (24, 41)]),
    ("luma_mode", [(4, 4), (21, 21), (53, 53), (305, 310)]),
    ("chroma_mode", [(13, 14), (304, 304)]),
    ("palette", [(42, 52)]),
    ("intra_copy", [(274, 282)]),
    ("inter", [(265, 273), (283, 294)]),
    ("residual", [(5, 12), (15, 18), (22, 23), (54, 264), (295, 303), (311, 313)]),
]
#: The horizontal and vertical transform of an explicit choice.
TRANSFORM_PAIRS = {2: "dst7_dst7", 3: "dct8_dst7", 4: "dst7_dct8", 5: "dct8_dct8"}


def symbol_bits(symbols: DataFrame, by: list[str]) -> DataFrame:
    """`by`, category, bits of symbols (kind, data): a `context` symbol is one bit of the category of its context (bits 8 to 17 of data), `bypass` and
    `bypass_run` (length in the low six bits) are residual, `direct` and `terminate` are one bit of other; any other kind, or none, has no bits."""
    at = F.shiftright(F.col("data"), 8).bitwiseAND(0x3FF)
    of = F.lit("other")
    for name, ranges in CONTEXTS:
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | at.between(lo, hi)
        of = F.when(hit, F.lit(name)).otherwise(of)
    kind = F.col("kind")
    category = F.when(kind == "context", of).when(kind.isin("bypass", "bypass_run"), F.lit("residual")).otherwise(F.lit("other"))
    bits = F.when(kind.isin("context", "direct", "bypass", "terminate"), F.lit(1)).when(kind == "bypass_run", F.col("data").bitwiseAND(0x3F)).otherwise(F.lit(0))
    return symbols.groupBy(*by, category.alias("category")).agg(F.sum(bits.cast("long")).alias("bits"))


def field_totals(rows: DataFrame, top: int) -> DataFrame:
    """The `top` fields (case, source, phase, name) by bits, with bits and count; ties in the order of the field."""
    key = ["case", "source", "phase", "name"]
    return rows.groupBy(*key).agg(F.sum("bits").alias("bits"), F.sum("count").alias("count")).orderBy(F.desc("bits"), *key).limit(top)


def merge_lines(lines: DataFrame, head: str) -> DataFrame:
    """case, source, label, summary of lines `head label key=value ...`: integer values are added by key, `key=total` is listed in the order of keys.

    A key said twice in a line counts as it was said last. Tokens without a whole number are left out, as are lines with another head; a label
    without any key keeps an empty summary. No source is `own`.
    """
    said = F.regexp_extract(F.trim("line"), rf"^{head}\s+(\S+)\s+(.*)$", 1)
    body = F.regexp_extract(F.trim("line"), rf"^{head}\s+\S+\s+(.*)$", 1)
    tokens = F.filter(F.split(body, r"\s+"), lambda t: t.rlike(r"^[^=]*=[+-]?[0-9]+$"))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.substring_index(t, "=", -1).cast("long").alias("v")))
    rows = lines.select("case", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("own")).alias("source"), said.alias("label"), pairs.alias("p")).where("label <> ''")
    rows = rows.withColumn("p", F.filter("p", lambda x, i: ~F.exists(F.slice("p", i + 2, F.greatest(F.size("p"), F.lit(1))), lambda y: y["k"] == x["k"])))
    sums = rows.select("case", "source", "label", F.explode_outer("p").alias("x")).groupBy("case", "source", "label", F.col("x.k").alias("k")).agg(F.sum("x.v").alias("v"))
    listed = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
    return sums.groupBy("case", "source", "label").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), ", ").alias("summary"))


def unit_counters(units: DataFrame, by: list[str]) -> DataFrame:
    """`by`, counter, n of transform units (mode: `dc`, `planar`, `horizontal`, `vertical` or `angular`; angle, skip, pair): how many have each mode, each
    angle, each kind of residual and each explicit pair of transforms. One pass; a unit adds to a few counters, so no table is read twice."""
    mode, pair = F.col("mode"), F.col("pair")
    named = F.create_map(*[F.lit(x) for kv in TRANSFORM_PAIRS.items() for x in kv])
    counters = F.filter(
        F.array(
            F.concat(F.lit("mode_"), mode),
            F.when(mode == "angular", F.concat(F.lit("angle_"), F.lpad(F.col("angle").cast("string"), 2, "0"))),
            F.when(F.col("skip"), F.lit("residual_skip")).otherwise(F.lit("residual_transformed")),
            F.when(pair != 0, F.lit("pair_explicit")),
            F.concat(F.lit("pair_"), F.element_at(named, pair)),
        ),
        lambda c: c.isNotNull(),
    )
    return units.select(*by, F.explode(counters).alias("counter")).groupBy(*by, "counter").agg(F.count("*").alias("n"))


def metadata(clips: DataFrame) -> DataFrame:
    """clips with w, h, format, fps and error: what is said of a clip (said_w, said_h, said_format, said_fps; is_explicit, fps_explicit) against its header
    (header_w, header_h, header_format, header_fps).

    An explicit statement wins and takes a format it lacks from the header; otherwise the header wins over a statement, as one that is
    read from the file's name. Nothing known, or no format, is an error.
    """
    own, header = F.col("said_w").isNotNull(), F.col("header_w").isNotNull()
    mine = own & (F.col("is_explicit") | ~header)
    kind = F.when(mine, F.coalesce("said_format", "header_format")).otherwise(F.col("header_format"))
    fps = F.when(F.col("fps_explicit"), F.col("said_fps")).otherwise(F.coalesce("header_fps", "said_fps"))
    pick = lambda a: F.when(mine, F.col(f"said_{a}")).otherwise(F.col(f"header_{a}"))
    error = F.when(~own & ~header, F.lit("no geometry")).when(kind.isNull(), F.lit("no format"))
    ok = lambda c: F.when(error.isNull(), c)
    return clips.withColumns({"w": ok(pick("w")), "h": ok(pick("h")), "format": ok(kind), "fps": fps, "error": error})


def frame_counts(clips: DataFrame) -> DataFrame:
    """clips with frames and error, from kind (`raw`, `stream` or `pattern`), frame_bytes, data_bytes and wanted.

    A pattern has as many frames as wanted, and must say so. Files have their complete frames, at most those wanted; a raw file of
    which all is wanted must hold whole frames only.
    """
    wanted, pattern = F.col("wanted"), F.col("kind") == "pattern"
    held = F.floor(F.col("data_bytes") / F.col("frame_bytes"))
    error = F.when(pattern & wanted.isNull(), F.lit("no count")).when((F.col("kind") == "raw") & wanted.isNull() & (F.col("data_bytes") % F.col("frame_bytes") != 0), F.lit("cut frame"))
    return clips.withColumns({"frames": F.when(error.isNull(), F.when(pattern, wanted).otherwise(F.least(wanted, held))), "error": error})


def children(modules: DataFrame) -> DataFrame:
    """module, children: the distinct children of each module (module, parent), sorted; a parent that is no module has none."""
    known = modules.select("module").distinct()
    own = modules.where("parent is not null").groupBy(F.col("parent").alias("module")).agg(F.array_sort(F.collect_set("module")).alias("children"))
    return known.join(own, "module", "left").select("module", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(c: Column, *values: object) -> Column:
    out = F.lit(None)
    for k, v in enumerate(values):
        out = F.when(c % len(values) == k, F.lit(v)).otherwise(out)
    return out


def symbol_bits_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    kind = _pick(F.col("l_orderkey") + F.col("l_linenumber"), "context", "bypass", "context", "bypass_run", "terminate", "direct", "context", "open")
    return symbol_bits(l.select((F.col("l_orderkey") % 500).alias("unit"), kind.alias("kind"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 350 * 256 + F.col("l_linenumber")).cast("long").alias("data")), ["unit"])


def field_totals_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    return field_totals(l.select(F.col("l_returnflag").alias("case"), F.col("l_linestatus").alias("source"), F.col("l_linenumber").alias("phase"), (F.col("l_suppkey") % 10).alias("name"), F.col("l_quantity").cast("long").alias("bits"), F.lit(1).alias("count")), 25)


def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    line = F.concat(_pick(k, "stats ", "stats  ", "other ", " stats "), F.concat(F.lit("s"), n(3)), F.lit(" z="), n(7), F.lit(" a="), n(5), F.lit("  bad=x"), F.when(k % 2 == 0, F.concat(F.lit(" z=-"), n(9))).otherwise(F.lit(" q")))
    return merge_lines(o.select(F.col("o_orderstatus").alias("case"), _pick(k, None, "", "left").alias("source"), line.alias("line")), "stats")


def unit_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")
    mode = _pick(F.col("l_partkey"), "dc", "planar", "angular", "horizontal", "vertical", "angular", "angular")
    return unit_counters(l.select("l_returnflag", mode.alias("mode"), (F.col("l_suppkey") % 67).alias("angle"), (F.col("l_linenumber") % 2 == 0).alias("skip"), (F.col("l_partkey") % 8).cast("int").alias("pair")), ["l_returnflag"])


def resolved_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said, header = F.floor(k / 2) % 3 != 0, F.floor(k / 6) % 3 != 0
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(said, k % 640).alias("said_w"), F.when(said, k % 480).alias("said_h"), F.when(said & (k % 5 > 1), F.lit("gray8")).alias("said_format"),
        F.when(k % 4 > 0, F.lit("25")).alias("said_fps"), (k % 2 == 0).alias("is_explicit"), (k % 7 == 0).alias("fps_explicit"),
        F.when(header, k % 320).alias("header_w"), F.when(header, k % 240).alias("header_h"), F.when(header, F.lit("yuv420p8")).alias("header_format"), F.when(header & (k % 3 == 0), F.lit("30")).alias("header_fps"),
    )
    return metadata(o).select("o_orderkey", "w", "h", "format", "fps", "error")


def resolved_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    p = p.select("p_partkey", _pick(k, "raw", "stream", "pattern").alias("kind"), (F.col("p_size") * 4 + 4).cast("long").alias("frame_bytes"), (k * 4).cast("long").alias("data_bytes"), F.when(F.floor(k / 3) % 2 == 0, k % 50).cast("long").alias("wanted"))
    return frame_counts(p).select("p_partkey", "frames", "error")


def module_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.split("p_type", " ").alias("w"))
    rows = p.select(F.explode(F.expr("transform(sequence(1, size(w)), k -> struct(array_join(slice(w, 1, k), '::') AS module, CASE WHEN k > 1 THEN array_join(slice(w, 1, k - 1), '::') END AS parent))")).alias("m")).select("m.module", "m.parent")
    return children(rows).select("module", F.array_join("children", ",").alias("children"))


QUERIES = {f.__name__: f for f in (symbol_bits_by_unit, field_totals_top, merged_statistics, unit_histograms, resolved_metadata, resolved_frames, module_children)}
SQL = {
    "symbol_bits_by_unit": """
WITH s AS (SELECT l_orderkey % 500 AS unit, (l_orderkey + l_linenumber) % 8 AS k, (l_partkey * 7 + l_suppkey) % 350 AS c, l_linenumber AS low FROM lineitem)
SELECT unit, category, CAST(sum(CASE WHEN k = 3 THEN low % 64 WHEN k = 7 THEN 0 ELSE 1 END) AS BIGINT) AS bits FROM (SELECT *, CASE
  WHEN k IN (1, 3) THEN 'residual' WHEN k NOT IN (0, 2, 6) THEN 'other' WHEN c <= 3 OR c IN (19, 20) OR c BETWEEN 24 AND 41 THEN 'partition' WHEN c IN (4, 21, 53) OR c BETWEEN 305 AND 310 THEN 'luma_mode'
  WHEN c IN (13, 14, 304) THEN 'chroma_mode' WHEN c BETWEEN 42 AND 52 THEN 'palette' WHEN c BETWEEN 274 AND 282 THEN 'intra_copy' WHEN c BETWEEN 265 AND 294 THEN 'inter' WHEN c <= 313 THEN 'residual' ELSE 'other' END AS category FROM s) t GROUP BY unit, category""",
    "field_totals_top": """
SELECT l_returnflag AS "case", l_linestatus AS source, l_linenumber AS phase, l_suppkey % 10 AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bits, count(*) AS count FROM lineitem
GROUP BY 1, 2, 3, 4 ORDER BY bits DESC, 1, 2, 3, 4 LIMIT 25""",
    "merged_statistics": """
WITH r AS (SELECT o_orderstatus AS c, CASE WHEN o_orderkey % 3 = 2 THEN 'left' ELSE 'own' END AS source, 's' || (o_orderkey % 3) AS label, o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 2),
g AS (SELECT c, source, label, CAST(sum(k % 5) AS BIGINT) AS a, CAST(sum(CASE WHEN k % 2 = 0 THEN -(k % 9) ELSE k % 7 END) AS BIGINT) AS z FROM r GROUP BY 1, 2, 3)
SELECT c AS "case", source, label, 'a=' || a || ', z=' || z AS summary FROM g""",
    "unit_histograms": """
WITH u AS (SELECT l_returnflag, l_partkey % 7 AS m, l_suppkey % 67 AS a, l_linenumber % 2 = 0 AS skip, l_partkey % 8 AS p FROM lineitem),
c AS (SELECT l_returnflag, 'mode_' || CASE m WHEN 0 THEN 'dc' WHEN 1 THEN 'planar' WHEN 3 THEN 'horizontal' WHEN 4 THEN 'vertical' ELSE 'angular' END AS counter FROM u
  UNION ALL SELECT l_returnflag, 'angle_' || lpad(CAST(a AS VARCHAR), 2, '0') FROM u WHERE m IN (2, 5, 6) UNION ALL SELECT l_returnflag, CASE WHEN skip THEN 'residual_skip' ELSE 'residual_transformed' END FROM u
  UNION ALL SELECT l_returnflag, 'pair_explicit' FROM u WHERE p > 0
  UNION ALL SELECT l_returnflag, CASE p WHEN 2 THEN 'pair_dst7_dst7' WHEN 3 THEN 'pair_dct8_dst7' WHEN 4 THEN 'pair_dst7_dct8' ELSE 'pair_dct8_dct8' END FROM u WHERE p BETWEEN 2 AND 5)
SELECT l_returnflag, counter, count(*) AS n FROM c GROUP BY 1, 2""",
    "resolved_metadata": """
WITH k AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey // 2 % 3 <> 0 AS s, o_orderkey // 6 % 3 <> 0 AS h FROM orders),
r AS (SELECT *, CASE WHEN NOT s AND NOT h THEN 'none' WHEN s AND (NOT h OR k % 2 = 0) THEN 'said' ELSE 'header' END AS pick FROM k),
f AS (SELECT *, CASE pick WHEN 'said' THEN CASE WHEN k % 5 > 1 THEN 'gray8' WHEN h THEN 'yuv420p8' END WHEN 'header' THEN 'yuv420p8' END AS format FROM r)
SELECT o_orderkey, CASE WHEN format IS NOT NULL THEN CASE pick WHEN 'said' THEN k % 640 ELSE k % 320 END END AS w, CASE WHEN format IS NOT NULL THEN CASE pick WHEN 'said' THEN k % 480 ELSE k % 240 END END AS h, format,
  CASE WHEN k % 7 <> 0 AND h AND k % 3 = 0 THEN '30' WHEN k % 4 > 0 THEN '25' END AS fps, CASE WHEN pick = 'none' THEN 'no geometry' WHEN format IS NULL THEN 'no format' END AS error FROM f""",
    "resolved_frames": """
WITH p AS (SELECT p_partkey, p_partkey % 3 AS kind, CAST(p_size * 4 + 4 AS BIGINT) AS f, CAST(p_partkey * 4 AS BIGINT) AS d, CASE WHEN p_partkey // 3 % 2 = 0 THEN CAST(p_partkey % 50 AS BIGINT) END AS n FROM part)
SELECT p_partkey, CAST(CASE WHEN kind = 2 THEN n WHEN kind = 0 AND n IS NULL AND d % f > 0 THEN NULL WHEN n IS NULL OR n > d // f THEN d // f ELSE n END AS BIGINT) AS frames,
  CASE WHEN kind = 2 AND n IS NULL THEN 'no count' WHEN kind = 0 AND n IS NULL AND d % f > 0 THEN 'cut frame' END AS error FROM p""",
    "module_children": """
WITH w AS (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part), m AS (SELECT DISTINCT array_to_string(w[1:k], '::') AS module, CASE WHEN k > 1 THEN array_to_string(w[1:k - 1], '::') END AS parent FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM w) t)
SELECT a.module, coalesce(string_agg(b.module, ',' ORDER BY b.module), '') AS children FROM (SELECT DISTINCT module FROM m) a LEFT JOIN m b ON b.parent = a.module GROUP BY a.module""",
}
