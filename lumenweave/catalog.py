"""All queries of the engine, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import bits, scalars, specs
from lumenweave.operators import checks, features, frames, motion, planes, prediction, transforms
from lumenweave.plans import filters, kernels, records
from lumenweave.plans import frames_sql as S
from lumenweave.plans.reports import PLANS
from lumenweave.sources import patterns, traces, units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v[0] for k, v in PLANS.items()} | kernels.QUERIES | records.QUERIES
SQL: dict[str, str] = {k: v[1] for k, v in PLANS.items()} | kernels.SQL | records.SQL


def _frames(name: str, build: Callable[[SparkSession], DataFrame], sql: str) -> None:
    """A query over generated frames; it reads no table."""
    QUERIES[name] = lambda spark, _dir: build(spark)
    SQL[name] = sql


def _p(spark: SparkSession, kind: str) -> DataFrame:
    return patterns.pattern(spark, kind, S.W, S.H, S.N)


def _off(s: DataFrame) -> DataFrame:
    return s.withColumns({"v0": F.when((F.col("x") + F.col("y")) % 3 == 0, F.least(F.col("v0") + 2, F.lit(255))).otherwise(F.col("v0")), "v2": F.when(F.col("x") % 5 == 0, 255 - F.col("v2")).otherwise(F.col("v2"))})


for _kind in ("black", "checker", "gradient", "color_blocks"):
    _frames(f"pattern_{_kind}", lambda spark, k=_kind: _p(spark, k), f"SELECT * FROM {S.pattern(_kind)} p")
_G, _C = S.pattern("gradient"), S.pattern("checker")
_frames("pattern_420_chroma", lambda s: patterns.chroma_420(_p(s, "gradient")), f"SELECT frame, cy AS y, cx AS x, CAST(sum(v1) // 4 AS BIGINT) AS u, CAST(sum(v2) // 4 AS BIGINT) AS v FROM (SELECT frame, y // 2 AS cy, x // 2 AS cx, v1, v2 FROM {_G} p) GROUP BY frame, cy, cx")
_frames("pattern_422_chroma", lambda s: patterns.chroma_422(_p(s, "gradient")), f"SELECT frame, y, cx AS x, CAST(sum(v1) // 2 AS BIGINT) AS u, CAST(sum(v2) // 2 AS BIGINT) AS v FROM (SELECT frame, y, x // 2 AS cx, v1, v2 FROM {_G} p) GROUP BY frame, y, cx")
for _depth in (10, 12):
    _frames(f"canary_{_depth}bit", lambda s, d=_depth: patterns.canary(s, d, S.W, S.H, S.N), f"SELECT * FROM {S.canary(_depth)} p")
_frames("crop", lambda s: frames.crop(_p(s, "gradient"), 8, 4, 16, 12), f"SELECT frame, y - 4 AS y, x - 8 AS x, v0, v1, v2 FROM {_G} p WHERE x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 15")
_frames("scale_nearest", lambda s: frames.scale(_p(s, "gradient"), (S.W, S.H), (20, 10)).select("frame", "y", "x", "v0", "v1", "v2"),
        f"SELECT p.frame, g.y, g.x, v0, v1, v2 FROM {S.grid(20, 10, S.N)} g JOIN {_G} p ON p.frame = g.frame AND p.y = g.y * {S.H} // 10 AND p.x = g.x * {S.W} // 20")
_frames("depth_8_to_10", lambda s: _p(s, "gradient").select("frame", "y", "x", *[scalars.convert_depth(F.col(f"v{k}"), 8, 10).alias(f"v{k}") for k in range(3)]),
        f"SELECT frame, y, x, " + ", ".join(f"(least(v{k}, 255) * 1023 + 127) // 255 AS v{k}" for k in range(3)) + f" FROM {_G} p")
_frames("depth_round_trip", lambda s: s.range(256).select(F.col("id").alias("v"), scalars.convert_depth(scalars.convert_depth(F.col("id"), 8, 10), 10, 8).alias("back")), "SELECT range AS v, range AS back FROM range(256)")
_frames("rgb_to_gbr_planes", lambda s: _p(s, "color_blocks").select("frame", "y", "x", F.posexplode(F.array("v1", "v2", "v0"))).select("frame", F.col("pos").cast("long").alias("plane"), "y", "x", F.col("col").alias("v")),
        f"SELECT frame, CAST(k AS BIGINT) AS plane, y, x, CASE k WHEN 0 THEN v1 WHEN 1 THEN v2 ELSE v0 END AS v FROM {S.pattern('color_blocks')} p, range(3) r(k)")
_frames("sse", lambda s: frames.sse(_p(s, "gradient"), _off(_p(s, "gradient"))), f"SELECT * FROM {S.sse(_G, S.disturbed(_G))} q")
_frames("psnr", lambda s: frames.psnr(frames.sse(_p(s, "gradient"), _off(_p(s, "gradient")))).select("frame", *[F.round(c, 6).alias(c) for c in ("psnr0", "psnr1", "psnr2", "psnr_all")]), S.psnr(S.sse(_G, S.disturbed(_G))))
_frames("sad", lambda s: frames.sad(_p(s, "gradient"), _off(_p(s, "gradient"))), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, CAST(sum(abs(v0 - w)) AS BIGINT) AS sad FROM (SELECT p.frame, p.y, p.x, p.v0, q.v0 AS w FROM {_G} p JOIN {S.disturbed(_G)} q USING (frame, y, x)) GROUP BY frame, 2, 3")
_frames("block_histogram", lambda s: frames.histogram(_p(s, "gradient")), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, v0, count(*) AS n, min((y % 8) * 8 + x % 8) AS first FROM {_G} p GROUP BY frame, 2, 3, v0")
_frames("palette_worthy", lambda s: frames.palette_worthy(_p(s, "checker")), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, count(DISTINCT v0) AS colours, count(DISTINCT v0) BETWEEN 2 AND 4 AS worthy FROM {_C} p GROUP BY frame, 2, 3")
_frames("block_mean_sse", lambda s: frames.mean_sse(_p(s, "gradient"), 8), f"SELECT frame, gy, gx, CAST(mean AS BIGINT) AS mean, sse FROM {S.block_sse(_G, 8)} b")
_frames("split_gain", lambda s: frames.split_gain(_p(s, "gradient"), 16), f"SELECT b.frame, b.gy, b.gx, CAST(greatest(0, b.sse - k.kids) AS BIGINT) AS gain FROM {S.block_sse(_G, 16)} b JOIN (SELECT frame, gy // 2 AS gy, gx // 2 AS gx, sum(sse) AS kids FROM {S.block_sse(_G, 8)} c GROUP BY frame, gy // 2, gx // 2) k USING (frame, gy, gx)")
_frames("repeated_frames", lambda s: frames.repeated_frames(_p(s, "black").unionByName(_p(s, "checker").withColumn("frame", F.col("frame") + S.N))),
        f"SELECT range AS frame, range BETWEEN 1 AND {S.N - 1} AS same FROM range({2 * S.N})")
_frames("motion_match", lambda s: frames.motion(_p(s, "color_blocks")), f"""
WITH b AS (SELECT frame, y // 8 AS gy, x // 8 AS gx, string_agg(v0 || ',' || v1 || ',' || v2, ';' ORDER BY y, x) AS d FROM {S.pattern("color_blocks")} p GROUP BY frame, 2, 3),
r AS (SELECT frame, d FROM b GROUP BY frame, d HAVING count(*) <= 8)
SELECT frame, gy, gx, fy AS from_gy, fx AS from_gx FROM (SELECT c.frame, c.gy, c.gx, o.gy AS fy, o.gx AS fx, row_number() OVER (PARTITION BY c.frame, c.gy, c.gx ORDER BY abs(c.gy - o.gy) + abs(c.gx - o.gx), o.gy, o.gx) AS k
  FROM b c JOIN b o ON o.frame = c.frame - 1 AND o.d = c.d JOIN r ON r.frame = o.frame AND r.d = o.d) WHERE k = 1""")
_frames("bdpcm_delta", lambda s: frames.deltas(_p(s, "gradient"), 8), f"SELECT frame, y, x, v0 - coalesce(lag(v0) OVER (PARTITION BY frame, y, x // 8 ORDER BY x), 128) AS d FROM {_G} p")
_frames("ctu_grid", lambda s: frames.cells(s, 200, 136, 64), "SELECT i AS address, (i % 4) * 64 AS x, (i // 4) * 64 AS y, least(64, 200 - (i % 4) * 64) AS w, least(64, 136 - (i // 4) * 64) AS h FROM (SELECT range AS i FROM range(12))")
_frames("wht_4x4", lambda s: transforms.block_coefficients(_p(s, "gradient")).select("frame", "gy", "gx", *[F.col("c")[k].alias(f"c{k}") for k in range(16)], "exact"), S.wht(_G))
_frames("frame_bytes", lambda s: s.range(1, 40).select(F.explode(F.array(*[F.lit(x) for x in ("400", "420", "422", "444", "rgb")])).alias("sampling"), (F.col("id") * 2).alias("w"), (F.col("id") * 4).alias("h"), (8 + F.col("id") % 5).alias("depth"))
        .withColumn("bytes", scalars.frame_bytes(F.col("w"), F.col("h"), F.col("sampling"), F.col("depth"))),
        "SELECT s AS sampling, range * 2 AS w, range * 4 AS h, 8 + range % 5 AS depth, (range * 8 * range + 2 * CASE s WHEN '420' THEN range * 8 * range // 4 WHEN '422' THEN range * 8 * range // 2 WHEN '400' THEN 0 ELSE range * 8 * range END) * CASE WHEN range % 5 > 0 THEN 2 ELSE 1 END AS bytes FROM range(1, 40), (VALUES ('400'), ('420'), ('422'), ('444'), ('rgb')) t(s)")
_frames("exp_golomb", lambda s: s.range(300).select(F.col("id").alias("v"), scalars.exp_golomb(F.col("id")).alias("ue")), "SELECT range AS v, repeat('0', length(bin(range + 1)) - 1) || bin(range + 1) AS ue FROM range(300)")
_frames("leb128", lambda s: s.range(0, 40000, 37).select(F.col("id").alias("v"), scalars.leb128(F.col("id")).alias("hex")),
        "SELECT range AS v, CASE WHEN range < 128 THEN printf('%02X', range) WHEN range < 16384 THEN printf('%02X%02X', range % 128 + 128, range // 128) ELSE printf('%02X%02X%02X', range % 128 + 128, (range // 128) % 128 + 128, range // 16384) END AS hex FROM range(0, 40000, 37)")


def tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and status of each (status, priority) against the mean of its status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    g = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    t = o.groupBy("o_orderstatus").agg(F.count("*").alias("tn"), F.round(F.avg("o_totalprice"), 4).alias("tprice"))
    j = g.join(F.broadcast(t), "o_orderstatus").select("o_orderstatus", "o_orderpriority", (F.col("n") * 5 / F.col("tn")).alias("fps"), (F.col("price") / F.col("tprice")).alias("size"), (F.col("n") % 7 / 10 - 0.3).alias("dpsnr"))
    score = scalars.tradeoff_score(F.col("fps"), F.col("size"), F.col("dpsnr"))
    return j.select("o_orderstatus", "o_orderpriority", F.round(score, 5).alias("score"), scalars.tradeoff_status(score, F.col("fps"), F.col("size"), F.col("dpsnr")).alias("status"))


QUERIES["tradeoff"] = tradeoff
SQL["tradeoff"] = """
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1, 2), t AS (SELECT o_orderstatus, count(*) AS tn, round(avg(o_totalprice), 4) AS tprice FROM orders GROUP BY 1),
j AS (SELECT o_orderstatus, o_orderpriority, n * 5.0::DOUBLE / tn AS fps, price / tprice AS size, n % 7 / 10.0::DOUBLE - 0.3::DOUBLE AS dpsnr FROM g JOIN t USING (o_orderstatus)),
s AS (SELECT *, 10 * log2(fps) + 4 * log2(1 / size) + 8 * dpsnr AS score FROM j)
SELECT o_orderstatus, o_orderpriority, round(score, 5) AS score, CASE WHEN fps < 0.90 OR size > 1.20 OR dpsnr < -1.0 THEN 'regress' WHEN score >= 2 AND fps >= 1.10 THEN CASE WHEN dpsnr < -0.30 OR size > 1.05 THEN 'watch' ELSE 'accept' END WHEN score >= 0 THEN 'watch' ELSE 'regress' END AS status FROM s
"""


# --- units, codes, logs and chains
_ODD = "replace(replace(coalesce(text, ''), ' ', chr(0)), 'e', chr(1))"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes with many zeros and ones, so that escapes occur."""
    odd = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), " ", "\x00"), "e", "\x01")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("stream"), F.encode(odd, "UTF-8").alias("p"))


def framed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two start-code units a text, written, scanned and unescaped."""
    p = _payloads(spark, sf_dir)
    one = lambda kind: bits.nal_unit(F.lit(kind), F.lit(3), F.lit(1), F.concat(F.col("p"), bits.byte(F.lit(kind))))
    got = units.framed_units(p.select("stream", F.concat(one(7), one(20)).alias("data")))
    return got.select("stream", "unit", "kind", "layer", "temporal", F.sha2(bits.unescape(F.col("payload")), 256).alias("sha"))


QUERIES["framed_round_trip"] = framed_round_trip
SQL["framed_round_trip"] = f"SELECT CAST(doc_id AS VARCHAR) AS stream, u AS unit, kind, 3 AS layer, 1 AS temporal, sha256({_ODD} || chr(kind)) AS sha FROM documents, (VALUES (0, 7), (1, 20)) t(u, kind)"


def prefixed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit with a shortest and one with a four-byte length a text, written and scanned."""
    p = _payloads(spark, sf_dir)
    got = units.prefixed_units(p.select("stream", F.concat(bits.obu(F.lit(6), F.col("p")), bits.obu(F.lit(4), F.col("p"), width=4)).alias("data")))
    return got.select("stream", "unit", "offset", "kind", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha"))


QUERIES["prefixed_round_trip"] = prefixed_round_trip
SQL["prefixed_round_trip"] = f"""
WITH d AS (SELECT doc_id, {_ODD} AS t FROM documents), n AS (SELECT *, CAST(octet_length(encode(t)) AS BIGINT) AS size FROM d)
SELECT CAST(doc_id AS VARCHAR) AS stream, u AS unit, CAST(CASE u WHEN 0 THEN 0 ELSE size + 1 + CASE WHEN size + 1 < 128 THEN 1 WHEN size + 1 < 16384 THEN 2 WHEN size + 1 < 2097152 THEN 3 ELSE 4 END END AS BIGINT) AS "offset", kind, size, sha256(t) AS sha
FROM n, (VALUES (0, 6), (1, 4)) v(u, kind)"""

_frames("rice_code", lambda s: s.range(200).select(F.col("id").alias("v"), bits.rice(F.col("id"), 3).alias("code")), "SELECT range AS v, repeat('1', CAST(range // 8 AS INT)) || '0' || lpad(bin(range % 8), 3, '0') AS code FROM range(200)")
_frames("quasi_uniform_code", lambda s: s.range(11).select(F.col("id").alias("v"), bits.quasi_uniform(F.col("id"), 11).alias("code")),
        "SELECT range AS v, CASE WHEN range < 5 THEN lpad(bin(range), 3, '0') ELSE lpad(bin((range + 5) // 2), 3, '0') || ((range + 5) % 2) END AS code FROM range(11)")
_frames("packed_bits", lambda s: s.range(300).select(F.col("id").alias("v"), F.hex(bits.pack(F.bin("id"), trailing=True)).alias("hex"), bits.unpack(bits.pack(F.bin("id"))).alias("back")),
        "SELECT v, CASE WHEN v < 128 THEN printf('%02X', k) ELSE printf('%04X', k) END AS hex, rpad(b, CAST((length(b) + 7) // 8 * 8 AS INT), '0') AS back FROM (SELECT range AS v, bin(range) AS b, (2 * range + 1) << (CAST((8 - (length(bin(range)) + 1) % 8) % 8 AS INT)) AS k FROM range(300))")
_frames("filter_chain", lambda s: filters.build(s, ["pattern=gradient", "identity", "crop=x=8:y=4:w=16:h=12", "scale=w=8:h=4"], filters.FrameInfo(S.W, S.H, "yuv444p8"), S.N)[0].select("frame", "y", "x", "v0", "v1", "v2"),
        f"SELECT p.frame, g.y, g.x, v0, v1, v2 FROM {S.grid(8, 4, S.N)} g JOIN {_G} p ON p.frame = g.frame AND p.y = 4 + g.y * 12 // 4 AND p.x = 8 + g.x * 16 // 8")


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of counters in log lines made of events: a key given twice, a value that is no number, lines of another kind."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id")
    line = F.concat(F.when(F.col("event_id") % 4 == 0, "other ").otherwise("mode-stats "), "event_type", F.lit(" n=1 z=x k="), (u % 7).cast("string"), F.lit(" n="), (u % 5 - 2).cast("string"))
    return traces.counter_totals(traces.counter_lines(e.select(line.alias("value")), "mode-stats"), "label")


QUERIES["counter_log"] = counter_log
SQL["counter_log"] = "SELECT event_type AS label, key, count(*) AS n, CAST(sum(CASE key WHEN 'k' THEN user_id % 7 ELSE user_id % 5 - 2 END) AS BIGINT) AS total FROM events, (VALUES ('k'), ('n')) t(key) WHERE event_id % 4 <> 0 GROUP BY event_type, key"


def quality_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of log lines by event type and day: two values a line, some infinite."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = (F.col("event_id") % 100).cast("string")
    second = F.when((F.col("user_id") % 3 == 0) | (F.col("user_id") % 3 == 1) & (F.col("event_id") % 2 == 0), "inf").otherwise(F.concat(w, F.lit(".25")))
    first = F.when(F.col("user_id") % 3 == 0, "inf").otherwise(w)
    lines = e.select((F.col("user_id") % 3).alias("g"), F.concat(F.lit("frame: psnr_y=1 psnr_all="), first, F.lit(" again psnr_all="), second).alias("value"))
    return traces.quality_log(lines, "g").withColumn("psnr_all", F.round("psnr_all", 6))


QUERIES["quality_log"] = quality_log
SQL["quality_log"] = """
SELECT user_id % 3 AS g, 2 * count(*) AS frames, CASE user_id % 3 WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN NULL ELSE round(avg((event_id % 100 + event_id % 100 + 0.25::DOUBLE) / 2), 6) END AS psnr_all FROM events GROUP BY user_id % 3"""


# --- cosine transform, steps and text forms
_frames("dct_4x4", lambda s: transforms.block_levels(_off(_p(s, "gradient")), 90).select("frame", "gy", "gx", *[F.col(n)[k].alias(f"{n}{k}") for k in range(16) for n in ("c", "q")], "sse"),
        S.dct(S.disturbed(_G), transforms.step_size(90)))
_frames("quantiser_steps", lambda s: s.createDataFrame([(d, i, transforms.step_size(i, d)) for d in (8, 10, 12) for i in range(360)], "depth int, qindex int, step long"),
        f"SELECT depth, i AS qindex, CAST(CASE WHEN k < 25 THEN {list(transforms.STEPS)}[k + 1] ELSE {list(transforms.STEPS)}[(k - 1) % 24 + 2] * (1 << ((k - 1) // 24)) END AS BIGINT) AS step FROM (SELECT depth, i, greatest(1, least(i, top)) AS k FROM (VALUES (8, 255), (10, 303), (12, 351)) t(depth, top), (SELECT CAST(range AS INT) AS i FROM range(360)))")


def rate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates written as a whole number, a ratio and a decimal."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 4).alias("k"), (F.col("o_orderkey") % 97).alias("n"))
    n = F.col("n").cast("string")
    t = F.when(F.col("k") == 0, n).when(F.col("k") == 1, F.concat(n, F.lit("/1001"))).when(F.col("k") == 2, F.concat(n, F.lit(".050"))).otherwise(F.concat(n, F.lit(".")))
    return o.select("o_orderkey", specs.frame_rate(t).alias("r")).select("o_orderkey", "r.num", "r.den")


QUERIES["rate_forms"] = rate_forms
SQL["rate_forms"] = "SELECT o_orderkey, CASE WHEN k = 3 OR k < 2 AND n = 0 THEN NULL WHEN k = 2 THEN n * 1000 + 50 ELSE n END AS num, CASE WHEN k = 3 OR k < 2 AND n = 0 THEN NULL WHEN k = 0 THEN 1 WHEN k = 1 THEN 1001 ELSE 1000 END AS den FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 97 AS n FROM orders)"


def video_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and formats, codec paths and settings, split and checked."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 3).alias("k"))
    n = F.col("p_size").cast("string")
    v = specs.video_spec(F.concat(n, F.lit("x"), F.when(F.col("k") == 0, "0").otherwise(n), F.lit(":"), F.when(F.col("k") == 1, "yuv422p10le").otherwise("y8")))
    c = specs.codec_path(F.concat(F.when(F.col("k") == 0, "").otherwise("av"), F.lit(":a:"), n))
    s = specs.setting(F.concat(F.lit("qp"), F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("="), n))))
    return p.select("p_partkey", v["width"].alias("w"), v["sampling"].alias("sampling"), v["depth"].alias("depth"), c["path"].alias("path"), s["value"].alias("value"), specs.accepts(s["value"], between=(10, 40)).alias("fits"), specs.accepts(s["value"]).alias("flag"))


QUERIES["video_forms"] = video_forms
SQL["video_forms"] = """
SELECT p_partkey, CASE WHEN k > 0 THEN CAST(p_size AS BIGINT) END AS w, CASE k WHEN 1 THEN '422' WHEN 2 THEN '400' END AS sampling, CASE k WHEN 1 THEN 10 WHEN 2 THEN 8 END AS depth, CASE WHEN k > 0 THEN 'a:' || p_size END AS path,
  CASE WHEN k = 0 THEN 'true' ELSE CAST(p_size AS VARCHAR) END AS value, k > 0 AND p_size BETWEEN 10 AND 40 AS fits, k = 0 OR p_size = 1 AS flag FROM (SELECT *, p_partkey % 3 AS k FROM part)"""


# --- validation and choice of predictors
def lossless_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as frames of their source's stream against copies of which some are changed, grown or lost."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("stream"), F.col("doc_id").alias("frame_index"), F.coalesce("text", F.lit("")).alias("t"))
    i = F.col("frame_index")
    t = F.when(i % 97 == 5, F.concat("t", F.lit("x"))).when(i % 89 == 7, F.upper("t")).otherwise(F.col("t"))
    return checks.validate(d.select("stream", "frame_index", F.encode("t", "UTF-8").alias("data")), d.where(i % 101 != 3).select("stream", "frame_index", F.encode(t, "UTF-8").alias("data")))


QUERIES["lossless_validation"] = lossless_validation
SQL["lossless_validation"] = """
WITH a AS (SELECT source, doc_id, coalesce(text, '') AS t, doc_id % 101 <> 3 AS there, CASE WHEN doc_id % 97 = 5 THEN coalesce(text, '') || 'x' WHEN doc_id % 89 = 7 THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END AS u FROM documents),
g AS (SELECT source, count(*) AS n_source, count(*) FILTER (there) AS n_coded, sum(octet_length(encode(t))) AS b0, coalesce(sum(octet_length(encode(u))) FILTER (there), 0) AS b1, min(CASE WHEN NOT there OR t <> u THEN doc_id END) AS first_bad FROM a GROUP BY source)
SELECT source AS stream, CASE WHEN n_coded = 0 THEN 'missing' WHEN b0 <> b1 THEN 'length' WHEN first_bad IS NOT NULL THEN 'samples' ELSE 'equal' END AS status, n_source, n_coded, first_bad FROM g"""
_frames("intra_short_list", lambda s: prediction.short_list(prediction.intra_modes(_off(_p(s, "gradient"))), 2), f"""
WITH s AS MATERIALIZED (SELECT * FROM {S.disturbed(_G)}),
e AS (SELECT o.frame, o.y // 4 AS gy, o.x // 4 AS gx, o.v0 AS v, l.v0 AS l, a.v0 AS a, c.v0 AS c, d.dc FROM s o
  JOIN s l ON l.frame = o.frame AND l.y = o.y AND l.x = o.x // 4 * 4 - 1 JOIN s a ON a.frame = o.frame AND a.x = o.x AND a.y = o.y // 4 * 4 - 1 JOIN s c ON c.frame = o.frame AND c.x = o.x // 4 * 4 - 1 AND c.y = o.y // 4 * 4 - 1
  JOIN (SELECT frame, gy, gx, (sum(v0) + 4) // 8 AS dc FROM (SELECT frame, y // 4 AS gy, x // 4 + 1 AS gx, v0 FROM s WHERE x % 4 = 3 UNION ALL SELECT frame, y // 4 + 1, x // 4, v0 FROM s WHERE y % 4 = 3) GROUP BY frame, gy, gx) d ON d.frame = o.frame AND d.gy = o.y // 4 AND d.gx = o.x // 4),
p AS (SELECT *, CASE WHEN abs(a - c) <= abs(l - c) AND abs(a - c) <= abs(l + a - 2 * c) THEN l WHEN abs(l - c) <= abs(l + a - 2 * c) THEN a ELSE c END AS q FROM e),
m AS (SELECT frame, gy, gx, k, mode, CAST(sum(CASE k WHEN 1 THEN (v - dc) * (v - dc) WHEN 2 THEN (v - a) * (v - a) WHEN 3 THEN (v - l) * (v - l) ELSE (v - q) * (v - q) END) AS BIGINT) AS sse FROM p, (VALUES (1, 'dc'), (2, 'vertical'), (3, 'horizontal'), (4, 'paeth')) t(k, mode) GROUP BY frame, gy, gx, k, mode),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, gy, gx ORDER BY sse, k) AS n FROM m)
SELECT frame, gy, gx, string_agg(mode, ',' ORDER BY n) AS modes, min(sse) AS sse FROM r WHERE n <= 2 GROUP BY frame, gy, gx""")


# --- edges of scores, blocks cut by a frame's edge, planes of binary frames
def _odd(spark: SparkSession, kind: str) -> DataFrame:
    return patterns.pattern(spark, kind, 44, 28, S.N)


_O = S.pattern("gradient", 44, 28)
_frames("split_gain_odd", lambda s: frames.split_gain(_odd(s, "gradient"), 16), f"SELECT b.frame, b.gy, b.gx, CAST(greatest(0, b.sse - k.kids) AS BIGINT) AS gain FROM {S.block_sse(_O, 16)} b JOIN (SELECT frame, gy // 2 AS gy, gx // 2 AS gx, sum(sse) AS kids FROM {S.block_sse(_O, 8)} c GROUP BY frame, gy // 2, gx // 2) k USING (frame, gy, gx) WHERE b.gy * 16 + 16 <= 28 AND b.gx * 16 + 16 <= 44")
_frames("block_histogram_odd", lambda s: frames.histogram(_odd(s, "gradient")), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, v0, count(*) AS n, min((y % 8) * 8 + x % 8) AS first FROM {_O} p WHERE y < 24 AND x < 40 GROUP BY frame, 2, 3, v0")
_frames("palette_worthy_odd", lambda s: frames.palette_worthy(_odd(s, "checker")), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, count(DISTINCT v0) AS colours, count(DISTINCT v0) BETWEEN 2 AND 4 AS worthy FROM {S.pattern('checker', 44, 28)} p WHERE y < 24 AND x < 40 GROUP BY frame, 2, 3")
_frames("residual_energy", lambda s: features.residual_energy(_p(s, "gradient"), 8), f"SELECT frame, y // 8 AS gy, x // 8 AS gx, CAST(sum(v0 * v0) AS BIGINT) AS total, CAST(sum(CASE WHEN y % 8 < 4 AND x % 8 < 4 THEN v0 * v0 ELSE 0 END) AS BIGINT) AS head, CAST(sum(CASE WHEN y % 8 < 4 AND x % 8 < 4 THEN 0 ELSE v0 * v0 END) AS BIGINT) AS tail FROM {_G} p GROUP BY frame, 2, 3")
_frames("neighbour_samples", lambda s: features.neighbours(_p(s, "gradient")), f"SELECT p.frame, p.y, p.x, p.v0, l.v0 AS left, a.v0 AS above FROM {_G} p LEFT JOIN {_G} l ON l.frame = p.frame AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN {_G} a ON a.frame = p.frame AND a.y = p.y - 1 AND a.x = p.x".replace("AS left", 'AS "left"'))
_frames("copies_within_frame", lambda s: features.copies_within(_p(s, "color_blocks")), f"""
WITH b AS (SELECT frame, y // 8 AS gy, x // 8 AS gx, string_agg(v0 || ',' || v1 || ',' || v2, ';' ORDER BY y, x) AS d FROM {S.pattern("color_blocks")} p GROUP BY frame, 2, 3)
SELECT frame, gy, gx, f // 1000 AS from_gy, f % 1000 AS from_gx FROM (SELECT c.frame, c.gy, c.gx, max(o.gy * 1000 + o.gx) AS f FROM b c JOIN b o ON o.frame = c.frame AND o.d = c.d AND (o.gy < c.gy OR o.gy = c.gy AND o.gx < c.gx) GROUP BY c.frame, c.gy, c.gx)""")


def tradeoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of ratios that are zero, infinite, not a number or missing, by customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    odd = lambda k, v: F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(0.0)).when(k == 3, F.lit(float("-inf"))).otherwise(v)
    k = F.col("c_custkey")
    j = c.select("c_custkey", odd(k % 6, k % 40 / 20).alias("fps"), odd(F.floor(k / 6) % 6, k % 30 / 20).alias("size"), odd(F.floor(k / 36) % 6, k % 25 / 10 - 1.2).alias("dpsnr"))
    score = scalars.tradeoff_score(F.col("fps"), F.col("size"), F.col("dpsnr"))
    return j.select("c_custkey", F.round(score, 5).alias("score"), scalars.tradeoff_status(score, F.col("fps"), F.col("size"), F.col("dpsnr")).alias("status"))


QUERIES["tradeoff_edges"] = tradeoff_edges
SQL["tradeoff_edges"] = """
WITH k AS (SELECT c_custkey, c_custkey % 6 AS a, c_custkey // 6 % 6 AS b, c_custkey // 36 % 6 AS c, c_custkey % 40 / 20.0::DOUBLE AS f, c_custkey % 30 / 20.0::DOUBLE AS z, c_custkey % 25 / 10.0::DOUBLE - 1.2::DOUBLE AS p FROM customer),
t AS (SELECT c_custkey, CASE WHEN a > 3 AND f > 0 THEN f END AS f, CASE WHEN b > 3 AND z > 0 THEN z END AS z, CASE WHEN c > 3 THEN p WHEN c = 2 THEN 0.0::DOUBLE END AS p FROM k),
s AS (SELECT *, CASE WHEN f IS NOT NULL OR z IS NOT NULL OR p IS NOT NULL THEN coalesce(10 * log2(f), 0) + coalesce(4 * log2(1 / z), 0) + coalesce(8 * p, 0) END AS score FROM t)
SELECT c_custkey, round(score, 5) AS score, CASE WHEN score IS NULL THEN NULL WHEN coalesce(f < 0.9, FALSE) OR coalesce(z > 1.2, FALSE) OR coalesce(p < -1.0, FALSE) THEN 'regress'
  WHEN score >= 2 AND coalesce(f >= 1.1, TRUE) THEN CASE WHEN coalesce(p < -0.3, FALSE) OR coalesce(z > 1.05, FALSE) THEN 'watch' ELSE 'accept' END WHEN score >= 0 THEN 'watch' ELSE 'regress' END AS status FROM s"""


def _text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's bytes as a grey frame of one line."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("octet_length(text) > 0")
    data = F.encode("text", "UTF-8")
    return d.select(F.lit("documents").alias("path"), F.col("doc_id").alias("frame_index"), F.octet_length(data).alias("width"), F.lit(1).alias("height"), F.lit("gray8").alias("format"), data.alias("data"))


def planar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes decoded to samples and encoded again."""
    back = planes.encode(planes.decode(_text_frames(spark, sf_dir)))
    return back.select(F.col("frame_index").alias("doc_id"), F.col("width").cast("long").alias("n"), F.sha2("data", 256).alias("sha"))


def planar_crop_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the second half of every text's bytes, of those with four or more, by decode and crop, at a width for each text."""
    lines = planes.decode(_text_frames(spark, sf_dir).where("width >= 4"))
    half = F.floor(F.col("width") / 2).cast("int")
    return lines.select(F.col("frame_index").alias("doc_id"), F.aggregate(F.slice("samples", half + 1, F.size("samples")), F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


QUERIES["planar_round_trip"], QUERIES["planar_crop_sums"] = planar_round_trip, planar_crop_sums
SQL["planar_round_trip"] = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, sha256(text) AS sha FROM documents WHERE octet_length(encode(text)) > 0"
SQL["planar_crop_sums"] = """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 4),
p AS (SELECT doc_id, unnest(list_transform(range(length(h) // 4, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS v FROM b)
SELECT doc_id, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY doc_id"""


def simple_text_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of leaves of each text's whole lines of 64 bytes: the bytes themselves, an eighth of them, or a ramp that they disturb."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("frame"), F.encode("text", "UTF-8").alias("b")).where("octet_length(b) >= 64")
    at = F.expr("explode(transform(sequence(0, CAST(ceil(octet_length(b) DIV 64 / 4) AS INT) * 16 - 1), i -> struct(CAST(i DIV 16 * 4 AS BIGINT) AS y, CAST(i % 16 * 4 AS BIGINT) AS x)))")
    s = d.select("frame", "b", at.alias("at")).select("frame", "at.y", "at.x", F.expr("CAST(conv(hex(substring(b, CAST(at.y * 64 + at.x + 1 AS INT), 1)), 16, 10) AS BIGINT)").alias("v"))
    ramp = F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8) % 8 + F.when(F.col("v") > 120, 1).otherwise(0)
    v0 = F.when(F.col("frame") % 3 == 0, F.col("v")).when(F.col("frame") % 3 == 1, F.floor(F.col("v") / 8)).otherwise(ramp)
    return features.simple_leaves(s.select("frame", "y", "x", v0.alias("v0"))).withColumnRenamed("frame", "doc_id")


QUERIES["simple_text_leaves"] = simple_text_leaves
SQL["simple_text_leaves"] = """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) // 64 AS n FROM documents WHERE octet_length(encode(text)) >= 64),
p AS (SELECT doc_id, h, unnest(range((n + 3) // 4 * 16)) AS i FROM b),
r AS (SELECT doc_id, i // 16 * 4 AS y, i % 16 * 4 AS x, CAST('0x' || substr(h, 2 * (i // 16 * 4 * 64 + i % 16 * 4) + 1, 2) AS BIGINT) AS v FROM p),
s AS (SELECT doc_id, y // 64 AS gy, x // 64 AS gx, y, x, CASE doc_id % 3 WHEN 0 THEN v WHEN 1 THEN v // 8 ELSE x // 8 + y // 8 % 8 + CASE WHEN v > 120 THEN 1 ELSE 0 END END AS v FROM r),
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY doc_id, gy, gx, y ORDER BY x)) AS l, abs(v - lag(v) OVER (PARTITION BY doc_id, gy, gx, x ORDER BY y)) AS u FROM s),
g AS (SELECT doc_id, gy, gx, count(DISTINCT v) AS colours, max(v) - min(v) AS spread, CAST(coalesce((coalesce(sum(l), 0) + coalesce(sum(u), 0)) * 256 // nullif(count(l) + count(u), 0), 0) AS BIGINT) AS gradient FROM d GROUP BY doc_id, gy, gx)
SELECT *, colours <= 8 OR spread <= 8 OR (colours <= 16 AND gradient <= 192) AS simple FROM g"""


def motion_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search statistics of texts as frames of words, eight blocks wide, each against the text whose doc_id is one less."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return motion.text_statistics(d.select(F.col("doc_id").alias("frame"), "text"), 8).withColumnRenamed("frame", "doc_id")


QUERIES["motion_of_texts"] = motion_of_texts  # decisions that depend on earlier ones are not SQL: tests/test_records.py has a plain version
