"""Queries of hashes, levels, partitions, predictors and choices, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions import hashes, specs
from lumenweave.operators import choice, coefficients, palettes, partitioning, predictors
from lumenweave.plans import frames_sql as S
from lumenweave.sources import fixtures, patterns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def _gradient(spark: SparkSession) -> DataFrame:
    return patterns.pattern(spark, "gradient", S.W, S.H, S.N)


# --- hashes: words, packets and bytes are folded over lists of wide integers
_WORD = "list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda j: CAST({l}[i * 8 + j + 1] AS HUGEINT) * CAST(pow(256, j) AS HUGEINT))))"
_T = "xor(xor(a, c % 4294967296), xor(((c // 4294967296) % 134217728) * 32 + (c // 576460752303423488) % 32, c // 18446744073709551616))"
_FOLD = {
    "r": "lambda a, c: (xor(a, c) * 17592186044851) % 18446744073709551616",
    "m": f"lambda a, c: xor(xor({_T}, ({_T} % 524288) * 8192 + {_T} // 524288), xor({_T} * 128 % 4294967296, {_T} // 2048))",
}
_A = "xor(a, c)"
_B = f"xor({_A}, {_A} * 8192 % 4294967296)"
_C = f"xor({_B}, {_B} // 131072)"
_FOLD["s"] = f"lambda a, c: xor({_C}, {_C} * 32 % 4294967296)"
_query("block_hashes", lambda s, _: hashes.block_hashes(_gradient(s)), f"""
WITH b AS (SELECT frame, y // 8 AS gy, x // 8 AS gx, list(v0 ORDER BY y, x) AS l0, list(v1 ORDER BY y, x) AS l1, list(v2 ORDER BY y, x) AS l2 FROM {S.pattern("gradient")} p GROUP BY 1, 2, 3),
w AS (SELECT frame, gy, gx, l0, l1, l2, {_WORD.format(l="l0")} AS w0, {_WORD.format(l="l1")} AS w1, {_WORD.format(l="l2")} AS w2 FROM b),
p AS (SELECT *, {", ".join(f"list_transform(range(8), lambda i: w{k}[i + 1] + CAST({k * 1024 + 8} + i * 128 AS HUGEINT) * 18446744073709551616) AS p{k}" for k in range(3))} FROM w),
h AS (SELECT frame, gy, gx,
  list_reduce(list_concat([{hashes.START64}::HUGEINT, 0], w0, [{hashes.SALT}::HUGEINT], w1, [{2 * hashes.SALT % (1 << 64)}::HUGEINT], w2), {_FOLD["r"]}) AS r,
  list_reduce(list_concat([{hashes.START32}::HUGEINT], p0, p1, p2), {_FOLD["m"]}) AS m,
  list_reduce(list_concat([{hashes.START32}::HUGEINT], CAST(list_concat(l0, l1, l2) AS HUGEINT[])), {_FOLD["s"]}) AS s FROM p)
SELECT frame, gy, gx, CAST(r // 4294967296 AS BIGINT) AS hi, CAST(r % 4294967296 AS BIGINT) AS lo, CAST(m AS BIGINT) AS mixed, CAST(s AS BIGINT) AS shifted FROM h""")

# --- levels
_LEVEL = "CASE WHEN id % 50 = 0 OR (id * 3 + k * 5) % 7 > 3 THEN 0 WHEN (id + k) % 4 = 0 THEN ((id * 7 + k * 13) % 11 - 5) * (id % 90) ELSE (id * 7 + k * 13) % 5 - 2 END"
_ROWS = f"(SELECT range AS id, list_transform(range(16), lambda k: CAST({_LEVEL.replace('id', 'range')} AS BIGINT)) AS q FROM range(400))"
_SCAN = f"(SELECT id, i, abs(q[z[i + 1] + 1]) AS a, q[z[i + 1] + 1] AS v, z[i + 1] AS p FROM (SELECT *, {list(coefficients.SCAN)} AS z FROM {_ROWS}), (SELECT range AS i FROM range(16)))"


def _levels(spark: SparkSession) -> DataFrame:
    return spark.range(400).withColumn("q", F.expr(f"transform(sequence(0, 15), k -> CAST({_LEVEL} AS BIGINT))"))


_query("rate_estimate", lambda s, _: _levels(s).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), coefficients.rate_estimate(F.col("q"), k).alias("rate")) for k in ("luma", "chroma", "skip")])).alias("r")).select("id", "r.*"), f"""
WITH RECURSIVE s AS (SELECT * FROM {_SCAN}), e AS (SELECT id, min(i) FILTER (a > 0) AS f, max(i) FILTER (a > 0) AS l FROM s GROUP BY id),
kinds AS (SELECT * FROM (VALUES ('luma', 4, 7, 8), ('chroma', 1, 4, 5), ('skip', 0, 5, 6)) t(kind, reach, most, off)),
r AS (SELECT id, kind, row_number() OVER (PARTITION BY id, kind ORDER BY CASE kind WHEN 'skip' THEN i ELSE -i END) AS n, a, CASE WHEN p // 4 + p % 4 < reach THEN most ELSE 5 END AS most, CASE WHEN p // 4 + p % 4 < reach THEN off ELSE 6 END AS off
  FROM s JOIN e USING (id), kinds WHERE CASE kind WHEN 'skip' THEN i >= f ELSE i <= l END),
w AS (SELECT id, kind, CAST(0 AS BIGINT) AS n, CAST(96 AS BIGINT) AS score, CAST(0 AS BIGINT) AS mean FROM e, kinds WHERE f IS NOT NULL
  UNION ALL SELECT id, kind, n, score + 10 + CASE WHEN a > 0 THEN 80 + 14 * least(a, 12) ELSE 0 END + CASE WHEN NOT high THEN 0 WHEN over >> m < cap THEN 64 * ((over >> m) + 1 + m) ELSE 64 * (cap + 2 * length(bin(over - (cap << m) + (2 << m))) - 2 - m) END, CASE WHEN high THEN (mean + over) // 2 ELSE mean END
  FROM (SELECT *, CAST(least(m + 4, 6) AS BIGINT) AS cap FROM (SELECT w.id, w.kind, w.n + 1 AS n, score, mean, a, a > most AS high, greatest(a - off, 0) AS over, CAST(CASE WHEN mean < 4 THEN 1 WHEN mean < 8 THEN 2 WHEN mean < 16 THEN 3 WHEN mean < 32 THEN 4 WHEN mean < 64 THEN 5 ELSE 6 END AS BIGINT) AS m FROM w JOIN r ON r.id = w.id AND r.kind = w.kind AND r.n = w.n + 1)))
SELECT id, kind, CAST(arg_max(score, n) AS BIGINT) AS rate FROM w GROUP BY id, kind UNION ALL SELECT id, kind, 16 FROM e, kinds WHERE f IS NULL""")
_query("pruned_tail", lambda s, _: _levels(s).select("id", F.posexplode(coefficients.prune_tail(F.col("q"), 2)).alias("p", "v")).withColumn("p", F.col("p").cast("long")), f"""
WITH s AS (SELECT * FROM {_SCAN}), t AS (SELECT *, coalesce(max(a) OVER w, 0) AS top, coalesce(sum(a) OVER w, 0) AS ones FROM s WINDOW w AS (PARTITION BY id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CAST(p AS BIGINT) AS p, CASE WHEN i > 0 AND a = 1 AND top <= 1 AND ones < 2 THEN 0 ELSE v END AS v FROM t""")
_query("skip_levels", lambda s, _: s.range(-400, 401, 3).select(F.col("id").alias("v"), F.explode(F.array(*map(F.lit, (0, 4, 17, 26, 37, 51)))).alias("qp"))
       .select("v", "qp", coefficients.skip_level(F.col("v"), F.lit(8), F.col("qp")).alias("level")).withColumn("back", coefficients.skip_value(F.col("level"), F.lit(8), F.col("qp"))), """
WITH s AS (SELECT v, qp, [40, 45, 51, 57, 64, 72][q % 6 + 1] AS scale, 6 - q // 6 AS down FROM (SELECT range AS v FROM range(-400, 401, 3)), (SELECT qp, greatest(qp, 4) AS q FROM (VALUES (0), (4), (17), (26), (37), (51)) t(qp))),
e AS (SELECT *, sign(v) * ((abs(v) * CASE WHEN down > 0 THEN 1 << down ELSE 1 END + den // 2) // den) AS about FROM (SELECT *, CASE WHEN down > 0 THEN scale ELSE scale << (-down) END AS den FROM s)),
c AS (SELECT v, qp, d, CAST(about + d AS BIGINT) AS level, CASE WHEN down > 0 THEN (CAST(about + d AS BIGINT) * scale + (1 << (down - 1))) >> down ELSE CAST(about + d AS BIGINT) * (scale << (-down)) END AS back FROM e, (VALUES (0), (-1), (1)) t(d))
SELECT v, qp, CASE WHEN v = 0 THEN 0 ELSE level END AS level, CASE WHEN v = 0 THEN 0 ELSE back END AS back FROM (SELECT *, row_number() OVER (PARTITION BY v, qp ORDER BY (v - back) * (v - back), abs(level), d <> 0, d) AS n FROM c) WHERE n = 1""")
_query("inverse_sines", lambda s, _: _levels(s).select("id", F.posexplode(coefficients.inverse_transform(F.col("q"), 4, 4, 8, 3)).alias("p", "v")).withColumn("p", F.col("p").cast("long")), f"""
WITH q AS (SELECT id, k // 4 AS j, k % 4 AS i, q[k + 1] AS c FROM {_ROWS}, (SELECT range AS k FROM range(16))),
sines AS (SELECT j, m[1] AS a, m[2] AS b, m[3] AS c, m[4] AS d FROM (VALUES (0, [29, 55, 74, 84]), (1, [74, 74, 0, -74]), (2, [84, -29, -74, 55]), (3, [55, -84, 74, -29])) t(j, m)),
flips AS (SELECT j, m[1] AS a, m[2] AS b, m[3] AS c, m[4] AS d FROM (VALUES (0, [84, 74, 55, 29]), (1, [74, 0, -74, -74]), (2, [55, -74, -29, 84]), (3, [29, -74, 84, -55])) t(j, m)),
v AS (SELECT id, i, y, (sum(q.c * [s.a, s.b, s.c, s.d][y + 1])::BIGINT + 64) >> 7 AS c FROM q JOIN sines s USING (j), (SELECT range AS y FROM range(4)) GROUP BY id, i, y)
SELECT id, y * 4 + x AS p, (sum(v.c * [f.a, f.b, f.c, f.d][x + 1])::BIGINT + 2048) >> 12 AS v FROM v JOIN flips f ON f.j = v.i, (SELECT range AS x FROM range(4)) GROUP BY id, y, x""")
_query("cheapest_form", lambda s, _: s.range(500).select("id", coefficients_forms().alias("f")).select("id", choice.cheapest(F.col("f")).cast("long").alias("chosen")), """
WITH f AS (SELECT range AS id, k, (range * 7 + k * 131) % 300 AS rate, (range * 3 + k * 57) % 400 AS sse, (range + k) % 9 AS loss, k * 40 AS extra FROM range(500), (VALUES (0), (1), (2), (3)) t(k)),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rate + (sse + 2 * loss) // 4, k) AS n FROM (SELECT f.* FROM f JOIN f b ON b.id = f.id AND b.k = 0 WHERE f.k = 0 OR f.sse <= b.sse + f.extra))
SELECT id, CAST(k AS BIGINT) AS chosen FROM g WHERE n = 1""")


def coefficients_forms():
    one = lambda k: F.struct(((F.col("id") * 7 + k * 131) % 300).alias("rate"), ((F.col("id") * 3 + k * 57) % 400).alias("sse"), ((F.col("id") + k) % 9).alias("loss"), F.lit(k * 40).alias("extra"))
    return F.array(*map(one, range(4)))


# --- partitions
_query("tiles", lambda s, _: partitioning.tiles(s.range(200).select((F.col("id") * 997 % 9000 + 16).alias("width"), (F.col("id") * 613 % 5000 + 16).alias("height"))), """
WITH g AS (SELECT range * 997 % 9000 + 16 AS width, range * 613 % 5000 + 16 AS height FROM range(200)),
n AS (SELECT *, (width + 63) // 64 AS sc, (height + 63) // 64 AS sr, (width + 7) // 8 * 8 // 64 AS fw, (height + 7) // 8 * 8 // 64 AS fh FROM g),
k AS (SELECT *, CAST(ceil(log2((sc + 63) // 64)) AS BIGINT) AS c0, CAST(ceil(log2(least(sc, 64))) AS BIGINT) AS c1, CAST(ceil(log2(least(sr, 64))) AS BIGINT) AS r1, CAST(ceil(log2((sc * sr + 2303) // 2304)) AS BIGINT) AS a0 FROM n),
c AS (SELECT *, least(greatest(CASE WHEN width >= 1920 THEN 2 WHEN width >= 1024 THEN 1 ELSE 0 END, c0), c1) AS lc FROM k),
r AS (SELECT *, least(greatest(CASE WHEN height >= 1080 THEN 1 ELSE 0 END, greatest(a0, c0) - lc), r1) AS lr FROM c),
x AS (SELECT DISTINCT width, height, i, s, lead(s) OVER (PARTITION BY width, height ORDER BY i) AS e FROM (SELECT width, height, i, i * (fw >> lc) + least(i, fw - ((fw >> lc) << lc) + CASE WHEN fw >> lc = 0 THEN sc - fw ELSE 0 END) AS s, sc FROM r, (SELECT range AS i FROM range(64)) WHERE i < 1 << lc) WHERE s < sc),
y AS (SELECT DISTINCT width, height, i, s, lead(s) OVER (PARTITION BY width, height ORDER BY i) AS e FROM (SELECT width, height, i, i * (fh >> lr) + least(i, fh - ((fh >> lr) << lr) + CASE WHEN fh >> lr = 0 THEN sr - fh ELSE 0 END) AS s, sr FROM r, (SELECT range AS i FROM range(64)) WHERE i < 1 << lr) WHERE s < sr)
SELECT width, height, row_number() OVER (PARTITION BY width, height ORDER BY y.i, x.i) - 1 AS tile, x.s * 64 AS x, y.s * 64 AS y, coalesce(x.e * 64, width) - x.s * 64 AS w, coalesce(y.e * 64, height) - y.s * 64 AS h FROM x JOIN y USING (width, height)""")


def _tree(kind: str, sizes: str) -> str:
    return f"""
WITH RECURSIVE t AS (SELECT width, height, 0 AS x, 0 AS y, 64 AS w, 64 AS h, 0 AS depth, 0 AS spare, '' AS way FROM {sizes}
  UNION ALL SELECT width, height, x + CASE WHEN kind = 'quarter' THEN i % 2 * w // 2 WHEN kind = 'down' THEN i * w // 2 ELSE 0 END, y + CASE WHEN kind = 'quarter' THEN i // 2 * h // 2 WHEN kind = 'across' THEN i * h // 2 ELSE 0 END,
    CASE WHEN kind = 'across' THEN w ELSE w // 2 END, CASE WHEN kind = 'down' THEN h ELSE h // 2 END, CASE WHEN kind = 'quarter' THEN 0 ELSE depth + 1 END, CASE WHEN kind = 'quarter' THEN 0 WHEN kind = 'across' THEN spare + (y + h > height)::INT ELSE spare + (x + w > width)::INT END, way || i
  FROM (SELECT *, {kind} AS kind FROM t WHERE x < width AND y < height), (VALUES (0), (1), (2), (3)) k(i) WHERE kind <> 'leaf' AND (i < 2 OR kind = 'quarter')),
l AS (SELECT *, {kind} AS kind FROM t WHERE x < width AND y < height)
SELECT width, height, row_number() OVER (PARTITION BY width, height ORDER BY way) - 1 AS leaf, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM l WHERE kind = 'leaf'"""


def _sizes(spark: SparkSession, step: int) -> DataFrame:
    n = 64 // step
    return spark.range(n * n).select(((F.floor(F.col("id") / n) + 1) * step).alias("width"), ((F.col("id") % n + 1) * step).alias("height"))


_OVER_R, _OVER_B = "x + w > width", "y + h > height"
_MAY = f"w <= 32 AND h <= 32 AND depth < spare + 5 AND NOT ({_OVER_R} AND {_OVER_B} AND w > 8)"
_query("coding_tree", lambda s, _: partitioning.coding_tree(_sizes(s, 4)), _tree(f"""CASE WHEN NOT ({_OVER_R}) AND NOT ({_OVER_B}) THEN CASE WHEN w <= 8 AND h <= 8 THEN 'leaf' WHEN depth = 0 AND w > 8 AND h > 8 THEN 'quarter' WHEN w > 8 AND (h <= 8 OR w >= h) THEN 'down' ELSE 'across' END
  WHEN {_OVER_R} AND {_OVER_B} THEN 'quarter' WHEN {_OVER_B} AND depth = 0 AND w > 8 AND h > 8 THEN 'quarter' WHEN {_OVER_B} AND {_MAY} AND h > 4 THEN 'across' WHEN {_OVER_R} AND {_MAY} AND w > 4 THEN 'down' ELSE 'quarter' END""",
    "(SELECT (i + 1) * 4 AS width, (j + 1) * 4 AS height FROM (SELECT range AS i FROM range(16)), (SELECT range AS j FROM range(16)))"))
_IN_R, _IN_C = "y + h / 2 < height", "x + w / 2 < width"
_query("leaf_partition", lambda s, _: partitioning.leaf_partition(_sizes(s, 8)), _tree(f"""CASE WHEN w = 8 AND h = 8 OR w = 8 * h OR h = 8 * w THEN 'leaf'
  WHEN w = h AND {_IN_R} AND NOT ({_IN_C}) THEN 'down' WHEN w = h AND NOT ({_IN_R}) THEN 'across'
  WHEN h > w AND (NOT ({_IN_R}) OR NOT ({_IN_C}) AND w >= 16 AND x + w / 4 >= width) THEN 'across' WHEN w > h AND (NOT ({_IN_C}) OR NOT ({_IN_R}) AND h >= 16 AND y + h / 4 >= height) THEN 'down'
  WHEN h >= 4 * w AND NOT ({_IN_R} AND {_IN_C}) THEN 'across' WHEN w >= 4 * h AND NOT ({_IN_R} AND {_IN_C}) THEN 'down' WHEN w > h THEN 'down' ELSE 'across' END""",
    "(SELECT (i + 1) * 8 AS width, (j + 1) * 8 AS height FROM (SELECT range AS i FROM range(8)), (SELECT range AS j FROM range(8)))"))

# --- palettes and predictors: no SQL, the tests hold them against plain versions
_query("block_palettes", lambda s, _: palettes.block_palettes(_gradient(s)).select("frame", "gy", "gx", F.array_join("colours", ",").alias("colours"), "sad"))


def block_predictors(spark: SparkSession, _: str) -> DataFrame:
    """Mean and plane predictors of 8 x 4 blocks, and chroma on a line of luma, from made-up references."""
    i = F.col("id")
    refs = lambda n, k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (i * k + j * 37) % 256)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(((i * 11 + j * 29) % 256).alias("l"), ((i * 5 + j * 17) % 256).alias("c")))
    d = spark.range(300).select("id", predictors.mean_block(refs(8, 3), refs(4, 5), 8, 4).alias("mean"), predictors.plane_block(refs(9, 3), refs(5, 5), 8, 4).alias("plane"), predictors.chroma_line(pairs).alias("line"))
    return d.select("id", *[F.array_join(c, ",").alias(c) for c in ("mean", "plane")], "line.a", "line.b", "line.shift")


_query("block_predictors", block_predictors)

# --- choices
_VALUE = "(x + y) % 200 + CASE WHEN (x // 8 + y // 8 * 3 + frame * 2) % 11 = 0 AND frame > 1 THEN 1 ELSE 0 END"
_query("reusable_units", lambda s, _: choice.reusable_units(patterns.grid(s, S.W, S.H, S.N).select("*", F.expr(_VALUE.replace("x // 8", "x div 8").replace("y // 8", "y div 8")).alias("v0"), F.lit(7).alias("v1"), F.lit(9).alias("v2")), 8), f"""
WITH s AS (SELECT frame, y // 8 AS gy, x // 8 AS gx, string_agg(({_VALUE})::VARCHAR, ',' ORDER BY y, x) AS d FROM {S.grid()} GROUP BY 1, 2, 3),
e AS (SELECT a.frame, a.gy, a.gx, coalesce(a.d = b.d, FALSE) AS same FROM s a LEFT JOIN s b ON b.frame = a.frame - 1 AND b.gy = a.gy AND b.gx = a.gx)
SELECT frame, gy, gx, same, NOT EXISTS (SELECT 1 FROM e o WHERE o.frame = e.frame AND o.gy <= e.gy AND o.gx <= e.gx AND NOT o.same) AS reused FROM e""")
_query("source_choice", lambda s, d: choice.choose_source(s.read.parquet(f"{d}/nation.parquet").select("n_regionkey", F.col("n_nationkey").alias("position"), F.col("n_name").alias("source")), ["n_regionkey"], "india", ("ia", "q")), """
SELECT n_regionkey, arg_min(n_name, (r, n_nationkey)) FILTER (r IS NOT NULL) AS source FROM (SELECT *, CASE WHEN lower(n_name) = 'india' THEN 0 WHEN contains(lower(n_name), 'india') OR contains(lower(n_name), 'ia') OR contains(lower(n_name), 'q') THEN 1 END AS r FROM nation) GROUP BY n_regionkey""")

_CASES = (
    ("av", "444:8", "lossless", ["fast"], None), ("xx", "444:8", "lossless", [], "codec"), ("av", "400:8", "", [], "format"), ("av", "420:8", "lossless", [], "lossless"),
    ("av", "420:8", "quantiser", ["qp=4"], "conflict qp"), ("av", "420:8", "", ["qp=4", "fast=no"], None), ("av", "420:8", "", ["qp=4", "qp=5"], "twice qp"), ("av", "420:8", "", ["fast=maybe", "qp=99"], "value fast"),
    ("av", "420:8", "", ["qp=99"], "value qp"), ("av", "420:8", "", ["deep=1"], "unknown deep"), ("av", "420:8", "", ["lossless"], "conflict lossless"), ("av", "420:8", "", ["qp=7", "tune=b"], None),
)


def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with configurations, one of twelve for each part."""
    cases = F.array(*[F.struct(F.lit(c).alias("codec"), F.lit(p).alias("pixels"), F.lit(r).alias("rate"), F.array(*map(F.lit, s)).cast("array<string>").alias("settings")) for c, p, r, s, _ in _CASES])
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(cases, (F.col("p_partkey") % len(_CASES)).cast("int")).alias("c"))
    takes = {"fast": specs.BOOLEANS, "qp": (0, 63), "tune": ("a", "b")}
    return p.select("p_partkey", specs.config_error(F.col("c.codec"), F.col("c.pixels"), F.col("c.rate"), F.col("c.settings"), name="av", formats=("420:8", "444:8"), lossless=("444:8",), takes=takes).alias("error"))


_query("config_errors", config_errors, "SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{c[4]}'" for k, c in enumerate(_CASES) if c[4]) + " END AS error FROM part")

# --- fixtures
_DRAW = "(('0x' || substr(md5('3:' || source || ':' || w || ':' || h || ':{what}'), 1, 8))::BIGINT % ({below}))"
_AX, _AY = "CASE WHEN sampling = '444' THEN 1 ELSE 2 END", "CASE WHEN sampling = '420' THEN 2 ELSE 1 END"
_query("crop_sweep", lambda s, _: fixtures.crop_sweep(s.range(6).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), (F.col("id") * 50 + 64).alias("width"), (F.col("id") * 30 + 65).alias("height"), (F.col("id") * 9 + 3).alias("frames"), F.element_at(F.array(*map(F.lit, ("420", "422", "444"))), (F.col("id") % 3 + 1).cast("int")).alias("sampling")), 3), f"""
WITH s AS (SELECT 's' || range AS source, range * 50 + 64 AS width, range * 30 + 65 AS height, range * 9 + 3 AS frames, ['420', '422', '444'][range % 3 + 1] AS sampling FROM range(6)),
c AS (SELECT *, CAST(i AS INT) AS w, CAST(j AS INT) AS h FROM s, (SELECT range AS i FROM range(8, 65, 8)), (SELECT range AS j FROM range(8, 65, 8))),
d AS (SELECT source, w, h, {_DRAW.format(what="start", below="frames - 2")} AS start, {_DRAW.format(what="x", below=f"(width - w) // ({_AX}) + 1")} * {_AX} AS x, {_DRAW.format(what="y", below=f"(height - h) // ({_AY}) + 1")} * {_AY} AS y, {_DRAW.format(what="place", below=1 << 31)} AS place FROM c)
SELECT *, printf('%s_%dx%d_f%03d_x%04d_y%04d', source, w, h, start, x, y) AS name FROM d""")
