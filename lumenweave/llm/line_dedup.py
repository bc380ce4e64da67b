"""Repeated runs of lines, found over the whole corpus by prefix doubling; later copies are deleted.

Lines are trimmed, blank ones do not count, and each gets a number by its place in the sorted order of
line fingerprints. Round k ranks every position by its next 2^k lines: the pair (rank of the first half,
rank of the second half) is sorted across the cluster and the sorted place is the new rank. That is a
suffix array to depth 2^k, and the positions of one rank are its interval of common prefix 2^k; an
interval of one position is never carried on. Doubling ends at the depth of the longest run asked for.

A run counts if it has `least_words` words. Every line of a maximal repeated run lies in the shortest
such run that starts at it or in the one that ends with the maximal run, so it is enough to look at the
shortest run from each line on and up to each line. A run of l lines is named by (l, rank of its first 2^k
lines, rank of its last 2^k lines), 2^k <= l < 2^(k+1): equal names are equal runs. All but the first of a
name, by document and line, are later copies; overlapping ones merge to the maximal runs that are deleted.

DataFrame functions only. Keys that many rows share occur in aggregations with partial sums and in joins
against one row for each key; the rows of the few keys with a 200th of all or more meet a broadcast of those, where they are. Windows span one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, heavy_join, table

AT = ["d", "g", "p"]  # document, fingerprint of its text, line


def _lines(docs: DataFrame, least_words: int) -> DataFrame:
    """A row for each line that is not blank: its place p among them, its index i, two fingerprints, and the lines in the
    shortest run of enough words from it on (fore) and up to it (back), 0 if there is none."""
    n = int(least_words)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("g"), F.split("text", "\n").alias("l"))
    docs = docs.select("d", "g", F.expr("filter(transform(l, (x, i) -> struct(trim(BOTH ' \t\r' FROM x) AS t, i AS i)), x -> x.t <> '')").alias("l"))
    docs = docs.select("d", "g", "l", F.expr("transform(l, x -> regexp_count(x.t, '[^ \\t]+'))").alias("w"))
    step = f"(a, x) -> if(a.s >= {n}, a, struct(a.s + x AS s, a.k + 1 AS k)), a -> if(a.s >= {n}, a.k, 0)"
    fore = f"transform(w, (_, i) -> if(w[i] >= {n}, 1, aggregate(slice(w, i + 1, {n}), struct(0 AS s, 0 AS k), {step})))"
    back = f"transform(w, (_, i) -> if(w[i] >= {n}, 1, aggregate(reverse(slice(w, greatest(1, i + 2 - {n}), least(i + 1, {n}))), struct(0 AS s, 0 AS k), {step})))"
    docs = docs.select("d", "g", F.posexplode(F.expr(f"arrays_zip(transform(l, x -> struct(xxhash64(x.t) AS h, xxhash64(1, x.t) AS h2, x.i AS i)), {fore}, {back})")).alias("p", "x"))
    return docs.select("d", "g", "p", F.col("x.0.h").alias("h"), F.col("x.0.h2").alias("h2"), F.col("x.0.i").alias("i"), F.col("x.1").alias("fore"), F.col("x.2").alias("back"))


def _named(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, t) for the pairs that occur more than once, n times; t grows in the order of (a, b)."""
    often = rows.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1")
    return cut(often.orderBy(a, b).select(a, b, "n", F.monotonically_increasing_id().alias("t")))


def _first(lines: DataFrame) -> DataFrame:
    """Level 0: (d, g, p, r, i, fore, back), r the rank of the line itself, for lines that recur."""
    first = heavy_join(lines, _named(lines, "h", "h2"), ["h", "h2"], "n").select(*AT, F.col("t").alias("r"), "i", "fore", "back")
    return cut(first.dropDuplicates(AT))  # rows that repeat a document are one


def later_copies(docs: DataFrame, least_words: int) -> DataFrame:
    """(d, g, i): the lines of later copies."""
    lines = cut(_lines(docs, least_words))
    zero = _first(lines)
    runs = zero.where("fore > 0").select(*AT, F.col("fore").alias("k")).union(zero.where("back > 0").select("d", "g", (F.col("p") - F.col("back") + 1).alias("p"), F.col("back").alias("k"))).distinct()
    runs = cut(runs)
    depth = runs.agg(F.max("k")).first()[0] or 1
    levels = _deeper(zero, depth)
    named = None
    for k, level in enumerate(levels):
        one = level.select(*AT, "r")
        own = runs.where(F.col("k").between(2**k, 2 ** (k + 1) - 1)).join(one, AT)
        if k:
            own = own.select("d", "g", "p", "k", F.col("r").alias("ra"), (F.col("p") + F.col("k") - 2**k).alias("q"))
            own = own.join(one.select("d", "g", F.col("p").alias("q"), F.col("r").alias("rb")), ["d", "g", "q"]).select(*AT, "k", "ra", "rb")
        else:
            own = own.select(*AT, "k", F.col("r").alias("ra"), F.col("r").alias("rb"))
        named = own if named is None else named.union(own)
    named = cut(named)
    firsts = cut(named.groupBy("k", "ra", "rb").agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = heavy_join(named, firsts, ["k", "ra", "rb"], "n").where(F.struct(*AT) != F.col("first")).groupBy(*AT).agg(F.max(F.col("p") + F.col("k")).alias("reach"))
    w = Window.partitionBy("d", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    gone = zero.select(*AT, "i").join(copies, AT, "left").withColumn("reach", F.max("reach").over(w)).where("reach > p")
    return gone.select("d", "g", "i")


def _deeper(zero: DataFrame, depth: int) -> list[DataFrame]:
    """Levels 0, 1, ... of ranks, up to runs of `depth` lines."""
    levels = [zero]
    while 2 ** len(levels) <= depth:
        half, was = 2 ** (len(levels) - 1), levels[-1].select(*AT, "r")
        pairs = cut(was.join(was.select("d", "g", (F.col("p") - half).alias("p"), F.col("r").alias("s")), AT))
        levels.append(cut(heavy_join(pairs, _named(pairs, "r", "s"), ["r", "s"], "n").select(*AT, F.col("t").alias("r"))))
        if levels[-1].isEmpty():
            break
    return levels


def dedup(docs: DataFrame, *, least_words: int = 50) -> DataFrame:
    """All columns of docs with `text` less its deleted lines, and n_lines, n_removed (integers), removed (line indices from 0).

    A run of lines with least_words words or more is deleted wherever it occurs but first, in order of doc_id and line. Lines
    are compared trimmed of blanks; blank lines neither count nor break a run, and stay. Null texts and rows without doc_id are
    left as they are, with null counts. Rows that repeat doc_id and text get the same result; a doc_id with other texts is a document for each, in order of
    their fingerprints. Texts of any length are taken whole, an empty text has one blank line, an empty table gives no rows. Columns named like the added ones are replaced.
    """
    gone = later_copies(docs.select("doc_id", "text"), least_words)
    per = gone.groupBy("d", "g").agg(F.sort_array(F.collect_list("i")).alias("removed")).withColumnsRenamed({"d": "doc_id", "g": "__g"})
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed", "__g")]
    out = docs.select(*kept).withColumn("__g", F.xxhash64("text")).join(per, ["doc_id", "__g"], "left")
    lines = F.split("text", "\n")
    takes_part = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    # lines are split once for a text, then taken by index
    out = out.withColumn("__l", F.when(F.col("removed").isNotNull(), lines))
    less = F.expr("array_join(transform(array_except(sequence(0, size(__l) - 1), removed), i -> __l[i]), '\n')")
    text = F.when(F.col("removed").isNotNull(), less).otherwise(F.col("text"))
    n_lines = F.when(takes_part, F.when(F.col("removed").isNotNull(), F.size("__l")).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1))
    n_removed = F.when(takes_part, F.coalesce(F.size("removed"), F.lit(0)))
    removed = F.when(takes_part, F.coalesce("removed", F.array().cast("array<int>")))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], n_lines.alias("n_lines"), n_removed.alias("n_removed"), removed.alias("removed"))


def brute_force(docs: list[tuple], least_words: int = 50) -> dict:
    """What op1 returns for small lists: every run of enough words that occurs earlier is deleted."""
    import re

    own = {}
    for i, t in docs:
        ls = [(k, x.strip(" \t\r")) for k, x in enumerate((t or "").split("\n"))]
        own[i] = [(k, x, len(re.findall(r"[^ \t]+", x))) for k, x in ls if x]
    seen, gone = set(), {i: set() for i in own}
    for i in sorted(own):
        ls = own[i]
        for p in range(len(ls)):
            words = 0
            for e in range(p, len(ls)):
                words += ls[e][2]
                if words >= least_words:
                    run = tuple(x[1] for x in ls[p : e + 1])
                    if run in seen:
                        gone[i].update(x[0] for x in ls[p : e + 1])
                    seen.add(run)
    return {i: ("\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]), sorted(gone[i])) for i, t in docs}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


#: op1 by the same runs, each named by its whole text instead of ranks
OP1_SQL = r"""
WITH l AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
k AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[^ \t]+')) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE t <> ''),
n AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM k),
j AS (SELECT a.doc_id, a.p AS b, o.p AS e FROM n a JOIN n o ON o.doc_id = a.doc_id AND o.p BETWEEN a.p AND a.p + 50 AND o.c - a.c + a.k >= 50),
r AS (SELECT doc_id, b, min(e) AS e FROM j GROUP BY doc_id, b UNION SELECT doc_id, max(b), e FROM j GROUP BY doc_id, e),
s AS (SELECT r.doc_id, b, e, string_agg(t, chr(10) ORDER BY p) AS s FROM r JOIN n ON n.doc_id = r.doc_id AND p BETWEEN b AND e GROUP BY r.doc_id, b, e),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, b) AS nth FROM s) WHERE nth > 1),
g AS (SELECT DISTINCT n.doc_id, n.i FROM n JOIN y ON y.doc_id = n.doc_id AND n.p BETWEEN y.b AND y.e),
z AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(list_aggregate(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), 'string_agg', chr(10)), '') END AS text,
  CAST(CASE WHEN doc_id IS NOT NULL THEN len(string_split(text, chr(10))) END AS INT) AS n_lines, CAST(CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL THEN coalesce(len(gone), 0) END AS INT) AS n_removed,
  CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL THEN coalesce(array_to_string(gone, ','), '') END AS removed FROM documents LEFT JOIN z USING (doc_id)"""
