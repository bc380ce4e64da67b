"""URL rules by a Bloom filter cascade: exact membership for every key of the corpus, without a join.

The key universe of a corpus is every (host suffix, path prefix) of its URLs that could be a rule: as many
labels, and as long a prefix, as some rule has. Level 1 is a Bloom filter over the listed keys; level 2 one
over the universe's keys that level 1 takes for listed; level 3 one over the listed keys that level 2 takes
for false positives; and so on until a level errs on none. A key's first level that says no tells, by
its parity, whether it is listed. Filters are arrays of 64-bit words built by aggregation and read as
scalar subqueries; all of it is DataFrame functions. Where a level would need a filter over the bound, the keys are
dealt by hash to as many shares as it takes, each with cascades of its own, and the urls are read once for each share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import MOST_BITS, Level, bloom
from .common import ascii_lower, cut, table


class TooMany(Exception):
    """A level would need a filter over the bound."""


@dataclass
class Cascade:
    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Exact for null-free keys of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(self.levels[k - 1].says(key), out).otherwise(F.lit(k % 2 == 0))
        return out


def build(listed: DataFrame, universe: DataFrame, *, first_bits: int = 10, bits: int = 5, hashes: int = 4, most_levels: int = 60, seed: int = 0, most_bits: int = MOST_BITS) -> Cascade:
    """The cascade for `listed` (key) over `universe` (key). Nulls and repeats are ignored. An empty list: no level, nothing is listed.

    TooMany: a level needs over most_bits bits; the keys are to be dealt to several cascades, as `judge` does.
    """
    listed = cut(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if n == 0:
        return Cascade([])
    if n * first_bits > most_bits:
        raise TooMany
    levels = [bloom(listed, n, seed + 1, first_bits, hashes, most_bits)]
    sides = [listed, cut(universe.where("key is not null").select("key").where(levels[0].says(F.col("key"))).distinct().join(listed, "key", "left_anti"))]
    while len(levels) < most_levels:
        own = sides[len(levels) % 2]
        n = own.count()
        if n == 0:
            return Cascade(levels)
        if n * bits > most_bits:
            raise TooMany
        levels.append(bloom(own, n, seed + len(levels) + 1, bits, hashes, most_bits))
        other = (len(levels)) % 2
        sides[other] = cut(sides[other].where(levels[-1].says(F.col("key"))))
    raise ValueError("the cascade did not end")


def share_of(key: Column, shares: int) -> Column:
    """Which of so many shares of the key universe a key is in."""
    return F.pmod(F.xxhash64(key, F.lit(99)), F.lit(shares))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or a url without ://."""
    part = "://([^/?#]*)([^?#]*)"
    return F.coalesce(ascii_lower(F.regexp_extract(url, part, 1)), F.lit("")), F.coalesce(F.regexp_extract(url, part, 2), F.lit(""))


def _cascades(named: DataFrame, universe: DataFrame, most_bits: int) -> list[tuple[Cascade, Cascade]]:
    """(block, allow) for each share of the keys; twice as many shares until no level is over the bound."""
    shares = 1
    while True:
        try:
            out = []
            for i in range(shares):
                own = [x.where(share_of(F.col("key"), shares) == i) for x in (named, universe)] if shares > 1 else [named, universe]
                out.append(tuple(build(own[0].where(F.col("verdict") == v).select("key"), own[1], seed=s, most_bits=most_bits) for v, s in (("block", 0), ("allow", 500))))
            return out
        except TooMany:
            shares *= 2


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    rules: host, path, verdict ('allow' or 'block'), of any number. A rule fits its host and all subdomains of it if the path starts with
    the rule's; the longest fitting rule, in characters of host and path together, wins, a block rule over an allow rule of equal length.
    Where none fits, the url's keys are in neither cascade, so it is on no list: verdict `default`, rule null. Null urls have empty
    host and path. Rows are judged each, repeats and null page_ids too. Urls of any length are judged whole. Other columns of pages, whatever
    their names, are not read. An empty page table gives no rows, an empty rule table gives `default` everywhere.
    """
    rules = cut(rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null"))
    shape = rules.select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()  # shapes of rules, not rules
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # candidate keys of a url, shortest first; a host of fewer labels, or a path of fewer characters, has no such key
    shapes = sorted({(r["labels"], r["chars"]) for r in shape})
    labels = F.size(F.split("host", "\\."))
    cand = F.array(*[
        F.when((labels >= l) & (F.length("path") >= c), F.concat(F.substring_index("host", ".", -l), F.substring("path", 1, c))) for l, c in shapes
    ]) if shapes else F.array().cast("array<string>")
    urls = urls.withColumn("keys", F.array_distinct(F.filter(cand, lambda x: x.isNotNull())))
    universe = urls.select(F.explode("keys").alias("key")).distinct()
    universe = cut(universe)
    cascades = _cascades(rules.select(F.concat("host", "path").alias("key"), "verdict"), universe, most_bits)
    # every cascade test is spelled out by candidate: subqueries may not stand within a lambda
    best, verdict = F.lit(None).cast("string"), F.lit(default)
    n_keys, shares = len(shapes), len(cascades)
    for i, (block, allow) in enumerate(cascades):
        for j in range(n_keys):
            k = F.get("keys", F.lit(j))
            found = F.when(k.isNull(), F.lit(None).cast("string")).when(block.has(k), F.lit("block")).when(allow.has(k), F.lit("allow"))
            urls = urls.withColumn(f"k{j}", found if shares == 1 else F.when(share_of(k, shares) == i, found).otherwise(F.col(f"k{j}") if i else F.lit(None).cast("string")))
        if shares > 1:
            urls = cut(urls)  # the filters of one share at a time are in memory
    for j in range(n_keys):
        k, v = F.get("keys", F.lit(j)), F.col(f"k{j}")
        longer = v.isNotNull() & (F.col("rule").isNull() | (F.length(k) > F.length("rule"))) if j else v.isNotNull()
        was_rule, was = (F.col("rule"), F.col("verdict")) if j else (best, verdict)
        urls = urls.withColumn("better", longer).withColumn("verdict", F.when(F.col("better"), v).otherwise(was)).withColumn("rule", F.when(F.col("better"), k).otherwise(was_rule))
    if n_keys == 0:
        urls = urls.withColumn("rule", best).withColumn("verdict", verdict)
    return urls.select("page_id", "host", "path", "rule", "verdict")


#: fixed values of the query: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = """
WITH q(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT u.*, rh || rp AS rule, q.verdict FROM u LEFT JOIN q ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC NULLS LAST) AS k FROM f)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1
"""
