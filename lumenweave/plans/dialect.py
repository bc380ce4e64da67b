"""One text for a relational plan, rendered for Spark and for the SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    """Spellings of Spark SQL."""

    name = "spark"

    @staticmethod
    def div(a: str, b: object) -> str:
        return f"(({a}) DIV ({b}))"

    @staticmethod
    def range(n: int) -> str:
        return f"(SELECT id AS i FROM range({n}))"

    @staticmethod
    def percentile(p: float, x: str) -> str:
        return f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {x}) AS DOUBLE)"

    @staticmethod
    def text(x: str) -> str:
        return f"CAST({x} AS STRING)"

    @staticmethod
    def extract(x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    @staticmethod
    def explode_prefixes(x: str) -> str:
        return f"explode(transform(sequence(1, size(split({x}, '[.]'))), k -> array_join(slice(split({x}, '[.]'), 1, k), '.')))"

    inf = "double('infinity')"
    sha256 = staticmethod(lambda x: f"sha2({x}, 256)")
    year = staticmethod(lambda x: f"year({x})")
    fixed = staticmethod(lambda x, n: f"format_string('%.{n}f', CAST({x} AS DOUBLE))")
    binary = staticmethod(lambda x: f"bin({x})")
    argmin = staticmethod(lambda v, k: f"min_by({v}, struct({k}))")
    listed = staticmethod(lambda name, n: f"array_join(transform(array_sort(collect_list(struct(-{n} AS k, {name} AS v))), x -> concat(x.v, '=', -x.k)), ',')")
    values = staticmethod(lambda rows, names: f"(SELECT * FROM VALUES {rows} AS t({names}))")


class Oracle(Spark):
    """Spellings of the oracle's SQL."""

    name = "oracle"

    @staticmethod
    def div(a: str, b: object) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def range(n: int) -> str:
        return f"(SELECT range AS i FROM range({n}))"

    @staticmethod
    def percentile(p: float, x: str) -> str:
        return f"CAST(quantile_disc({x}, {p}) AS DOUBLE)"

    @staticmethod
    def text(x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    @staticmethod
    def extract(x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    @staticmethod
    def explode_prefixes(x: str) -> str:
        return f"unnest(list_transform(range(1, len(string_split({x}, '.')) + 1), lambda k: array_to_string(string_split({x}, '.')[1:k], '.')))"

    inf = "CAST('inf' AS DOUBLE)"
    sha256 = staticmethod(lambda x: f"sha256({x})")
    year = staticmethod(lambda x: f"CAST(year({x}) AS INTEGER)")
    fixed = staticmethod(lambda x, n: f"format('{{:.{n}f}}', CAST({x} AS DOUBLE))")
    binary = staticmethod(lambda x: f"bin({x})")
    argmin = staticmethod(lambda v, k: f"arg_min({v}, row({k}))")
    listed = staticmethod(lambda name, n: f"string_agg({name} || '=' || {n}, ',' ORDER BY {n} DESC, {name})")
    values = staticmethod(lambda rows, names: f"(SELECT * FROM (VALUES {rows}) AS t({names}))")


def plan(text: Callable[[type[Spark]], str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(Spark query, oracle SQL) of a text that names tables as they are."""
    own, other = text(Spark), text(Oracle)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", own)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(own)

    return run, other
