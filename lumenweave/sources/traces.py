"""Scans of measurement files: JSON lines, counter lines, quality logs, matrix reports, vector manifests."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VECTORS = "set string, description string, name string, width int, height int, frames int, format string, pattern string, fps string, lossless boolean, codecs array<string>, filters array<string>, path string, source string, crop_x int, crop_y int"
# fixed values: spellings of true and false
TRUE, FALSE = ("1", "true", "yes", "on"), ("", "0", "false", "no", "off")


class ManifestError(ValueError):
    """A manifest that does not say what it must."""


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, kinds: list[str] | None = None) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped, a malformed one ends the query; kinds go down to the scan."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return df.where(F.col("kind").isin(kinds)) if kinds is not None else df


def counter_lines(lines: DataFrame, tag: str, value: str = "value") -> DataFrame:
    """Lines `<tag> <label> k=v k=v ...` with two more columns, label and counts (a map); other lines go.

    Values that are no whole numbers are left out; of a key given twice, the last stands.
    """
    form = f"^\\Q{tag}\\E\\s+(\\S+)\\s+(.*)$"
    text = F.trim(F.col(value))
    number = lambda t: F.substring_index(t, "=", -1).try_cast("long")
    key = lambda t: F.substring_index(t, "=", 1)
    good = F.filter(F.split(F.regexp_extract(text, form, 2), "\\s+"), lambda t: t.rlike("^[^=]*=[+-]?[0-9]+$") & number(t).isNotNull())
    last = F.filter("_t", lambda t, i: ~F.exists(F.slice(F.col("_t"), i + 2, F.size("_t")), lambda u: key(u) == key(t)))
    out = lines.where(text.rlike(form)).withColumn("label", F.regexp_extract(text, form, 1)).withColumn("_t", good)
    return out.withColumn("counts", F.map_from_entries(F.transform(last, lambda t: F.struct(key(t), number(t))))).drop("_t")


def counter_totals(counted: DataFrame, *by: str) -> DataFrame:
    """(by..., key, n, total) over the maps of counter_lines."""
    return counted.select(*by, F.explode("counts").alias("key", "v")).groupBy(*by, "key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def mean_with_infinity(v: Column) -> Column:
    """An aggregate: the mean; infinite if all values are, null if only some are."""
    inf = F.lit(float("inf"))
    some, n = F.count_if(v == inf), F.count(v)
    return F.when(some == 0, F.avg(v)).when(some == n, inf)


def quality_log(lines: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by..., frames, psnr_all) of log lines that hold psnr_all= with a number or inf, all of a line's counted."""
    found = F.explode(F.regexp_extract_all(F.col(value), F.lit("psnr_all=(inf|[0-9]+(?:\\.[0-9]+)?)"), 1))
    v = F.when(F.col("q") == "inf", F.lit(float("inf"))).otherwise(F.col("q").try_cast("double"))
    return lines.select(*by, found.alias("q")).groupBy(*by).agg(F.count("*").alias("frames"), mean_with_infinity(v).alias("psnr_all"))


def matrix_report(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("codec", "mode_key", "filename")) -> DataFrame:
    """Rows of a report's `results`; of rows with equal keys the last stands."""
    doc = spark.read.schema(f"results array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = doc.select(F.posexplode("results").alias("_at", "r")).select("_at", "r.*")
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_at", "_k")


def _words(text: str) -> list[str]:
    return [w.strip() for w in text.split("|") if w.strip()]


def parse_manifest(text: str, where: str) -> list[dict]:
    """Vectors of one manifest: `#` lines hold directives, the first other line the columns."""
    about, rows = "", []
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("#"):
            key, _, body = s[1:].strip().partition("=")
            about = body.strip() if key == "description" else about
        elif s:
            rows.append(line)
    out = []
    for row in csv.DictReader(io.StringIO("\n".join(rows))):
        get = lambda k, r=row: (r.get(k) or "").strip()

        def number(k: str, least: int, needed: bool = False, get=get) -> int | None:
            t = get(k)
            if not t and not needed:
                return None
            if not (t.isascii() and t.isdigit()) or int(t) < least:
                raise ManifestError(f"{where}: {get('name') or 'a row'} has no {k} of at least {least}")
            return int(t)

        if not get("name") or not get("pattern"):
            raise ManifestError(f"{where}: a row has no name or pattern")
        later = get("pattern") == "source_file" and get("path").lower().endswith(".y4m")  # the file's header says the rest
        if get("lossless").lower() not in TRUE + FALSE:
            raise ManifestError(f"{where}: {get('name')}: lossless is neither true nor false")
        if not get("format") and not later:
            raise ManifestError(f"{where}: {get('name')} has no format")
        codecs = None if not get("codecs") else [] if get("codecs").lower() == "none" else [c.lower() for c in _words(get("codecs"))]
        out.append({
            "set": os.path.splitext(os.path.basename(where))[0], "description": about, "name": get("name"),
            "width": number("width", 1, not later), "height": number("height", 1, not later), "frames": number("frames", 1, True),
            "format": get("format") or None, "pattern": get("pattern"), "fps": get("fps") or None, "lossless": get("lossless").lower() in TRUE,
            "codecs": codecs, "filters": _words(get("filters")), "path": get("path") or None, "source": get("source") or None,
            "crop_x": number("crop_x", 0), "crop_y": number("crop_y", 0),
        })
    if not out:
        raise ManifestError(f"{where}: no vectors")
    return out


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each vector of manifest files, of any order of columns; a manifest is small and read as one text."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in VECTORS.split(", ")]
        for part in parts:
            for text, where in zip(part["value"], part["path"], strict=True):
                df = pd.DataFrame(parse_manifest(text, where), columns=names)
                yield df.astype({c: "Int32" for c in ("width", "height", "frames", "crop_x", "crop_y")})

    return files.mapInPandas(run, VECTORS)


def for_codec(vectors: DataFrame, codec: str) -> DataFrame:
    """Vectors without a list of codecs take any."""
    return vectors.where(F.col("codecs").isNull() | F.array_contains("codecs", codec.lower()))
