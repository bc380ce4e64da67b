"""What the corpus operators share: reading tables, cutting lineage, components of a link graph."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir. Where that is unset, a local master gets a new folder; on a cluster it is an error."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not said:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = tempfile.mkdtemp(prefix="lumenweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(said)
    path = sc._jvm.org.apache.hadoop.fs.Path(said)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless their import path has it already."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if _ROOT in paths or Path.cwd().resolve() == _ROOT or getattr(sc, "_lumenweave_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="lumenweave-zip-")) / "lumenweave_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (_ROOT / "lumenweave").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._lumenweave_shipped = True


_written: list[str] = []
_cuts = itertools.count(1)
#: after this many cuts the driver collects its garbage
COLLECT = 8


def cut(df: DataFrame) -> DataFrame:
    """Materialises df as Parquet in the shared folder and reads it back: what it cost is paid once and lineage ends. `sweep` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenweave-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    if next(_cuts) % COLLECT == 0:  # loops of small jobs leave plans and classes behind, and the heap grows with them
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Removes the folders that `cut` and the archive writer made, from the since-th on: for callers whose results are written elsewhere already."""
    sc = spark.sparkContext
    while len(_written) > since:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._jvm.System.gc()  # the driver lets go of the plans and classes of what is done


def mark() -> int:
    """How many folders have been made so far, for `sweep`."""
    return len(_written)


def made(path: str) -> str:
    """Notes a folder of the shared one for `sweep`."""
    _written.append(path)
    return path


def trim() -> None:
    """Gives memory that Python no longer uses back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) from the columns' values."""
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def heavy_join(rows: DataFrame, groups: DataFrame, on: list[str], n: str, most: int = 200) -> DataFrame:
    """rows joined with groups, which has one row for each key and its count in column `n` (left out of the result).

    Keys with a most-th of all counted rows or more, which are `most` at most, are broadcast, so their rows stay where they are; all other
    keys go through a shuffle in which none has more than that share. Keys are not null.
    """
    total, top = groups.agg(F.sum(n), F.max(n)).first()
    if total is None or top * most < total:
        return rows.join(groups.drop(n), on)
    heavy = F.broadcast(groups.where(F.col(n) * most >= total).drop(n))  # at most `most` rows
    near = rows.join(heavy, on)
    far = rows.join(heavy.select(*on), on, "left_anti").join(groups.where(F.col(n) * most < total).drop(n), on)
    return near.union(far.select(*near.columns))


#: links up to this number are worked on in one task, where no step of a round needs a shuffle or a broadcast; more are dealt by node
ONE_TASK = 200_000


def components(links: DataFrame, *, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of links (a, b): one row (id, component) for each id in a link, component being the least id.

    Alternates large-star and small-star steps, each a groupBy and a join, until no edge changes; the number of rounds grows with the
    logarithm of the links. Hub nodes are handled by partial aggregation and joins against one row a node; nothing is
    collected, and each round's edges are cut to the shared folder. Up to `one_task` links stay in one partition, and the same steps
    run there without an exchange: a round is then one small plan for the driver, not one for each exchange.
    """
    first = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    few = first.count() <= one_task  # steps never add links: each edge gives one of the next round's at most
    gathered = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    joined = (lambda df: df.hint("merge")) if few else (lambda df: df)  # both sides are in one partition already
    turned = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    edges = gathered(first)
    before = None
    while True:
        both = edges.select(turned.alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u is tied to u's least neighbour
        large = both.join(joined(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joined(low), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = gathered(cut(small))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    star = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m"))
    nodes = gathered(first).select(turned.alias("e")).select(F.col("e.u").alias("id")).distinct()
    return nodes.join(joined(star), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
