"""Quality by importance resampling.

Words and word pairs of a text are hashed into `buckets`; two bags of buckets are counted, one over
target texts (a bounded sample of those labelled good) and one over all raw texts. A text's log
weight is the sum over its n-grams of log(target share / raw share). Documents are drawn without
replacement in proportion to their weight by Gumbel top-k: the k largest log weights plus
Gumbel noise, which is a function of doc_id and seed. The k-th largest key is found exactly by
narrowing counts of value ranges, so nothing is sorted or collected but a bounded remainder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table, uniform
from .kernels import ALNUM, _upto, mix, slices, words

_U = np.uint64


def _grams(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of each word and each pair of neighbouring words."""
    doc, _, _, h = words(buf, offs, ALNUM)
    if len(h) == 0:
        return doc, np.empty(0, np.int64)
    pair = mix(h[:-1] * _U(0xD6E8FEB86659FD93) + h[1:])
    ok = doc[1:] == doc[:-1]
    return np.concatenate([doc, doc[:-1][ok]]), (np.concatenate([h, pair[ok]]) % _U(buckets)).astype(np.int64)


def count_models(docs: DataFrame, target_ids: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over (target, all) documents, in one scan of all of them. target_ids is bounded by the caller and broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            flag = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(batch.column(1), batch.column(0)):
                doc, b = _grams(buf, offs, buckets)
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[flag[rows][doc]], minlength=buckets)
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(raw[k]), pa.array(target[k])], names=["b", "raw", "target"])

    flagged = docs.join(F.broadcast(target_ids.select("doc_id").distinct().withColumn("hit", F.lit(True))), "doc_id", "left").select("text", "hit")
    got = flagged.mapInArrow(run, "b int, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    b = got["b"].to_numpy()
    raw[b], target[b] = got["raw"].to_numpy(), got["target"].to_numpy()
    return target, raw


def weigh(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight of each row."""
    spark, buckets = docs.sparkSession, len(log_ratio)
    shared = spark.sparkContext.broadcast(log_ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for rows, buf, offs in slices(batch.column(0), batch.column(1)):
                n = len(offs) - 1
                doc, b = _grams(buf, offs, buckets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(np.bincount(doc, minlength=n)[:n].astype(np.int64)), pa.array(np.bincount(doc, weights=ratio[b], minlength=n)[:n].astype(float))], names=["doc_id", "n_grams", "log_weight"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_largest(df: DataFrame, col: str, k: int, *, bins: int = 4096, rest: int = 20_000) -> float | None:
    """The k-th largest value of a double column without nulls, by narrowing; None if there are fewer rows."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        inside = df.where(F.col(col).between(lo, hi))
        if n <= rest:
            return sorted((r[0] for r in inside.select(col).collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return sorted(((r[0], r[1]) for r in inside.groupBy(col).count().collect()), reverse=True)[0][0] if k == 1 else _among(inside, col, k)
        at = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).alias("i")
        for r in inside.groupBy(at).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).orderBy(F.desc("i")).collect():
            if k <= r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]
    return lo


def _among(df: DataFrame, col: str, k: int) -> float:
    for value, n in df.groupBy(col).count().orderBy(F.desc(col)).collect():
        if k <= n:
            return value
        k -= n
    raise ValueError("k exceeds the rows")


def resample(docs: DataFrame, labels: DataFrame, *, share: float = 0.85, buckets: int = 20_000, max_target: int = 20_000, smooth: float = 1.0, temper: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, n_grams, log_weight, key, selected for every document.

    k is `share` of the documents that have words, rounded up; rows tied at the k-th key are all selected. Texts without words, null or
    empty, have weight and key null and are never selected. Texts of any length are weighed whole. Rows that repeat a doc_id and text have
    the same key; a null doc_id draws the noise of null. Without labels all weigh alike. An empty table gives no rows. Other columns,
    whatever their names, are ignored. With `temper` the key's weight is that of a text of so many n-grams (mean log ratio times temper).
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    target, raw = count_models(docs, good, buckets)
    p, q = target + smooth, raw + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum()) if target.sum() else np.zeros(buckets)
    gumbel = -F.log(-F.log(uniform(F.col("doc_id"), seed=seed)))
    weight = F.when(F.col("n_grams") > 0, F.col("log_weight"))
    got = cut(weigh(docs, ratio).select("doc_id", "n_grams", weight.alias("log_weight"), F.when(F.col("n_grams") > 0, (F.col("log_weight") if temper is None else F.col("log_weight") / F.col("n_grams") * temper) + gumbel).alias("key")))
    keys = got.where("key is not null").select("key")
    n = keys.count()
    least = kth_largest(keys, "key", int(np.ceil(share * n)))
    selected = F.lit(False) if least is None else F.coalesce(F.col("key") >= F.lit(least), F.lit(False))
    return got.select("doc_id", "n_grams", "log_weight", "key", selected.alias("selected"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
