"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree is learned from a bounded sample of labelled
documents and then frozen. A byte costs -log2 of its share in the longest context that the tree
has (escape method C: a context with n symbols, d of them distinct, gives a symbol count / (n + d)
and the escape d / (n + d)); each escape adds its own cost and goes to the next shorter context, in
the end to a uniform code. A text's code length under a language is the exact sum over its bytes;
the shortest wins, and the score is its share of the probability 2^-length over all languages.
Contexts that occur fewer than four times in all languages together have no node of their own: their bytes are coded in the next shorter one.
The trees are merged into one whose nodes hold the costs for all languages, so a text is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, ship, table
from .kernels import slices

_SIMPLE = np.arange(256, dtype=np.uint8)
_SIMPLE[65:91] += 32  # A-Z
_SIMPLE[48:58] = 48  # digits
_SIMPLE[[9, 10, 11, 12, 13]] = 32


@dataclass
class Trees:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    space: int
    steps: list[np.ndarray]  # by depth: node * symbols + symbol -> node
    cost: np.ndarray  # (node * symbols + symbol, language)
    symbols: int


def _contexts(sym: np.ndarray, k: int, a: int) -> np.ndarray:
    """For each position from `order` on: the k symbols before it as a number, nearest symbol most significant."""
    c = np.zeros(len(sym), np.int64)
    for j in range(1, k + 1):
        c = c * a
        c[j:] += sym[:-j]
    return c


def fit(samples: dict[str, list[str]], *, order: int = 4, table_mb: int = 48) -> Trees | None:
    """Learns the merged tree from texts by language. Contexts are kept from the most frequent down while the table stays under table_mb."""
    langs = sorted(samples)
    texts = {l: _SIMPLE[np.frombuffer(b"".join(b" " * order + t.encode("utf-8", "replace") for t in samples[l]), np.uint8)] for l in langs}
    langs = [l for l in langs if len(texts[l]) > order]
    if not langs:
        return None
    seen = np.unique(np.concatenate([np.unique(texts[l]) for l in langs] + [np.array([32], np.uint8)]))
    a = len(seen) + 1
    symbol = np.full(256, a - 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    symbol = symbol[_SIMPLE]
    space = int(symbol[32])
    syms = {l: symbol[texts[l]] for l in langs}
    most = max(64, table_mb * (1 << 20) // (4 * a * len(langs)))
    # contexts by depth, most frequent first over all depths; a kept context's shorter ones are at least as frequent, so kept too
    found = []
    for k in range(1, order + 1):
        c, n = np.unique(np.concatenate([_contexts(syms[l], k, a)[order:] for l in langs]), return_counts=True)
        found.append((c[n >= 4], n[n >= 4]))
    counts = np.sort(np.concatenate([n for _, n in found]))[::-1]
    least = counts[most - 1] + 1 if len(counts) >= most else 0
    kept = [c[n >= least] for c, n in found]
    base = np.concatenate([[0, 1], 1 + np.cumsum([len(c) for c in kept])])  # first node of each depth
    nodes = int(base[-1])
    cost = np.full((1, a, len(langs)), np.log2(256.0), np.float32)
    cost = np.repeat(cost, nodes, 0)
    steps = []
    for k in range(order + 1):
        own = np.zeros(1, np.int64) if k == 0 else kept[k - 1]
        lo, m = int(base[k]), len(own)
        if k:
            parent = own // a  # drops the farthest symbol
            up = np.searchsorted(kept[k - 2], parent) + base[k - 1] if k > 1 else np.zeros(m, np.int64)
            cost[lo : lo + m] = cost[up]
            step = np.repeat(np.arange(lo), a)  # what has no child, or ended at a lesser depth, stays
            step[up * a + own % a] = np.arange(lo, lo + m)
            steps.append(step.astype(np.int32))
        for j, l in enumerate(langs):
            c = _contexts(syms[l], k, a)[order:]
            pos = np.minimum(np.searchsorted(own, c), max(m - 1, 0))
            ok = own[pos] == c if m else np.zeros(len(c), bool)
            n = np.bincount(pos[ok] * a + syms[l][order:][ok], minlength=m * a).reshape(m, a).astype(float)
            total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            was = cost[lo : lo + m, :, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                cost[lo : lo + m, :, j] = np.where(total == 0, was, np.where(n > 0, -np.log2(n / (total + distinct)), was - np.log2(distinct / (total + distinct))))
    return Trees(langs, symbol, space, steps, cost.reshape(nodes * a, len(langs)), a)


def code_lengths(trees: Trees, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    n, order = len(offs) - 1, len(trees.steps)
    out = np.zeros((n, len(trees.langs)))
    if len(buf) == 0:
        return out
    size = np.diff(offs)
    at = np.arange(len(buf)) + np.repeat(order * np.arange(1, n + 1), size)  # each text is led by blanks
    sym = np.full(len(buf) + order * n, trees.space, np.int32)
    sym[at] = trees.symbol[buf]
    node = np.zeros(len(buf), np.int32)
    for j, step in enumerate(trees.steps, 1):
        node = step[node * np.int32(trees.symbols) + sym[at - j]]
    cost = trees.cost[node * np.int32(trees.symbols) + sym[at]]
    full = np.flatnonzero(size > 0)
    out[full] = np.add.reduceat(cost, offs[:-1][full], axis=0, dtype=np.float64)
    return out


def train(docs: DataFrame, *, folds: int = 4, held: int = 2, most_docs: int = 4000, most_per_lang: int = 400, max_train_chars: int = 200_000, max_total_chars: int = 64_000_000, **how) -> Trees | None:
    """Fits on a sample of rows outside the held-out fold, by hash order: at most most_per_lang a language and most_docs in all (the languages that
    sort first where there are more languages), of at most max_train_chars characters each and max_total_chars together.

    A language's rows are thinned by hash before they are ranked, so no more than some three times its part meet in one task.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(F.col("doc_id"), folds) != held).where(F.length("text").between(1, max_train_chars))
    known = known.select("doc_id", "lang", "text")
    per = cut(known.groupBy("lang").agg(F.count("*").alias("m")).orderBy("lang").limit(most_docs))
    langs = per.count()
    if langs == 0:
        return None
    each = max(1, min(most_per_lang, most_docs // langs))
    g = F.xxhash64("doc_id", F.xxhash64("text"))
    thin = F.broadcast(per.select("lang", F.least(F.lit(1.0), (2.0 * each + 60) / F.col("m")).alias("part")))  # most_docs rows at most
    drawn = known.select("doc_id", "lang", F.xxhash64("text").alias("t"), F.length("text").alias("n"), g.alias("g")).join(thin, "lang").where(F.pmod("g", F.lit(1 << 30)) < F.col("part") * (1 << 30))
    w = Window.partitionBy("lang").orderBy("g", "doc_id")
    ids = drawn.dropDuplicates(["lang", "doc_id", "t"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("doc_id", "lang", "t", "n", "k").toArrow().sort_by([("k", "ascending"), ("lang", "ascending")])
    ids = ids.slice(0, int(np.searchsorted(np.cumsum(ids["n"].to_numpy()), max_total_chars, "right")))
    if ids.num_rows == 0:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids.select(["doc_id", "lang", "t"])))  # at most most_docs rows
    got = known.withColumn("t", F.xxhash64("text")).join(chosen, ["doc_id", "lang", "t"]).dropDuplicates(["doc_id", "lang", "t"]).toArrow()
    samples: dict[str, list[str]] = {}
    order = np.lexsort((got["t"].to_numpy(), got["doc_id"].to_numpy()))
    for l, t in zip(got["lang"].take(order).to_pylist(), got["text"].take(order).to_pylist(), strict=True):
        samples.setdefault(l, []).append(t)
    return fit(samples, **how)


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score, bits (code length per byte under the prediction) for each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*(trees.langs if trees else []), "und"], object)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for rows, buf, offs in slices(ids, texts, 1 << 20):
                n = len(offs) - 1
                if trees:
                    bits = code_lengths(trees, buf, offs)
                    best = bits.argmin(1)
                    low = bits[np.arange(n), best]
                    score = 1 / np.exp2(np.clip(low[:, None] - bits, -1000, 0)).sum(1)
                    ok = letters[rows]
                    best, score = np.where(ok, best, len(names) - 1), np.where(ok, score, 0.0)
                    per = low / np.maximum(np.diff(offs), 1)
                else:
                    best, score, per = np.zeros(n, int), np.zeros(n), np.zeros(n)
                yield pa.RecordBatch.from_arrays([ids[rows], pa.array(names[best], pa.string()), pa.array(score), pa.array(per)], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every document.

    Null texts and texts without a letter are `und` with score 0, as is every text where nothing can be learned.
    Texts of any length are coded whole. Ties go to the language that sorts first. Repeated rows and rows without doc_id (held_out null)
    are judged each. An empty table gives no rows. Extra columns, whatever their names, are ignored.
    """
    return predict(docs, train(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bits")


def op9_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
