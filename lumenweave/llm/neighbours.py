"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then filed under one of its leaves, and leaves
of many rows (copies of one vector, say) are split into blocks of bounded size. A query walks the
tree best bin first: a priority queue holds nodes by inner product with their centre, and leaves
are visited until as many have been seen as calibration found necessary for the wanted recall on
sample queries, and until they hold enough rows. Each block scores its queries as one matrix
product in double precision and keeps at most k rows a query, none below the query's 3k-th best score in the
sample; these are merged by rank. A query that is left with fewer than k rows is asked again without that floor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ship, table


@dataclass
class Tree:
    centres: np.ndarray  # one row for each node; the root is node 0
    children: list[np.ndarray | None]  # None for a leaf
    leaf: np.ndarray  # leaf number, -1 inside
    visits: int = 1
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # rows filed under each leaf

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Cluster number of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return near


def grow(x: np.ndarray, *, branch: int = 12, leaf_rows: int = 200, seed: int = 1) -> Tree:
    """The tree of a sample. Nodes of at most leaf_rows rows, or whose rows are all alike, are leaves."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, at = [x.mean(0)], [None], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = _kmeans(x[rows], max(2, min(branch, -(-len(rows) // leaf_rows))), rng) if len(rows) > leaf_rows else np.zeros(len(rows), np.int64)
        kinds = np.unique(near)
        if len(kinds) < 2:
            leaf[node] = at
            at += 1
            continue
        own = []
        for j in kinds:
            own.append(len(centres))
            part = rows[near == j]
            centres.append(x[part].mean(0))
            children.append(None)
            leaf.append(-1)
            todo.append((own[-1], part))
        children[node] = np.array(own)
    return Tree(np.array(centres), children, np.array(leaf))


def file_under(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: the nearest child at each step down."""
    out = np.empty(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        own = tree.children[node]
        if own is None:
            out[rows] = tree.leaf[node]
            continue
        c = tree.centres[own]
        near = ((c * c).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)
        for j, child in enumerate(own):
            part = rows[near == j]
            if len(part):
                todo.append((child, part))
    return out


def best_bins(tree: Tree, q: np.ndarray, visits: int, rows: int) -> list[int]:
    """Leaves in the order visited: at least `visits`, and on until they hold `rows` rows or none are left."""
    heap, out, held = [(0.0, 0)], [], 0
    while heap and (len(out) < visits or held < rows):
        _, node = heapq.heappop(heap)
        own = tree.children[node]
        if own is None:
            leaf = int(tree.leaf[node])
            out.append(leaf)
            held += int(tree.sizes[leaf]) if len(tree.sizes) else 1
        else:
            for s, child in zip((tree.centres[own] @ q).tolist(), own.tolist(), strict=True):
                heapq.heappush(heap, (-s, child))
    return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, n_queries: int = 300, seed: int = 2) -> int:
    """The least number of leaf visits that gives the recall on queries from the sample itself."""
    at = np.random.default_rng(seed).choice(len(x), min(n_queries, len(x)), replace=False)
    of = file_under(tree, x)
    need = np.zeros(tree.leaves + 1)
    total = 0
    for lo in range(0, len(at), 50):
        s = x[at[lo : lo + 50]] @ x.T
        s[np.arange(len(s)), at[lo : lo + 50]] = -np.inf
        m = min(k, len(x) - 1)
        for row, i in zip(s, at[lo : lo + 50], strict=True):
            order = np.empty(tree.leaves, np.int64)
            order[best_bins(tree, x[i], tree.leaves, 0)] = np.arange(1, tree.leaves + 1)
            np.add.at(need, order[of[np.argpartition(-row, m - 1)[:m]]] if m else np.empty(0, np.int64), 1)
            total += m
    return int(np.searchsorted(np.cumsum(need), recall * total)) if total else tree.leaves


def floor_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> np.ndarray:
    """Score of each query's k-th best row in a sample, less a little: rows below it are in no answer. -inf where the sample has fewer."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] < k:
        return np.full(len(q), -np.inf)
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return least - 1e-9 * (1 + np.abs(least))


def top(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of each query's k best rows but its own, of those at its floor or above; ties go to the smaller id."""
    rough = q @ x.T
    rough[q_rows[:, None] == rows[None, :]] = -np.inf
    at = min(k, rough.shape[1]) - 1
    least = np.maximum(-np.partition(-rough, at, axis=1)[:, at], np.where(np.isfinite(floor), floor, -1e300))
    who, what, score = [], [], []
    for j in range(len(q)):
        # the product may round alike rows apart; what is near the limit is scored again, row by row
        near = np.flatnonzero((rough[j] >= least[j] - 1e-9 * (1 + abs(least[j]))) & np.isfinite(rough[j]))
        s = (x[near] * q[j]).sum(1)
        o = np.lexsort((ids[near], -s))[:k]
        who.append(np.full(len(o), j))
        what.append(ids[near][o])
        score.append(s[o])
    return np.concatenate(who), np.concatenate(what), np.concatenate(score)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part: not null, not empty, all components finite, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.where(fine & F.exists("embedding", lambda c: c != 0))


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, recall: float = 0.97, sample: int = 20_000, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows, by largest inner product, of each row whose vec_id divides by `every`.

    Vectors of different lengths have no inner product: each length is searched for itself. In each, the tree is fitted on at most `sample` vectors by
    hash order, and every row is indexed. Rows that repeat a vec_id are candidates each and ask each; only the asking row itself is left out of
    its answer. Null, zero and empty vectors and those with null or non-finite components take no part, nor do rows without vec_id. Columns besides vec_id and
    embedding, whatever their names, are not read. No usable row: no result.
    """
    v = usable(vectors)
    dims = [r["d"] for r in v.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]  # lengths, not vectors
    out = None
    for d in dims:
        got = _search(v.where(F.size("embedding") == d) if len(dims) > 1 else v, k, every, recall, sample, block_rows)
        out = got if out is None else out.union(got)
    return vectors.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _search(v: DataFrame, k: int, every: int, recall: float, sample: int, block_rows: int) -> DataFrame:
    """`search` over usable vectors of one length."""
    spark = v.sparkSession
    ship(spark)
    taken = v.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample).toArrow()
    x, x_ids = _matrix(taken["embedding"]), taken["vec_id"].to_numpy()
    tree = grow(x)
    tree.visits = calibrate(tree, x, k, recall)
    model = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(file_under(model.value, _matrix(b.column(1))).astype(np.int32))], names=["vec_id", "embedding", "leaf"])

    kind = v.schema["embedding"].dataType.simpleString()
    filed = cut(v.mapInArrow(file, f"vec_id long, embedding {kind}, leaf int").withColumn("row", F.monotonically_increasing_id()))  # holds from here on, as it is written
    sizes = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # at most one row for each leaf of the sample's tree
        sizes[r["leaf"]] = r["count"]
    tree.sizes = sizes
    model = spark.sparkContext.broadcast(tree)
    drawn = spark.sparkContext.broadcast((x.astype(np.float32) if kind == "array<float>" else x, x_ids))  # at most `sample` rows
    blocks = -(-sizes // block_rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        many = np.maximum(1, -(-t.sizes // block_rows))
        for b in batches:
            q, q_ids = _matrix(b.column(1)), b.column(0).to_numpy()
            xs = drawn.value[0].astype(np.float64)
            floor = np.concatenate([floor_of(xs, drawn.value[1], q[a : a + 64], q_ids[a : a + 64], 3 * k) for a in range(0, len(q), 64)]) if len(q) else q_ids
            at, leaf, block = [], [], []
            for j in range(b.num_rows):
                for l in best_bins(t, q[j], t.visits, k + 1):
                    if t.sizes[l]:
                        n = int(many[l])
                        at += [j] * n
                        leaf += [l] * n
                        block += range(n)
                if len(at) > 20_000 or j == b.num_rows - 1:
                    i = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(2).take(i), b.column(0).take(i), b.column(1).take(i), pa.array(floor[at]), pa.array(leaf, pa.int32()), pa.array(block, pa.int32())], names=["query_row", "query_id", "q", "floor", "leaf", "block"])
                    at, leaf, block = [], [], []

    n_blocks = F.lit(1)
    for l in np.flatnonzero(blocks > 1):
        n_blocks = F.when(F.col("leaf") == int(l), int(blocks[l])).otherwise(n_blocks) if (blocks > 1).sum() < 50 else n_blocks
    if (blocks > 1).sum() >= 50:
        n_blocks = F.element_at(F.array(*[F.lit(int(max(1, b))) for b in blocks]), F.col("leaf") + 1)
    filed = filed.withColumn("block", F.pmod(F.xxhash64("row"), n_blocks.cast("long")).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(sizes.sum() // 50_000))
    queries = filed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "row").repartition(parts, "row")
    asked = queries.mapInArrow(ask, f"query_row long, query_id long, q {kind}, floor double, leaf int, block int")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, rows, x = left["vec_id"].to_numpy(), left["row"].to_numpy(), _matrix(left["embedding"])
        q_rows, q_ids, q, floor = right["query_row"].to_numpy(), right["query_id"].to_numpy(), _matrix(right["q"]), right["floor"].to_numpy()
        got = [top(x, ids, rows, q[a : a + 256], q_rows[a : a + 256], k, floor[a : a + 256]) for a in range(0, len(q), 256)]
        who = np.concatenate([g[0] + a for g, a in zip(got, range(0, len(q), 256), strict=True)])
        return pa.table({"query_row": q_rows[who], "query_id": q_ids[who], "vec_id": np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])})

    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")

    def answer(asked: DataFrame) -> DataFrame:
        met = filed.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInArrow(meet, "query_row long, query_id long, vec_id long, score double")
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")

    found = cut(answer(asked))
    # queries of which the visited leaves hold fewer than k rows above the floor are asked again without one
    short = cut(queries.join(found.where(F.col("rank") == k).select(F.col("query_row").alias("row")), "row", "left_anti").select("vec_id", "embedding", "row"))
    if short.isEmpty():
        return found.drop("query_row")
    again = answer(short.repartition(parts, "row").mapInArrow(ask, asked.schema).withColumn("floor", F.lit(float("-inf"))))
    return found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").select(*found.columns).union(again).drop("query_row")


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
