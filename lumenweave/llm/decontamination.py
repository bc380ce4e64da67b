"""Benchmark decontamination with a distributed positional inverted index.

`build_index` cuts the corpus into segments of whole documents and stores, for each segment, the
sorted fingerprints of its terms and each term's sorted positions (delta coded), with the table of
documents; a segment is one row of Parquet of bounded size, built and read on its own, so no term,
however common, is ever gathered across segments. `search` takes the test items' windows; in each
segment it starts from the positions of a window's rarest term and intersects them with the other
terms' lists, shifted by their offsets in the window, rarest next. What is left are exact phrase
matches. `proximity` finds, by the same lists, where a window's words stand together in any order or with others
between them. Items are searched in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import without
from .common import cut, ship, table, trim
from .kernels import ALNUM, slices, words

INDEX = "doc_ids binary, known binary, names binary, first binary, terms binary, counts binary, deltas binary, segment long"
CLOSE = "segment long, place int, doc_id long, item_id string, begins array<int>, ends array<int>"
FOUND = "segment long, place int, doc_id long, name1 long, name2 long, n_words long, n_hit long, items array<string>, begins array<int>, ends array<int>"


def _segment(ids: np.ndarray, known: np.ndarray, names: np.ndarray, n: np.ndarray, h: np.ndarray) -> list[bytes]:
    """One row of the index: documents, their first positions, terms, and delta-coded positions by term."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    d = np.diff(order, prepend=0)
    d[at] = order[at]
    counts = np.diff(np.append(at, len(s)))
    return [x.tobytes() for x in (ids, known, names, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), s[at], counts.astype(np.int32), d.astype(np.int32))]


def build_index(docs: DataFrame, *, segment_bytes: int = 4 << 20) -> DataFrame:
    """The stored index of doc_id, text. A longer document has a segment of its own. Null texts have no words.

    A document is named by its segment's number and its place there, whatever its doc_id; two fingerprints of its text go along.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = made = 0
        part = TaskContext.get().partitionId()

        def out():
            nonlocal made
            made += 1
            ids, known, names, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
            number = pa.array([(part << 32) + made], pa.int64())
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in _segment(ids, known, names, n, h)], number], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            ids = batch.column(0)
            for rows, buf, offs in slices(ids, batch.column(1)):
                doc, _, _, h = words(buf, offs, ALNUM)
                got = ids[rows]
                if held and size + len(buf) > segment_bytes:
                    yield out()
                    held, size = [], 0
                held.append((got.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), got.is_valid().to_numpy(zero_copy_only=False), np.column_stack([c[rows].to_numpy() for c in batch.columns[2:]]), np.bincount(doc, minlength=len(offs) - 1), h))
                size += len(buf)
        if held:
            yield out()
        held = []
        trim()

    return cut(docs.select("doc_id", "text", *[c.alias(f"name{k}") for k, c in enumerate(_names(F.col("text")), 1)]).mapInArrow(run, INDEX))


def _names(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


class Segment:
    """The lists of one segment in memory."""

    def __init__(self, row: dict):
        self.ids, self.known, self.first = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["first"], np.int64)
        self.names = np.frombuffer(row["names"], np.int64).reshape(-1, 2)
        self.terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        d = np.frombuffer(row["deltas"], np.int32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(counts)])
        total = np.cumsum(d)
        base = total[self.at[:-1]] - d[self.at[:-1]] if len(counts) else np.empty(0, np.int64)
        self.pos = total - np.repeat(base, counts)
        self.n = len(d)
        self.both = np.repeat(np.arange(len(counts)), counts) * max(1, self.n) + self.pos

    def term(self, h: np.ndarray) -> np.ndarray:
        """Number of each term here, -1 where it does not occur."""
        if len(self.terms) == 0:
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[k] == h, k, -1)

    def has(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        want = term * self.n + pos
        k = np.minimum(np.searchsorted(self.both, want), len(self.both) - 1)
        return (self.both[k] == want) & (pos >= 0) & (pos < self.n)

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, position) for each position of each term."""
        n = self.at[term + 1] - self.at[term]
        who = np.repeat(np.arange(len(term)), n)
        return who, self.pos[np.repeat(self.at[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def doc(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, pos, "right") - 1


def phrases(seg: Segment, terms: np.ndarray, windows: np.ndarray, lens: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(window, first position) of each exact match. windows: numbers into `terms`, a row for each window, padded by -1."""
    here = seg.term(terms)
    if seg.n == 0 or len(windows) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tid = np.where(windows >= 0, here[windows], -2)
    alive = np.flatnonzero(~(tid == -1).any(1))
    if len(alive) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tid, length = tid[alive], lens[alive]
    df = np.where(tid >= 0, seg.at[np.maximum(tid, 0) + 1] - seg.at[np.maximum(tid, 0)], 1 << 60)
    order = np.argsort(df, axis=1, kind="stable")  # rarest first
    load = np.cumsum(np.take_along_axis(df, order[:, :1], 1)[:, 0])
    got_w, got_p = [], []
    lo = 0
    while lo < len(alive):  # blocks of windows, so that candidates stay bounded
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + most, "right")))
        t, o, ln = tid[lo:hi], order[lo:hi], length[lo:hi]
        r = np.arange(len(t))
        w, p = seg.expand(t[r, o[:, 0]])
        p = p - o[w, 0]
        ok = (p >= 0) & (p + ln[w] <= seg.n)
        w, p = w[ok], p[ok]
        for k in range(1, windows.shape[1]):
            j = o[w, k]
            want = t[w, j]
            pad = want < 0
            ok = pad | seg.has(np.maximum(want, 0), p + j)
            w, p = w[ok], p[ok]
            if len(w) == 0:
                break
        ok = seg.doc(p) == seg.doc(p + ln[w] - 1) if len(w) else np.empty(0, bool)
        got_w.append(alive[lo:hi][w[ok]])
        got_p.append(p[ok])
        lo = hi
    return np.concatenate(got_w), np.concatenate(got_p)


def near(seg: Segment, query: np.ndarray, within: int) -> np.ndarray:
    """Positions of the query's rarest term around which every other term of it lies at most `within` words away, in the same document."""
    tid = seg.term(np.unique(query))
    if len(tid) == 0 or (tid < 0).any():
        return np.empty(0, np.int64)
    tid = tid[np.argsort(seg.at[tid + 1] - seg.at[tid], kind="stable")]
    p = seg.pos[seg.at[tid[0]] : seg.at[tid[0] + 1]]
    for t in tid[1:]:
        own, d = seg.pos[seg.at[t] : seg.at[t + 1]], seg.doc(p)
        k = np.searchsorted(own, np.maximum(p - within, seg.first[d]))
        p = p[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] <= np.minimum(p + within, seg.first[d + 1] - 1))]
    return p


def spans(seg: Segment, query: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the ranges of at most `within` words of a document that have every word of the query and have no such range inside."""
    tid = seg.term(np.unique(query))
    anchor = near(seg, query, within - 1)
    if len(anchor) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = [seg.pos[seg.at[t] : seg.at[t + 1]] for t in tid]
    e = np.sort(np.concatenate(own))
    k = np.searchsorted(anchor, e, "right") - 1
    e = e[(k >= 0) & (e - anchor[np.maximum(k, 0)] < within)]  # a range that ends here has an anchor
    b = e.copy()
    for p in own:
        k = np.searchsorted(p, e, "right") - 1
        b = np.where(k >= 0, np.minimum(b, p[np.maximum(k, 0)]), -1)
    ok = (b >= 0) & (e - b < within)
    b, e = b[ok], e[ok]
    ok = seg.doc(b) == seg.doc(e)
    b, at = np.unique(b[ok], return_index=True)
    return b, e[ok][at] + 1


def _windows(items: pa.Table, size: int) -> dict:
    """Distinct windows of the items' words, and which items have them."""
    fps, owner, lens = [], [], []
    for rows, buf, offs in slices(items["item_id"], items["text"]):
        doc, _, _, h = words(buf, offs, ALNUM)
        n = np.bincount(doc, minlength=len(offs) - 1)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = np.flatnonzero(doc[: len(h) - size + 1] == doc[size - 1 :]) if len(h) >= size else np.empty(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < size))
        at = np.append(full, first[few])[:, None] + np.arange(size)
        own = np.append(np.full(len(full), size), n[few])
        fps.append(np.where(np.arange(size) < own[:, None], h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(0)))
        owner.append(rows.start + np.append(doc[full], few))
        lens.append(own)
    if not sum(map(len, lens)):
        return {"terms": np.empty(0, np.uint64), "windows": np.empty((0, size), np.int64), "lens": np.empty(0, np.int64), "of": np.empty((0, 2), np.int64), "items": []}
    rows = np.column_stack([np.concatenate(fps), np.concatenate(lens).astype(np.uint64)])
    rows, inv = np.unique(rows, axis=0, return_inverse=True)
    lens = rows[:, -1].astype(np.int64)
    used = np.arange(size) < lens[:, None]
    terms = np.unique(rows[:, :-1][used])
    return {"terms": terms, "windows": np.where(used, np.searchsorted(terms, rows[:, :-1]), -1), "lens": lens, "of": np.unique(np.column_stack([inv.reshape(-1), np.concatenate(owner)]), axis=0), "items": pc.cast(items["item_id"], pa.string()).to_pylist()}


def search(index: DataFrame, items: DataFrame, *, size: int = 8, block_words: int = 500_000) -> DataFrame:
    """For each indexed document: doc_id, name1 and name2 (fingerprints of its text), n_words, n_hit (words inside a match), items matched, and matched word ranges.

    Items (item_id, text) of fewer than `size` words, but not none, count as one window. Items without id or words take no part.
    Items are taken in blocks by hash of about block_words words, the bound of what is broadcast.
    """
    spark = index.sparkSession
    ship(spark)
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * block_words)))
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(_windows(own.toArrow().combine_chunks(), size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            of = q["of"]
            first_of = np.searchsorted(of[:, 0], np.arange(len(q["lens"]) + 1))
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(row)
                    w, p = phrases(seg, q["terms"], q["windows"], q["lens"])
                    n = len(seg.ids)
                    edge = np.zeros(seg.n + 1, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + q["lens"][w], -1)
                    hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                    hits = np.concatenate([[0], np.cumsum(hit[1:-1])])
                    # a match ends where its document does: ranges are cut at documents' first positions
                    step = np.diff(hit.astype(np.int8))
                    a, z = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                    d0, d1 = seg.doc(a), seg.doc(z - 1)
                    begins, ends = [[] for _ in range(n)], [[] for _ in range(n)]
                    for x, y, i, j in zip(a, z, d0, d1, strict=True):
                        for d in range(i, j + 1):
                            lo, hi = max(x, seg.first[d]), min(y, seg.first[d + 1])
                            if lo < hi:
                                begins[d].append(int(lo - seg.first[d]))
                                ends[d].append(int(hi - seg.first[d]))
                    pair = np.unique(np.column_stack([seg.doc(p), w]), axis=0) if len(p) else np.empty((0, 2), np.int64)
                    found: list[set] = [set() for _ in range(n)]
                    for d, k in pair:
                        found[d].update(of[first_of[k] : first_of[k + 1], 1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, row["segment"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(seg.ids, mask=~seg.known), pa.array(seg.names[:, 0]), pa.array(seg.names[:, 1]), pa.array(np.diff(seg.first)), pa.array(hits[seg.first[1:]] - hits[seg.first[:-1]]),
                        pa.array([sorted({q["items"][i] for i in x}) for x in found], pa.list_(pa.string())), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
                    ], names=[x.split()[0] for x in FOUND.split(", ")])
                    del seg, hit, hits, edge, step
            trim()

        got = index.mapInArrow(run, FOUND)
        out = got if out is None else out.union(got)
    if blocks > 1:
        ranges = F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))).alias("r")
        covered = F.expr("size(array_distinct(flatten(transform(r, x -> sequence(x.begins, x.ends - 1)))))")
        out = (out.groupBy("segment", "place", "doc_id", "name1", "name2", "n_words").agg(ranges, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
               .select("doc_id", "name1", "name2", "n_words", F.when(F.size("r") > 0, covered).otherwise(0).cast("long").alias("n_hit"), "items", F.col("r.begins").alias("begins"), F.col("r.ends").alias("ends")))
    return out.drop("segment", "place")


def proximity(index: DataFrame, items: DataFrame, *, size: int = 5, within: int = 10, block_words: int = 500_000) -> DataFrame:
    """segment, place (the document's row in the index), doc_id, item_id, begins, ends: word ranges in which an item's window is found close together.

    A range has every distinct word of one of the item's windows of `size` words, in any order, within `within` words of one document,
    and no smaller such range inside; an item's ranges in a document are distinct and sorted, and may overlap. Only documents with a
    range have rows. A window with a word taken out is not found, a shorter window beside that word is. Items are taken as by `search`.
    """
    spark = index.sparkSession
    ship(spark)
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * block_words)))
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(_windows(own.toArrow().combine_chunks(), size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            of = q["of"]
            first_of = np.searchsorted(of[:, 0], np.arange(len(q["lens"]) + 1))
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(row)
                    here = np.append(seg.term(q["terms"]), 0)  # the last stands for padding
                    found: dict[tuple, set] = {}
                    for w in np.flatnonzero((here[q["windows"]] >= 0).all(1)):
                        first, end = spans(seg, q["terms"][q["windows"][w][: q["lens"][w]]], within)
                        for d, x, y in zip(seg.doc(first).tolist(), first.tolist(), end.tolist(), strict=True):
                            for i in of[first_of[w] : first_of[w + 1], 1].tolist():
                                found.setdefault((d, q["items"][i]), set()).add((x - int(seg.first[d]), y - int(seg.first[d])))
                    rows = [(row["segment"], d, int(seg.ids[d]) if seg.known[d] else None, i, sorted(r)) for (d, i), r in sorted(found.items())]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
                    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)] + [pa.array([[x[k] for x in r[4]] for r in rows], pa.list_(pa.int32())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in CLOSE.split(", ")])

        got = index.mapInArrow(run, CLOSE)
        out = got if out is None else out.union(got)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = 8, least_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, begins, ends (word ranges of matches).

    Null and empty texts have no words and are clean. Repeated rows and rows without doc_id are judged each, by their place in the index, however
    many blocks the items take. A text longer than a segment is a segment of its own, searched whole. Extra columns are ignored, whatever
    their names. Without documents there are no rows, without items all are clean.
    """
    got = search(build_index(docs), items, size=size)
    n = F.size("items").cast("long")
    return got.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"), "items", "begins", "ends")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, size: int = 8) -> DataFrame:
    """The rows of docs, all columns, in whose text no window of any item occurs. A text decides for every row that has it, with or without doc_id."""
    found = search(build_index(docs), items, size=size).where("n_hit > 0").select(F.col("name1").alias("__name1"), F.col("name2").alias("__name2"))
    named = docs.withColumns({f"__name{k}": c for k, c in enumerate(_names(F.col("text")), 1)})
    return without(named, found, ["__name1", "__name2"]).select(*docs.columns)


def brute_force(docs: list[tuple], items: list[tuple], size: int = 8) -> dict:
    """What op4 returns for small lists, straight from the definition."""
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut_ = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    out = {}
    for doc_id, text in docs:
        w = cut_(text)
        hit, got = set(), set()
        for item_id, t in items:
            v = cut_(t)
            m = min(size, len(v))
            for s in range(len(v) - m + 1) if m else ():
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == v[s : s + m]:
                        hit.update(range(k, k + m))
                        got.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got) >= 2)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: op4 from its definition: windows are joined with the documents' word sequences of each window length. A space is in no word.
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item, n, list_aggregate(w[k + 1 : k + n], 'string_agg', ' ') AS s FROM (SELECT *, least(8, len(w)) AS n FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(len(w) - n + 1)) AS k)),
g AS (SELECT r, k, n, list_aggregate(w[k + 1 : k + n], 'string_agg', ' ') AS s FROM d, (SELECT DISTINCT n FROM q), LATERAL (SELECT unnest(range(greatest(0, len(w) - n + 1))) AS k)),
m AS (SELECT r, k, n, item FROM g JOIN q USING (n, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""
