"""Set-similarity join of documents on word shingles, by rare-first prefix filtering.

Every document is its set of distinct shingle fingerprints; equal sets are one node of the link graph. A total
order, rare shingles first, is fixed by counts over the whole corpus: shingles that many documents have are
counted exactly where they recur within a task's share of documents, and those with the largest sums (a bounded
list) come last, by count; all others come before them by fingerprint. Two sets with similarity t share
one of the first n - ceil(t n) + 1 shingles of each; these prefixes are joined, under the length
filter and the positional filter, and each surviving pair is verified once, after filters on the whole sets: bit
sketches kept for every node, and the suffix filter on counts by range.

The join is dealt by ranges of fingerprints, packed as binary blocks. Shingles of the frequent list
and buckets over `most_pairs` documents are not paired off: their members are first tied to one
pivot for each band of set sizes (the member with the fewest rarer shingles, so the nearest to what the bucket has in
common), connected components are formed, and only then are pairs across components tried, within neighbouring bands. Of
these, a member is not tried against those that are verified close to a pivot when its sketch shows it to be too far from that
pivot (Jaccard distance obeys the triangle inequality). So a group of copies costs links in proportion to its size, and no
link between components is lost. What can still grow with the square of
a bucket are documents that share a frequent rare-first shingle, have sets of like size, and are similar neither to
each other nor to their pivot: variants of a text that is not itself there, which differ from it in other places each.

Pairs are verified in blocks of bounded size, to which each set is sent once for a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom, without
from .common import components, cut, heavy_join, ship, table, trim
from .kernels import SPACED, mix, runs, slices, words

_U = np.uint64
NAME = ["n", "f1", "f2"]  # a set's size and two fingerprints name it


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) for each text."""
    for rows, buf, offs in slices([], texts, 1 << 20):
        n = len(offs) - 1
        doc, _, _, h = words(buf, offs, SPACED)
        who, _, fp = runs(doc, h, size, n)
        at = np.searchsorted(who, np.arange(n + 1))
        for d in range(n):
            s = np.sort(fp[at[d] : at[d + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield rows.start + d, s


def _name(s: np.ndarray) -> tuple[int, int]:
    """Two fingerprints of a set."""
    if len(s) == 0:
        return 0, 0
    return int(s.sum(dtype=_U).view(np.int64)), int(mix(s + _U(0x51ED2701)).sum(dtype=_U).view(np.int64))


def _sketch(s: np.ndarray) -> list[int]:
    """Parity of the set's shingles by their low bits, at a bit or two for each shingle. Two sets differ in at least as many
    shingles as their sketches in bits; a sketch's halves combine, bit by bit, to the sketch of half the size."""
    size = max(512, 1 << int(len(s)).bit_length())
    odd = (np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _describe(size: int, flush: int = 1 << 21, least: int = 4):
    """Pass 1: a row (0, doc_id, t, n, f1, f2, bits) for each document, t being a fingerprint of its text, bits null where the task has seen the set
    before; a row (1, null, null, count, shingle) for each shingle that recurs here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "t", "n", "f1", "f2", "bits"]
        held: list[np.ndarray] = []
        total, seen = 0, set()

        def often():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            k, c = k[c >= least], c[c >= least]
            z = pa.nulls(len(k), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), z, z, pa.array(c.astype(np.int64)), pa.array(_signed(k)), z, pa.nulls(len(k), pa.list_(pa.int64()))], names=names)

        for batch in batches:
            ns, f1, f2, bits = [], [], [], []
            for _, s in _sets(batch.column(2), size):
                a, b = _name(s)
                ns.append(len(s))
                f1.append(a)
                f2.append(b)
                if len(s) and (len(s), a) not in seen:
                    seen.add((len(s), a))
                    held.append(s)
                    total += len(s)
                    bits.append(_sketch(s))
                else:
                    bits.append(None)
                if total >= flush:
                    yield often()
                    held, total, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int32)), batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=names)
        if held:
            yield often()
        held, seen = [], set()
        trim()

    return run, "kind int, doc_id long, t long, n long, f1 long, f2 long, bits array<long>"


PACKED = "rng int, ns binary, names binary, counts binary, shingles binary, places binary"


def _prefixes(size: int, num: int, den: int, parts: int, hot: np.ndarray, hot_count: np.ndarray, flush: int = 1 << 20):
    """Pass 2: the prefix entries of each distinct set of a task, packed by range of fingerprints; those of frequent shingles in the negative ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, int, int]] = []
        kept: list[np.ndarray] = []
        lens: list[int] = []
        flags: list[np.ndarray] = []
        total, seen = 0, set()

        def out():
            h, n = np.concatenate(kept), np.array(lens)
            is_hot = np.concatenate(flags)
            who = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            d = np.array(own, np.int64).reshape(-1, 3)
            # a frequent shingle's entries are dealt by set, so that none meet in one task
            rng = (h >> _U(40)).astype(np.int64) % parts
            rng = np.where(is_hot, -1 - (mix(d[who, 1].view(_U)) >> _U(40)).astype(np.int64) % parts, rng)
            order = np.argsort(rng, kind="stable")
            r = rng[order]
            cols: list[list] = [[] for _ in range(6)]
            for a, z in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])), strict=True):
                o = order[a:z]
                w, c = np.unique(who[o], return_counts=True)
                for col, v in zip(cols, (int(r[a]), d[w, 0].astype(np.int32).tobytes(), d[w, 1:].tobytes(), c.astype(np.int32).tobytes(), h[o].tobytes(), place[o].astype(np.int32).tobytes()), strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for _, s in _sets(batch.column(0), size):
                if len(s) == 0:
                    continue
                name = (len(s), *_name(s))
                if name in seen:
                    continue
                seen.add(name)
                n = len(s)
                take = n - (num * n + den - 1) // den + 1
                if len(hot):
                    pos = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    c = np.where(hot[pos] == s, hot_count[pos], 0)
                    o = np.argsort(c, kind="stable")[:take]  # by count, then by fingerprint
                    s, c = s[o], c[o]
                else:
                    s, c = s[:take], np.zeros(take)
                own.append(name)
                kept.append(s)
                lens.append(len(s))
                flags.append(c > 0)
                total += len(s)
                if total >= flush:
                    yield out()
                    own, kept, lens, flags, total = [], [], [], [], 0
        if kept:
            yield out()
        own, kept, lens, flags, seen = [], [], [], [], set()
        trim()

    return run


FOUND = "kind int, h long, n int, f1 long, f2 long, place int, nb int, f1b long, f2b long"


def _within(na, nb, num: int, den: int):
    """Length filter."""
    return den * np.minimum(na, nb) >= num * np.maximum(na, nb)


def _positional(na, nb, pa_, pb, num: int, den: int):
    """Whether a first common shingle at these places still allows an overlap of num / (num + den) * (na + nb)."""
    return (num + den) * (1 + np.minimum(na - pa_ - 1, nb - pb - 1)) >= num * (na + nb)


def _pair(num: int, den: int, most_pairs: int):
    """Joins one range: pairs of sets' names (0, _, a, _, b) of small buckets, members (1, shingle, a, place) of large ones and of frequent shingles."""

    def run(key: tuple, table_: pa.Table) -> pa.Table:
        t = table_.combine_chunks()
        cat = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()])
        named = np.column_stack([cat("ns", np.int32).astype(np.int64), cat("names", np.int64).reshape(-1, 2)])
        counts, h, place = cat("counts", np.int32), cat("shingles", _U), cat("places", np.int32).astype(np.int64)
        # copies of a set that come from different tasks are one
        named, back = np.unique(named, axis=0, return_inverse=True)
        who = np.repeat(back.reshape(-1), counts)
        order = np.lexsort((who, h))
        h, place, who = h[order], place[order], who[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
        h, place, who, ns = h[~again], place[~again], who[~again], named[:, 0]
        pairs = np.empty((0, 2), np.int64)
        member = np.arange(len(h))
        if key[0].as_py() >= 0:
            edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            n_in = np.diff(edge)
            of = np.repeat(n_in, n_in)
            member = np.flatnonzero(of > most_pairs)
            small = np.flatnonzero((of > 1) & (of <= most_pairs))
            h_s, p_s, w_s = h[small], place[small], who[small]
            got = []
            for d in range(1, min(most_pairs, int(n_in.max(initial=0)))):
                if d >= len(small):
                    break
                i = np.flatnonzero(h_s[d:] == h_s[:-d])
                if len(i) == 0:
                    break
                x, y = w_s[i], w_s[i + d]
                na, nb = ns[x], ns[y]
                ok = _within(na, nb, num, den) & _positional(na, nb, p_s[i], p_s[i + d], num, den)
                got.append(np.column_stack([x[ok], y[ok]]))
            pairs = np.unique(np.concatenate(got), axis=0) if got else pairs
        m, k = len(member), len(pairs)
        a = named[np.concatenate([pairs[:, 0], who[member]])]
        none = pa.nulls(m, pa.int64())
        b = named[pairs[:, 1]]
        joined = lambda x, y, kind: pa.concat_arrays([pa.array(x, kind), y.cast(kind) if isinstance(y, pa.Array) else pa.array(y, kind)])
        return pa.table({
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [k, m])),
            "h": joined(np.zeros(k, np.int64), _signed(h[member]), pa.int64()),
            "n": pa.array(a[:, 0].astype(np.int32)), "f1": pa.array(a[:, 1]), "f2": pa.array(a[:, 2]),
            "place": joined(np.zeros(k, np.int32), place[member].astype(np.int32), pa.int32()),
            "nb": joined(b[:, 0].astype(np.int32), none, pa.int32()), "f1b": joined(b[:, 1], none, pa.int64()), "f2b": joined(b[:, 2], none, pa.int64()),
        })

    return run


def _verify(num: int, den: int):
    """Of a block's pairs (block, a, b) and sets (block, node, s): the pairs similar enough, by the suffix filter on counts by range of fingerprints, then the exact overlap."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        have = {k: np.frombuffer(v, _U) for k, v in zip(sets["node"].to_pylist(), sets["s"].to_pylist(), strict=True)}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        ok = np.zeros(len(a), bool)
        cuts = (np.arange(1, 16, dtype=_U) << _U(60)).astype(_U)
        counts = {k: np.diff(np.searchsorted(v, cuts), prepend=0, append=len(v)) for k, v in have.items()}
        for r in range(len(a)):
            x, y = have[a[r]], have[b[r]]
            need = -(-num * (len(x) + len(y)) // (num + den))
            # sets differ in at least the sum over ranges of the difference of counts
            if np.abs(counts[a[r]] - counts[b[r]]).sum() > len(x) + len(y) - 2 * need:
                continue
            if len(x) > len(y):
                x, y = y, x
            k = np.minimum(np.searchsorted(y, x), len(y) - 1)
            ok[r] = int((y[k] == x).sum()) >= need
        return pairs.select(["a", "b"]).filter(pa.array(ok))

    return run


def _shingle_sets(size: int):
    """The distinct sets of a task, with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = set(), (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NAME, "s"])
        for batch in batches:
            rows = []
            for _, s in _sets(batch.column(0), size):
                name = (len(s), *_name(s))
                if len(s) and name not in seen:
                    seen.add(name)
                    rows.append((*name, s.tobytes()))
                if len(rows) == 256:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return run


def _apart(x: Column, y: Column) -> Column:
    """In how many shingles two sets differ at least, by their sketches, where one is at most twice as long as the other; else 0."""
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    xor = lambda p, q: F.zip_with(p, q, lambda u, v: u.bitwiseXOR(v))
    both = F.when(F.size(x) == F.size(y), xor(x, y)).when(F.size(x) == 2 * F.size(y), xor(half(x), y)).when(F.size(y) == 2 * F.size(x), xor(x, half(y))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(both, F.lit(0), lambda s, v: s + F.bit_count(v))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, num: int, den: int, block: int = 1 << 20) -> DataFrame:
    """Verified pairs (a, b) of nodes: sketches first rule out most, then the sets of the rest are made from the whole texts, each set
    is sent once to each block of pairs that needs it, and a block's pairs have sets of some `block` shingles together (or one pair's)."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}")), side)
    need = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    pairs = cut(pairs.where(_apart(F.col("bitsa"), F.col("bitsb")) <= F.col("na") + F.col("nb") - 2 * need).select("a", "b", "na", "nb"))
    per = cut(pairs.groupBy("a").agg(F.sum("nb").alias("w"), F.max("na").alias("n"), F.count("*").alias("m")))
    weight = per.agg(F.sum(F.col("w") + F.col("n"))).first()[0] or 0
    if not weight:
        return pairs.select("a", "b")
    blocks = int(weight // block) + 1
    chunk = F.pmod(F.xxhash64("b"), F.floor(F.col("w") / block) + 1)
    pairs = heavy_join(pairs, per.drop("n"), ["a"], "m").select(F.pmod(F.xxhash64("a", chunk), F.lit(blocks)).alias("block"), "a", "b")
    pairs = cut(pairs)
    wanted = cut(pairs.select("block", F.col("a").alias("node")).union(pairs.select("block", F.col("b").alias("node"))).distinct())
    ids = cut(wanted.select("node").distinct().join(nodes.select("node", "t", *NAME), "node"))
    # texts that are in no pair are left out by a filter of bounded size, in the scan
    among = bloom(ids.select(F.col("t").alias("key")), ids.count(), 77, 12, 4)
    texts = docs.where("text is not null").select("text").where(among.says(F.xxhash64("text")))
    sets = texts.mapInArrow(_shingle_sets(size), "n long, f1 long, f2 long, s binary").join(ids.select("node", *NAME), NAME).select("node", "s").dropDuplicates(["node"])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    sets = wanted.join(cut(sets), "node").repartition(parts, "block")
    return cut(pairs.repartition(parts, "block").groupBy("block").cogroup(sets.groupBy("block")).applyInArrow(_verify(num, den), "a long, b long"))


def _rest(member: DataFrame, nodes: DataFrame, links: DataFrame, comp: DataFrame, hubs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs across components in the large buckets: each member against those outside the bucket's largest component, in its band of
    sizes and the two next to it, under the length and positional filters, less what a pivot rules out."""
    where = cut(member.join(comp.select(F.col("id").alias("node"), "component"), "node", "left").select("h", "band", "node", "n", "place", F.coalesce("component", "node").alias("c")))
    per = where.groupBy("h", "c").agg(F.count("*").alias("m"))
    top = per.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("cs")).where("cs > 1").drop("cs")
    mixed = cut(heavy_join(where, top, ["h"], "m"))
    if mixed.isEmpty():
        return mixed.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # one member is the pivot of many buckets of a group of near copies
    pivots = cut(hubs.groupBy("p").agg(F.sum("m").alias("m")).join(nodes.select(F.col("node").alias("p"), F.col("bits").alias("pbits"), F.col("n").alias("pn")), "p"))
    near = links.select("a", "b").union(links.select("b", "a")).select(F.col("a").alias("p"), F.col("b").alias("node")).withColumn("spoke", F.lit(True))
    y = mixed.join(hubs.drop("m"), ["h", "band"], "left").join(near, ["p", "node"], "left").select("h", "band", "node", "n", "place", "c", "main", (F.coalesce("spoke", F.lit(False)) | (F.col("p") == F.col("node"))).alias("spoke"))
    x = mixed.where("c <> main").select("h", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "node", "n", "place", "c")
    # a member too far from a band's pivot p is too far from all that are within reach of p: similarity to p under 2 t - 1 rules them out
    bits = nodes.select("node", "bits")
    x = heavy_join(x.join(hubs.drop("m"), ["h", "band"]).join(bits, "node"), pivots, ["p"], "m")
    apart, both = _apart(F.col("bits"), F.col("pbits")), F.col("n") + F.col("pn")
    far = den * (both - apart) < (2 * num - den) * (both + apart)
    x = cut(x.select("h", "band", "node", "n", "place", "c", far.alias("far"))).alias("x")
    y, s = cut(y).alias("y"), num + den
    return x.join(
        y,
        (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & ~(F.col("x.far") & F.col("y.spoke"))
        & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
        & (s * (1 + F.least(F.col("x.n") - F.col("x.place") - 1, F.col("y.n") - F.col("y.place") - 1)) >= num * (F.col("x.n") + F.col("y.n"))),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def classes(docs: DataFrame, *, size: int = 5, num: int = 4, den: int = 5, hot_least: int = 64, hot_most: int = 200_000, most_pairs: int = 48, range_mb: int = 10) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, t (fingerprint of the text), n_shingles, component_id, best (null, doc_id, t of the class's first row)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _describe(size)
    seen = cut(docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema))
    about = seen.where("kind = 0").select("doc_id", "t", *NAME)
    common = seen.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("c")).where(F.col("c") >= hot_least).orderBy(F.desc("c"), "f1").limit(hot_most).toArrow()
    hot, hot_count = common["f1"].to_numpy().view(_U), common["c"].to_numpy()
    order = np.argsort(hot)
    total = about.agg(F.sum("n")).first()[0] or 0
    session_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session_parts, int(total * (den - num) / den * 16 / (range_mb << 20)) + 1)
    shared = spark.sparkContext.broadcast((hot[order], hot_count[order]))  # at most hot_most shingles

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(size, num, den, parts, *shared.value)(batches)

    found = cut(docs.select("text").mapInArrow(prefixes, PACKED).repartition(parts, "rng").groupBy("rng").applyInArrow(_pair(num, den, most_pairs), FOUND))
    # equal sets are one node; its number holds from here on, as it is written
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("best")
    sets = about.where("n > 0").groupBy(*NAME).agg(best, F.count("*").alias("m"))
    sketches = seen.where("kind = 0 and bits is not null").groupBy(*NAME).agg(F.first("bits").alias("bits"), F.min("t").alias("t"))
    nodes = cut(sets.join(sketches, NAME).withColumn("node", F.monotonically_increasing_id()))
    number = nodes.select("node", *NAME)
    small = found.where("kind = 0").select(*NAME, "nb", "f1b", "f2b").distinct().join(number.withColumnRenamed("node", "a"), NAME).select("a", F.col("nb").cast("long").alias("n"), F.col("f1b").alias("f1"), F.col("f2b").alias("f2"))
    small = small.join(number.withColumnRenamed("node", "b"), NAME).select("a", "b")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))).cast("int").alias("band")
    member = found.where("kind = 1").select("h", F.col("n").cast("long").alias("n"), "f1", "f2", "place").join(number, NAME).groupBy("h", "node", "n").agg(F.min("place").alias("place"))
    member = cut(member.select("h", band, "node", "n", "place"))
    # the pivot is the member with the fewest rarer shingles of its own: of a group of near copies, the one nearest to what they have in common
    hubs = cut(member.groupBy("h", "band").agg(F.min_by("node", F.struct("place", "node")).alias("p"), F.count("*").alias("m")))
    star = heavy_join(member, hubs, ["h", "band"], "m").where("node <> p").select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(docs, nodes, small.union(star), size, num, den)
    comp = cut(components(links))
    rest = _rest(member, nodes, links, comp, hubs, num, den)
    more = _links(docs, nodes, rest, size, num, den)
    if not more.isEmpty():
        comp = cut(components(links.union(more)))
    of = nodes.join(comp.withColumnRenamed("id", "node"), "node", "left").select(*NAME, "best", "m", F.coalesce("component", "node").alias("c"))
    firsts = of.groupBy("c").agg(F.min("best").alias("first"), F.min("best.doc_id").alias("component_id"), F.count("*").alias("k"))
    of = cut(heavy_join(of.drop("best"), firsts, ["c"], "k").select(*NAME, "m", "first", "component_id"))
    linked = heavy_join(about.where("n > 0"), of, NAME, "m").select("doc_id", "t", "n", "component_id", "first")
    alone = about.where("n = 0").select("doc_id", "t", "n", F.col("doc_id").alias("component_id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t").alias("first"))
    return linked.union(alone).withColumnsRenamed({"n": "n_shingles", "first": "best"})


def join(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id. `how` is that of `classes`.

    Documents are linked when their sets' similarity is num / den or more; component_id is the least doc_id reachable. Every row is a
    document by its own text: rows that repeat a doc_id with other texts are linked each for itself, rows without doc_id link like others
    and have the least doc_id of their component, null if it has none. Null and empty texts have no shingles and are linked with nothing.
    Texts of any length are taken whole. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    return classes(docs, **how).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that are alone or the first of their class: of the least doc_id, then of the least fingerprint of the text.

    Rows without doc_id come last; of rows alike in doc_id and text, one stays. Rows without words are in no class and stay.
    """
    found = cut(classes(docs, **how).where("n_shingles > 0").select("doc_id", F.col("t").alias("__t"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t"))).alias("stays")))
    rows = docs.withColumn("__t", F.xxhash64("text"))
    on = ["doc_id", "__t"]
    out = without(rows, found.where("not stays"), on)
    twice = cut(found.where("stays").groupBy(*on).agg(F.count("*").alias("m")).where("m > 1").select(F.xxhash64(*on).alias("key")))
    if not twice.isEmpty():
        again = F.col("text").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]") & bloom(twice, twice.count(), 41, 12, 4).says(F.xxhash64(*on))
        again = F.coalesce(again, F.lit(False))
        out = out.where(~again).union(out.where(again).dropDuplicates(on))
    return out.select(*docs.columns)


def brute_force(docs: list[tuple], size: int = 5) -> dict:
    """What op6 returns for small lists, straight from the definition."""
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: op6 from its definition: sets of equal shingles are one, pairs that share a shingle are counted, and links are followed from each set.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[k + 1 : k + least(5, len(w))], 'string_agg', ' ') AS g FROM d, LATERAL (SELECT unnest(range(greatest(1, len(w) - 4))) AS k) WHERE len(w) > 0),
f AS (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
e AS (SELECT h, min(doc_id) AS rep, min(n) AS n FROM f GROUP BY h),
t AS (SELECT rep, n, g FROM e JOIN s ON s.doc_id = e.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT rep AS a, rep AS b FROM e UNION SELECT c.a, p.b FROM c JOIN p ON p.a = c.b),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, coalesce(f.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN f USING (doc_id) LEFT JOIN e USING (h) LEFT JOIN m ON m.a = e.rep"""
