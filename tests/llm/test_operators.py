"""The corpus operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import common, decontamination, jaccard, language, line_dedup, mixing, neighbours, quality, registry, toxicity, url_filter, warc
from lumenweave.llm.common import components, heavy_join

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").limit(300).collect()]
    rows += [(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "a b", "en", None, 3), (10_004, "A  b", None, "s", 4), (10_005, "\n\n", "en", "s", 2), (10_006, "123 ***", "en", "s", 7)]
    rows += [(20_000 + k, rows[0][1] + f" end{k}", "en", "s", 1) for k in range(60)]  # a group of near copies
    rows += [(30_000 + k, rows[1][1], "en", "s", 1) for k in range(60)]  # and of exact ones
    long = " ".join(f"long{k % 997} word{k}" for k in range(40_000))
    rows += [(40_000, long, "en", "s", 1), (40_001, long + " more", "en", "s", 1)]
    return rows


def frame(spark, rows):
    """Columns that clash with the operators' own names ride along."""
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("x"), "n": F.lit(1), "rep": F.lit(1), "selected": F.lit("y"), "i": F.lit(0), "d": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, name):
    """Every query with SQL against DuckDB, row by row."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (5001, 5000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1100)) and got[5001] == 5000


def _jobs(spark, f):
    """What f returns, and how many jobs it ran."""
    sc, group = spark.sparkContext, f"jobs-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_links_take_few_jobs(spark):
    """Gathered or dealt, the components are those of a plain union-find; gathered, a round takes the driver no job for each exchange."""
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + k, 901 + k) for k in range(30)]
    up = {x: x for ab in links for x in ab}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up if any(x in ab and ab[0] != ab[1] for ab in links)}
    run = lambda **how: {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), **how).collect()}
    (got, few), (dealt, many) = _jobs(spark, run), _jobs(spark, lambda: run(one_task=0))
    assert got == dealt == want
    assert 4 * few < 3 * many


def test_a_round_of_raking_is_one_job(spark):
    """The error is seen while the round is written, and is that of the written cells."""
    rng = random.Random(3)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "t", rng.randrange(1, 1000)) for i in range(4) for j in range(3)], "source string, lang string, topic string, tokens long")
    goals = {"source": spark.createDataFrame([(f"s{i}", 0.25) for i in range(4)], "source string, target double"), "lang": spark.createDataFrame([("l0", 0.6), ("l1", 0.3), ("l2", 0.1)], "lang string, target double")}
    since = len(common._written)
    (raked, error), jobs = _jobs(spark, lambda: mixing.rake(cells, goals, fit=0.0))
    rounds = len(common._written) - since - 1
    assert rounds >= 30 and jobs < 2 * rounds
    rows = raked.collect()
    for m, target in (("source", {f"s{i}": 0.25 for i in range(4)}), ("lang", {"l0": 0.6, "l1": 0.3, "l2": 0.1})):
        assert all(abs(sum(r["weight"] for r in rows if r[m] == v) - t) < 1e-9 for v, t in target.items())
    assert error < 1e-9


def test_heavy_join(spark):
    """A key of half of all rows, and keys of one row."""
    rows = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(400)], "a long, x long")
    groups = rows.groupBy("a").agg(F.min("x").alias("first"), F.count("*").alias("n"))
    for most in (1, 3, 1000):
        got = sorted(map(tuple, heavy_join(rows, groups, ["a"], "n", most).select("a", "x", "first").collect()))
        assert got == sorted((0 if k % 2 else k, k, 0 if k % 2 else k) for k in range(400))
    assert heavy_join(rows.limit(0), groups.limit(0), ["a"], "n").count() == 0


@pytest.mark.parametrize("words", [50, 6])
def test_line_dedup(spark, small, words):
    period = [(50_000 + k, "\n".join(["one two three", "four five", "", "six seven eight nine"][j % (2 + k % 3)] for j in range(k)), "en", "s", 1) for k in range(12)]
    rows = [r for r in small if r[0] != 40_001] + period
    want = line_dedup.brute_force([r[:2] for r in rows], words)
    got = {r["doc_id"]: r for r in line_dedup.dedup(frame(spark, rows), least_words=words).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text, gone = want[r[0]]
        if r[1] is None:
            assert got[r[0]]["text"] is None and got[r[0]]["n_removed"] is None
        else:
            assert (got[r[0]]["text"], got[r[0]]["removed"]) == (text, gone)
            assert got[r[0]]["n_lines"] == len(r[1].split("\n")) and got[r[0]]["n_removed"] == len(gone)


def test_line_dedup_repeated_rows_and_none(spark, small):
    assert line_dedup.dedup(empty(spark)).count() == 0
    rows = [small[0], small[0], (None, small[0][1], "en", "s", 1)]
    got = line_dedup.dedup(frame(spark, rows)).collect()
    assert len(got) == 3 and all(r["text"] == small[0][1] for r in got)


def test_url_filter(spark):
    import duckdb

    urls = ["http://example.com/en/x", "https://WWW.Example.com/en/1?q=/es/", "ftp://a.b.net/es/", "http://net/fr/#x", "http://xnet/fr/", "http://a.net/de/", "http://com", "http://com/", "nothing", "", None, "://", "http://é.com/ü?", "x://a.example.com:80/en/", "http://user@example.com/en/y", "http://a//b://c.net/fr/", "http://" + "a." * 500 + "com/" + "y" * 5000]
    pages = spark.createDataFrame([(k, u, "h", "v", "k") for k, u in enumerate(urls)] + [(None, urls[0], "h", "v", "k")], "page_id long, url string, html string, verdict string, keys string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(pages, rules).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [*enumerate(urls), (None, urls[0])])
    assert got == sorted(con.sql(url_filter.OP2_SQL).fetchall(), key=str)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("xxhash64(key) % 5 = 0")
    c = url_filter.build(listed, universe, first_bits=4)
    assert len(c.levels) > 2
    assert universe.where(c.has(F.col("key")) != (F.expr("xxhash64(key) % 5 = 0"))).count() == 0


@pytest.mark.parametrize("most_bits", [1 << 26, 1500])
def test_many_rules_in_shares(spark, most_bits):
    """Rules for two thirds of the hosts, with filters far too small for one cascade, against a plain loop."""
    hosts = [f"h{k}.example{k % 7}.org" for k in range(400)]
    rules = [(h, "/a/", "block" if k % 2 else "allow") for k, h in enumerate(hosts) if k % 3] + [("org", "", "block")]
    urls = [(k, f"http://{'x.' * (k % 2)}{h}/{'a' if k % 5 else 'b'}/p") for k, h in enumerate(hosts)]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), most_bits=most_bits).collect()
    for r in got:
        fits = [(len(h + p), v, h + p) for h, p, v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits)
        assert (r["rule"], r["verdict"]) == (best[2], best[1])
    assert len(got) == 400


def test_crf_gradient():
    """The gradient of the fit against differences of the log-likelihood, summed over all labellings."""
    rng = np.random.default_rng(3)
    n, begins, use = 12, np.zeros(12, bool), np.ones(12, bool)
    begins[[0, 4, 9]] = True
    use[9:] = False
    y = rng.integers(0, 2, n)

    def likelihood(e, tr, start):
        out = 0.0
        for a, z in ((0, 4), (4, 9)):
            score = lambda ys, a=a: sum(e[a + k] * v for k, v in enumerate(ys)) + start * ys[0] + sum(tr[u, v] for u, v in zip(ys[:-1], ys[1:], strict=True))
            out += score(list(y[a:z])) - np.log(sum(np.exp(score([(s >> k) & 1 for k in range(z - a)])) for s in range(1 << (z - a))))
        return out

    e, tr, start, d = rng.normal(size=n), rng.normal(size=(2, 2)), 0.4, 1e-6
    over, moves, first = toxicity.gradient(e, y, begins, tr, start, use)
    base = likelihood(e, tr, start)
    step = np.eye(n) * d
    assert np.allclose(over, [(likelihood(e + step[k], tr, start) - base) / d for k in range(n)], atol=1e-4)
    for i in (0, 1):
        for j in (0, 1):
            t = tr.copy()
            t[i, j] += d
            assert abs(moves[i, j] - (likelihood(e, t, start) - base) / d) < 1e-4
    assert abs(first - (likelihood(e, tr, start + d) - base) / d) < 1e-4


def test_toxicity_repeats_and_clashes(spark, small):
    """Equal texts score alike, with or without doc_id; the stage keeps all columns and drops by text."""
    bad = "you idiot scum moron " * 5
    rows = [(1, bad, "en", "s", 1), (1, bad, "en", "s", 1), (None, bad, None, None, None), (2, small[0][1], "en", "s", 1), (2, small[0][1], "en", "s", 1), (None, None, None, None, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)], "doc_id long, toxic int")
    words = [(k, f"word{k} text{k * 7} with{k % 11} some more words {'idiot scum moron fool' if k % 2 else 'fine day here now'} tail{k * 3}", "en", "s", 1) for k in range(3000)]
    model = toxicity.train(spark.createDataFrame(words + words[:9], DOC), labels)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(frame(spark, rows), model).collect()]
    assert len(got) == 6 and len({s for i, s in got[:3]}) == 1 and got[3][1] == got[4][1] < 0.7 <= got[0][1]
    docs = spark.createDataFrame(words + rows, DOC).withColumn("rest", F.lit(7)).withColumn("score", F.lit("z"))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = [r for r in kept.collect() if r["text"] == bad or r["text"] is None or r["text"] == small[0][1]]
    assert sorted(str(r["doc_id"]) for r in left) == ["2", "2", "None"] and all(r["rest"] == 7 and r["score"] == "z" for r in left)


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, begins, tr = rng.normal(size=23), np.zeros(23, bool), rng.normal(size=(2, 2))
    begins[[0, 5, 6, 20]] = True
    p, _, _ = toxicity.forward_backward(e, begins, tr, 0.3)
    at = np.flatnonzero(begins).tolist() + [23]
    for a, z in zip(at[:-1], at[1:], strict=True):
        n, mass, total = z - a, np.zeros(z - a), 0.0
        for s in range(1 << n):
            y = [(s >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[a + k] * y[k] for k in range(n)) + 0.3 * y[0] + sum(tr[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            mass += w * np.array(y)
        assert np.allclose(mass / total, p[a:z])


def test_toxicity(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1").select("score", "toxic").collect()
    hit = sum(r["toxic"] == 1 and r["score"] >= 0.7 for r in got)
    assert hit >= 0.85 * sum(r["toxic"] for r in got) and sum(r["toxic"] == 0 and r["score"] >= 0.7 for r in got) <= 0.02 * len(got)
    rows = {r["doc_id"]: r for r in toxicity.score(frame(spark, small), model).collect()}
    assert len(rows) == len(small) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[10_001]["score"] == rows[10_002]["score"] and rows[10_001]["spans"] == []
    one = toxicity.score(frame(spark, [(1, "Ä you idiot, moron and scum. Fine", "en", "s", 1)]), model).first()
    assert "idiot" in [("Ä you idiot, moron and scum. Fine")[s["begin"] : s["end"]].split(",")[0] for s in one["spans"]]
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(frame(spark, small[:5]), labels.limit(0)).where("predicted = 0").count() == 5


def test_decontamination(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    items += [(900, "tiny Phrase"), (901, None), (902, "..."), (None, "tiny phrase")]
    rows = small[:60] + small[300:306] + small[-2:] + [(60_000, f"x {items[0][1]} y {items[3][1].upper()}", "en", "s", 1), (60_001, "A TINY, phrase", "en", "s", 1), (60_002, "tiny", "en", "s", 1), (60_003, "phrase tiny phrase tiny phrase", "en", "s", 1)]
    want = decontamination.brute_force([r[:2] for r in rows], [i for i in items if i[0] is not None])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r[1:6]) for r in decontamination.decontaminate(frame(spark, rows), bench).collect()}
    assert got == want and got[60_000][4]
    index = decontamination.build_index(frame(spark, rows), segment_bytes=5000)
    again = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in decontamination.search(index, bench, block_words=50).collect()}
    assert again == {k: v[:3] for k, v in want.items()}
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert decontamination.decontaminate(frame(spark, rows), bench.limit(0)).where("n_items > 0").count() == 0


def test_decontamination_judges_rows_each_in_blocks(spark):
    """Items in many blocks: rows that repeat a doc_id or have none stay rows, as with one block."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(10))) for k in range(6)]
    texts = [items[0][1], items[1][1], " ".join(f"c{j}" for j in range(10)), items[0][1]]
    docs = spark.createDataFrame([(i, t) for i in (7, None) for t in texts] + [(8, f"{items[2][1]} {items[3][1]}"), (9, None), (9, None)], "doc_id long, text string")
    index = decontamination.build_index(docs, segment_bytes=200)
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found(**how):
        rows = decontamination.search(index, bench, **how).select("doc_id", "n_words", "n_hit", "items").collect()
        return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in rows)

    want = [(i, 10, n, x) for i in ("7", "None") for n, x in ((10, "0"), (10, "1"), (0, ""), (10, "0"))] + [("8", 20, 20, "2,3")] + [("9", 0, 0, "")] * 2
    assert found() == found(block_words=10) == sorted(want)


def test_near():
    from lumenweave.llm.kernels import ALNUM, slices, words
    import pyarrow as pa

    texts = ["a b c d e f g", "g x x x x x a", "a c"]
    _, buf, offs = next(slices([], pa.array(texts)))
    doc, _, _, h = words(buf, offs, ALNUM)
    row = dict(zip(["doc_ids", "known", "names", "first", "terms", "counts", "deltas"], decontamination._segment(np.arange(3), np.ones(3, bool), np.zeros((3, 2), np.int64), np.bincount(doc), h), strict=True))
    seg = decontamination.Segment(row)
    _, qb, qo = next(slices([], pa.array(["a c"])))
    q = words(qb, qo, ALNUM)[3]
    assert sorted(seg.doc(decontamination.near(seg, q, 2)).tolist()) == [0, 2] and sorted(seg.doc(decontamination.near(seg, q, 1)).tolist()) == [2]


@pytest.mark.parametrize("how", [{}, {"block_words": 4}])
def test_proximity(spark, how):
    """Against every range of every text; segments of few documents and blocks of few items change nothing."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 40))) for _ in range(30)] + [None, "p q x r s t u", "p q s t u"]
    rows = [(k // 2 if k < 8 else None if k < 10 else k, t) for k, t in enumerate(texts)]
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 12, n))) for k, n in enumerate((0, 1, 2, 4, 5, 9))] + [(6, "p q r s t u"), (None, "w1"), (7, None)]
    size, within = 4, 6
    want = []
    for i, t in rows:
        w = (t or "").split()
        for k, text in items:
            v = (text or "").split()
            got = set()
            for s in range(max(1, len(v) - size + 1)) if v and k is not None else ():
                need = set(v[s : s + size])
                fits = [(b, e) for b in range(len(w)) for e in range(b + 1, min(len(w), b + within) + 1) if need <= set(w[b:e])]
                got |= {(b, e) for b, e in fits if not any((x, y) != (b, e) and b <= x and y <= e for x, y in fits)}
            if got:
                want.append((str(i), str(k), str(sorted(got))))
    for segment_bytes in (60, 1 << 20):
        index = decontamination.build_index(spark.createDataFrame(rows, "doc_id long, text string"), segment_bytes=segment_bytes)
        got = decontamination.proximity(index, spark.createDataFrame(items, "item_id long, text string"), size=size, within=within, **how).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], str(list(zip(r["begins"], r["ends"], strict=True)))) for r in got) == sorted(want)
        assert len({(r["segment"], r["place"], r["item_id"]) for r in got}) == len(want) and any(r["item_id"] == "6" for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 4000)] + 0.4 * rng.normal(size=(4000, 16))).astype("float32")
    x[1000:2200] = x[1000]  # copies
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [1.0] * 3, 0), (5080, [None] * 16, 0), (5100, [], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.search(df, sample=1500, block_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 4000, 20))
    assert 5060 not in got  # the only vector of its length has no other row to find
    x = x.astype(float)
    hit = total = 0
    for q, rs in got.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, 21)) and all(abs(s - x[v] @ x[q]) < 1e-9 and v != q for _, v, s in rs)
        assert [(-round(s, 12), v) for _, v, s in rs] == sorted((-round(s, 12), v) for _, v, s in rs)
        s = np.round((x * x[q]).sum(1), 12)
        s[q] = -np.inf
        hit += len({v for _, v, _ in rs} & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
        total += 20
    assert hit / total >= 0.9
    few = neighbours.search(df.where("vec_id < 6 or vec_id is null")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, k) for k in range(1, 6)]
    assert neighbours.search(df.where("vec_id >= 5000")).count() == 0
    assert neighbours.search(df.limit(0)).count() == 0


def test_neighbours_of_lengths_and_repeats(spark):
    """Against a plain loop: vectors of two lengths, rows that repeat a vec_id with equal and other vectors, ties."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-3, 4, 4 if k % 3 else 6).tolist()) for k in range(200)]
    rows += [(20, [1, 2, 3, 1]), (20, [1, 2, 3, 1]), (40, [0, 0, 1, 1]), (7, rows[7][1])]
    rows = [r for r in rows if any(r[1])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.search(df, k=5, recall=1.0).select("query_id", "rank", "score", "vec_id").collect()))
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(np.dot(v, w)), j) for b, (j, w) in enumerate(rows) if b != a and len(w) == len(v))[:5]
            want += [(i, r, -s, j) for r, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("how", [{}, {"most_pairs": 2, "hot_least": 1}])
def test_jaccard(spark, small, how):
    want = jaccard.brute_force([r[:2] for r in small])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, small), **how).collect()}
    assert got == want and got[20_059][1] == got[20_000][1] and got[40_001][1] == 40_000
    if not how:
        assert jaccard.join(empty(spark)).count() == 0
        rows = jaccard.join(frame(spark, [small[0], small[0], (None, "a b c d e f", None, None, None)])).collect()
        assert sorted(str(r["component_id"]) for r in rows) == sorted([str(small[0][0])] * 2 + ["None"])


def test_jaccard_rows_of_one_id(spark):
    """Rows that repeat a doc_id with other texts link each by its own; rows without doc_id link as well; one row of each class is kept."""
    text = lambda tag, n=30, end="": " ".join(f"{tag}{k}" for k in range(n)) + end
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (9, text("b", end=" more")), (None, text("c")), (None, text("c", end=" x")), (3, text("d")), (3, text("d")), (None, text("a", end=" y")), (7, None), (7, None), (8, ""), (8, " \t"), (6, "Z z"), (6, "z z")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC)
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs).collect())
    want = [(1, 26, 1), (5, 26, 1), (5, 26, 5), (9, 27, 5), (None, 26, None), (None, 27, None), (3, 26, 3), (3, 26, 3), (None, 27, 1), (7, 0, 7), (7, 0, 7), (8, 0, 8), (8, 0, 8), (6, 1, 6), (6, 1, 6)]
    assert got == sorted(map(str, want))
    kept = jaccard.keep_one(docs.withColumn("best", F.lit(1)))
    left = sorted(str((r["doc_id"], r["text"][:1] if r["text"] else r["text"])) for r in kept.collect())
    ends = [str((r["doc_id"], r["text"][:1] if r["text"] else r["text"])) for r in kept.where("text like 'c%'").collect()]
    assert len(ends) == 1 and left == sorted(map(str, [(1, "a"), (5, "b"), (None, "c"), (3, "d"), (7, None), (7, None), (8, ""), (8, " "), kept.where("doc_id = 6").first()["text"] and (6, kept.where("doc_id = 6").first()["text"][:1])]))


def test_jaccard_buckets_of_unlike_texts(spark):
    """Texts made of few phrases, so that most buckets are large and hold several classes: no link is lost to pivots."""
    rng = np.random.default_rng(6)
    phrases = [" ".join(f"p{k}w{j}" for j in range(7)) for k in range(14)]
    rows = [(k, " ".join(phrases[p] for p in sorted(rng.choice(14, rng.integers(3, 9), replace=False)))) for k in range(250)]
    want = jaccard.brute_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), most_pairs=3, hot_least=5).collect()}
    assert got == want and len({c for _, c in want.values()}) > 5


def test_jaccard_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    # every variant is linked with the text it was made from, and hardly with another; all share frequent shingles
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(150):
        text = list(base)
        for k in rng.sample(range(150), 3) if i != 75 else []:
            text[k] = f"v{i}x{k}"
        rows.append((i, " ".join(text)))
    tried, rest = [], jaccard._rest

    def counted(*args):
        pairs = rest(*args)
        tried.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_rest", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), hot_least=16).collect()}
    assert got == jaccard.brute_force(rows)
    assert tried[0] <= len(rows)


def test_quality(spark, small):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.resample(frame(spark, small), labels, share=0.5).collect()}
    live = [r for r in got.values() if r["n_grams"] > 0]
    assert len(got) == len(small) and sum(r["selected"] for r in live) >= len(live) / 2
    assert min(r["key"] for r in live if r["selected"]) > max(r["key"] for r in live if not r["selected"])
    assert not got[10_001]["selected"] and got[10_002]["log_weight"] is None
    assert quality.resample(empty(spark), labels).count() == 0
    assert quality.resample(frame(spark, small[:8]), labels.limit(0)).count() == 8
    twice = quality.resample(frame(spark, [*small[:8], *small[:8], (None, small[0][1], None, None, None)]), labels, share=0.5).collect()
    assert len(twice) == 17 and all(len({r["selected"] for r in twice if r["doc_id"] == i}) == 1 for i in {r["doc_id"] for r in twice})
    keys = spark.createDataFrame([(float(x),) for x in [*range(500), *[7.0] * 300]], "key double")
    ordered = sorted([*map(float, range(500)), *[7.0] * 300], reverse=True)
    assert all(quality.kth_largest(keys, "key", k, bins=5, rest=3) == ordered[k - 1] for k in (1, 2, 491, 600, 800)) and quality.kth_largest(keys, "key", 801) is None


def test_quality_against_a_plain_version(spark, small):
    """Models, weights, keys and the drawn set, recomputed with dictionaries; the hash of words and of doc_id alone is taken from the operator."""
    import math
    from collections import Counter

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    got = {r["doc_id"]: r for r in quality.resample(spark.createDataFrame(small, DOC), labels, share=0.4, buckets=512).collect()}
    noise = {r["doc_id"]: r["u"] for r in spark.createDataFrame(small, DOC).select("doc_id", quality.uniform(F.col("doc_id"), seed=7).alias("u")).collect()}
    bags = {}
    for i, t, *_ in small:
        buf = np.frombuffer((t or "").encode(), np.uint8)
        bags[i] = Counter(quality._grams(buf, np.array([0, len(buf)]), 512)[1].tolist())
        w = len("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split())
        assert sum(bags[i].values()) == got[i]["n_grams"] == max(0, 2 * w - 1)
    raw, target = sum(bags.values(), Counter()), sum((b for i, b in bags.items() if i in good), Counter())
    n_raw, n_target = sum(raw.values()) + 512, sum(target.values()) + 512
    keys = {}
    for i, bag in bags.items():
        if bag:
            w = sum(n * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)) for b, n in bag.items())
            assert abs(w - got[i]["log_weight"]) < 1e-6 * (1 + abs(w))
            keys[i] = w - math.log(-math.log(noise[i]))
            assert abs(keys[i] - got[i]["key"]) < 1e-6 * (1 + abs(keys[i]))
    best = sorted(keys, key=lambda i: -got[i]["key"])[: math.ceil(0.4 * len(keys))]
    assert {i for i, r in got.items() if r["selected"]} >= set(best) and min(got[i]["key"] for i in best) == min(r["key"] for r in got.values() if r["selected"])


def test_warc_repeats(spark):
    """Rows without page_id and rows that repeat one are records each; the response of a payload is its largest page_id."""
    body = "y" * 1500
    rows = [(None, "u", body), (None, "u", body), (3, "u", body), (3, "u", body), (2, "u", body), (2, "u", "z" * 1500), (1, "u", "z" * 1500), (None, None, None)]
    got = warc.read(warc.write(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, d string"))).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])) for r in got) == sorted(map(str, [
        (None, 1500, "response", None), (None, 1500, "response", None), (3, 1500, "response", None), (3, 1500, "response", None), (2, 1500, "revisit", 3), (2, 1500, "response", None), (1, 1500, "revisit", 2), (None, 0, "response", None)
    ]))


def test_warc(spark):
    body = "<html>" + "é x" * 600
    rows = [(1, "http://a/1", body), (2, "http://a/2", body), (3, None, body), (4, "u", "short"), (5, "u\r\nv", "short"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 2_000_000), (9, "u", "x" * 2_000_000)]
    rows += [(100 + k, f"http://b/{k}", f"<p>page {k}</p>" + "common text " * (k % 90)) for k in range(300)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")
    import hashlib

    a = warc.write(pages, archive_mb=1)
    assert a.dictionary_bytes > 0
    got = {r["page_id"]: r for r in warc.read(a).collect()}
    assert len(got) == len(rows)
    for i, u, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b]
        r = got[i]
        revisit = len(b) >= 1000 and i != max(same)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)
        assert r["payload"] is None if revisit else bytes(r["payload"]) == b
        assert r["url"] == (u.replace("\r", "%0D").replace("\n", "%0A") if u else None)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_language(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language.train(docs)
    got = language.predict(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    rows = {r["doc_id"]: r for r in language.predict(frame(spark, small), trees).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (10_001, 10_002, 10_005, 10_006)) and rows[10_003]["lang_pred"] != "und"
    assert language.identify(empty(spark)).count() == 0
    assert language.identify(frame(spark, [(1, "abc", None, None, 3)])).first()["lang_pred"] == "und"


def test_language_ties_and_repeats(spark):
    """Languages of equal samples tie, and the first wins; rows that repeat a doc_id are judged each, rows without doc_id too."""
    rows = [(k, "same old words", lang, "s", 1) for k, lang in enumerate(["bb", "aa"] * 40)] + [(0, "same", "bb", "s", 1), (None, "same", None, None, None), (None, "same", None, None, None)]
    got = language.predict(frame(spark, rows), language.fit({"bb": ["same old words"], "aa": ["same old words"]})).collect()
    assert len(got) == 83 and {r["lang_pred"] for r in got} == {"aa"} and all(abs(r["score"] - 0.5) < 1e-9 for r in got)
    out = language.identify(frame(spark, rows + rows)).collect()
    assert len(out) == 166 and sum(r["held_out"] is None for r in out) == 4


def test_code_lengths_by_hand():
    """Costs of the merged tree against a plain recursive model."""
    import math
    from collections import Counter

    samples = {"a": ["abracadabra abracadabra abracadabra"] * 3, "b": ["banana bandana cabana banana"] * 4}
    trees = language.fit(samples, order=3)
    text = "abanab zq cadabra"
    buf = np.frombuffer(text.encode(), np.uint8)
    got = language.code_lengths(trees, buf, np.array([0, len(buf)]))[0]
    kept = Counter()
    counts = {l: {} for l in samples}
    for l, ts in samples.items():
        joined = "".join("   " + t for t in ts)
        for i in range(3, len(joined)):
            for k in range(4):
                counts[l].setdefault(joined[i - k : i], Counter())[joined[i]] += 1
                kept[joined[i - k : i]] += 1
    for j, l in enumerate(trees.langs):
        bits, lead = 0.0, "   " + text
        for i in range(3, len(lead)):
            k = 0
            while k < 3 and kept[lead[i - k - 1 : i]] >= 4:
                k += 1
            while True:
                c = counts[l].get(lead[i - k : i])
                if c:
                    n, d = sum(c.values()), len(c)
                    if c[lead[i]]:
                        bits -= math.log2(c[lead[i]] / (n + d))
                        break
                    bits -= math.log2(d / (n + d))
                if k == 0:
                    bits += 8
                    break
                k -= 1
        assert abs(bits - got[j]) < 1e-3


def test_mixing(spark, small):
    docs = frame(spark, small)
    out = mixing.mix(docs, share=0.5)
    rows = out.collect()
    assert len(rows) == len(small)
    by = {r["doc_id"]: r for r in rows}
    assert by[10_001]["probability"] == 0 and not by[10_002]["selected"]
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) - 0.5 * total) < 1e-6 * total
    # raking against a plain version
    cells = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "q", 30), ("b", "x", "q", 50), ("b", "y", "p", 5), ("b", "y", "q", 20)], "source string, lang string, topic string, tokens long")
    goal = {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.3, "q": 0.7}}
    tables = {m: spark.createDataFrame(list(g.items()), f"{m} string, target double") for m, g in goal.items()}
    got, error = mixing.rake(cells, tables, rounds=60, fit=1e-9)
    got = got.collect()
    for m, g in goal.items():
        for k, v in g.items():
            assert abs(sum(r["weight"] for r in got if r[m] == k) - v) < 1e-6
    assert error <= 1e-6
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_against_a_plain_version(spark, small):
    """Weights, probabilities and the draw, recomputed with dictionaries; rows that repeat and columns that clash ride along."""
    rows = [*small[:200], small[0], small[0], (None, small[1][1], "en", None, 1)]
    docs = spark.createDataFrame(rows, DOC).withColumn("weight", F.lit("w")).withColumn("probability", F.lit(9)).withColumn("topic", F.lit("odd"))
    out = mixing.mix(docs, share=0.3, topic=F.when(F.length("text") % 2 == 0, "p").otherwise("q")).withColumn("u", mixing.uniform(F.col("doc_id"), seed=11)).collect()
    assert len(out) == len(rows) and out[0]["topic"] in "pq"
    cells = {}
    for r in out:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["n_tokens"]
    total = sum(cells.values())
    goals = []
    for m, f in enumerate((0.5, 0.6, 0.8)):
        t = {}
        for c, n in cells.items():
            t[c[m]] = t.get(c[m], 0) + n
        t = {k: n**f for k, n in t.items() if n}
        goals.append({k: v / sum(t.values()) for k, v in t.items()})
    w = {c: n / total for c, n in cells.items()}
    for _ in range(200):
        for m, g in enumerate(goals):
            held = {}
            for c, v in w.items():
                held[c[m]] = held.get(c[m], 0) + v
            w = {c: v * g.get(c[m], 0) / held[c[m]] if held[c[m]] else 0.0 for c, v in w.items()}
    full = max(w[c] / n for c, n in cells.items() if n) * 0.3 * total <= 1  # no cell is whole: probabilities follow the weights
    for r in out:
        c = (r["source"], r["lang"], r["topic"])
        if cells[c]:
            assert abs(r["weight"] - w[c] * total / cells[c]) < 2e-2 * (1 + r["weight"])
            assert not full or abs(r["probability"] - 0.3 * total * w[c] / cells[c]) < 2e-2
        assert r["selected"] == (r["u"] < r["probability"])


def test_mixing_holds_margins_within_tokens(spark):
    """A cell that its weight would draw more than once: bounded raking holds all margins; what tokens cannot give is told."""
    rows = [(k, "w " * n, lang, source, 1) for k, (source, lang, n) in enumerate([("a", "x", 100), ("a", "y", 700), ("b", "x", 600), ("b", "y", 600)] * 5)]
    docs = spark.createDataFrame(rows, DOC)
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}}
    goals = {m: spark.createDataFrame(list(g.items()), f"{m} string, target double") for m, g in goal.items()}

    def held(share, goals):
        out, table = mixing.mix_with_margins(docs, share=share, topic=F.lit("t"), goals=goals)
        out = out.collect()
        mass = sum(r["n_tokens"] * r["probability"] for r in out)
        assert abs(mass - share * 10_000) < 1e-3 * 10_000 and all(0 <= r["probability"] <= 1 for r in out)
        told = {(r["margin"], r["value"]): r for r in table.collect()}
        assert all(0 <= r["raking_error"] <= 1e-3 for r in told.values())
        for m in goals:
            for v in {r[m] for r in out}:
                assert abs(told[m, v]["expected"] - sum(r["n_tokens"] * r["probability"] for r in out if r[m] == v) / mass) < 1e-9
        return out, told

    # without bounds the cell (a, x), a twentieth of all tokens, would be asked for 0.75 * 0.093 of them
    out, told = held(0.75, goals)
    assert all(abs(told[m, v]["expected"] - t) < 1e-3 for m, g in goal.items() for v, t in g.items()) and max(r["missed"] for r in out) < 2e-3
    assert [r["probability"] for r in out if (r["source"], r["lang"]) == ("a", "x")] == [1.0] * 5
    # source a has 0.4 of the tokens: 0.5 of a sample of 0.9 is not there, and is told
    out, told = held(0.9, goals)
    assert abs(told["source", "a"]["expected"] - 0.4 / 0.9) < 1e-3 and told["source", "a"]["target"] == 0.5 and abs(told["source", "a"]["largest_share"] - 0.8) < 1e-9
    assert all(r["probability"] == 1 and abs(r["missed"] - (1 - 0.8 / 0.9)) < 1e-3 for r in out if r["source"] == "a")


def test_raking_goes_on_while_the_error_falls(spark):
    """Two rounds do not fit here; goals that contradict a source in one language only end, with their error."""
    cells = spark.createDataFrame([("a", "x", "t", 10), ("a", "y", "t", 30), ("b", "x", "t", 50), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    goals = {"source": spark.createDataFrame([("a", 0.6), ("b", 0.4)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "lang string, target double")}
    assert mixing.rake(cells, goals, rounds=2, fit=1e-6)[1] <= 1e-6
    assert mixing.rake(cells.where("not (source = 'a' and lang = 'y')"), goals, rounds=2, fit=1e-6)[1] > 0.1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 100 < len(ids) < docs.count()


def test_stages_remove_what_they_must(spark):
    """Planted documents, with and without doc_id, repeated, and with a column that clashes: each stage takes its own and leaves the rest."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = docs.join(toxicity.toxicity(docs, labels).where("predicted = 1"), "doc_id").join(labels.where("toxic = 1"), "doc_id").where("length(text) between 400 and 2000").orderBy("doc_id").first()["text"]
    clean = lambda tag, n=120: " ".join(f"{tag}{k}" for k in range(n))
    passage = "\n".join(clean(f"line{k}x", 20) for k in range(4))
    planted = [
        (900_001, bad), (None, bad), (900_002, f"{clean('o')} {item}"), (None, f"{item} {clean('r')}"), (900_003, clean("c")), (900_004, clean("c") + " end"), (None, clean("c")),
        (900_005, clean("e") + "\n" + passage), (900_006, clean("f") + "\n" + passage), (900_007, clean("g")), (900_007, clean("g")), (900_008, None), (900_009, ""), (None, clean("z")), (900_010, clean("long", 60_000)),
    ]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], DOC)
    now = docs.select("doc_id", "text", "lang", "source", "n_chars").union(rows).withColumn("predicted", F.lit("x"))
    held = lambda df: sorted(str((r["doc_id"], (r["text"] or "")[:6], len(r["text"] or ""))) for r in df.where("doc_id >= 900000 or doc_id is null").collect())
    name = lambda i, t: str((i, (t or "")[:6], len(t or "")))
    gone = {
        "toxicity": planted[:2], "decontamination": planted[2:4], "near_copies": [planted[5], planted[6], planted[10], planted[1]],
    }
    for n, lost in gone.items():
        out = stages[n](spark, now, SF)
        assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes
        want = sorted(name(*p) for p in planted)
        if n == "near_copies":
            lost = [*lost, planted[0]]  # the text of the first two is that of a document of the table
        for p in lost:
            want.remove(name(*p))
        assert held(out) == want, n
    out = {r["doc_id"]: r for r in stages["line_dedup"](spark, now, SF).where("doc_id >= 900000").collect()}
    assert out[900_005]["text"].endswith(passage) and out[900_006]["text"] == clean("f") and out[900_006]["n_chars"] == len(clean("f")) and out[900_008]["text"] is None and out[900_009]["text"] == ""
    none = now.limit(0)
    for n, stage in stages.items():
        assert stage(spark, none, SF).count() == 0, n


def test_folds(spark):
    got = language.identify(spark.createDataFrame([(k, "the text", "en", "s", 1) for k in range(20)], DOC)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
