"""Toxicity by a linear-chain conditional random field over the words of a text.

Labels mark documents, so the token labels that the field is trained on are derived first: within
documents labelled toxic, a word is labelled toxic if one of its features (the word, or a prefix of
it) is far commoner per word in toxic than in clean training documents and occurs in several toxic
ones; all other words are labelled clean. The field has two states, emission weights on those
features and four transition weights, and is fitted by gradient ascent on the exact likelihood.
Forward-backward marginals give each word's probability; a document's score is a logistic function
of their sum and of the text's length, calibrated on training documents that the field has not seen.

Inference is one scan of the documents without a shuffle; each text is read whole, and only the
model (bounded by `max_features`) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fold, ship, table, trim
from .kernels import _BYTE, ALNUM, _upto, mix, runs, slices, words

PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
WHOLE = 99
_FILTER_BITS = 22


@dataclass
class Field:
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    calib: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0, 0, 0, 0]))

    def filter(self) -> np.ndarray:
        f = np.zeros(1 << _FILTER_BITS, bool)
        f[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return f


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, feature fingerprints) for the word itself and for each prefix length that the word exceeds."""
    yield np.arange(len(h)), mix(h ^ np.uint64(WHOLE))
    if len(h) == 0:
        return
    power, inverse = _upto(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[ALNUM[buf]] * power[: len(buf)], out=total[1:])
    for k in PREFIXES:
        at = np.flatnonzero(end - start > k)
        s = start[at]
        yield at, mix((total[s + k] - total[s]) * inverse[s] + np.uint64(k * 0x9E3779B9))


def emissions(model: Field, filt: np.ndarray, buf, start, end, h) -> np.ndarray:
    """Log-odds of the toxic state for each word."""
    e = np.full(len(h), model.bias)
    if len(model.keys) == 0:
        return e
    m = np.uint64((1 << _FILTER_BITS) - 1)
    for at, f in features(buf, start, end, h):
        hit = np.flatnonzero(filt[(f & m).astype(np.int64)])
        if len(hit):
            pos = np.minimum(np.searchsorted(model.keys, f[hit]), len(model.keys) - 1)
            ok = model.keys[pos] == f[hit]
            np.add.at(e, at[hit[ok]], model.weights[pos[ok]])
    return e


def _scan(num: np.ndarray) -> np.ndarray:
    """Values x_t of the recursion x_t = (a x + b) / (c x + d) over matrices num[t] = (a, b, c, d), from x = 1.

    The sequence is cut into about sqrt(n) blocks; the blocks' products are formed side by side,
    chained, and applied side by side.
    """
    n = len(num)
    if n == 0:
        return np.empty(0)
    width = max(1, int(np.sqrt(n)))
    length = -(-n // width)
    pad = np.zeros((width * length, 4))
    pad[n:, 0] = pad[n:, 3] = 1.0
    pad[:n] = num
    m = pad.reshape(width, length, 4).transpose(1, 2, 0)
    a, b, c, d = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(length):
        p, q, r, s = m[t]
        a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
        z = a + b + c + d
        a, b, c, d = a / z, b / z, c / z, d / z
    x, first = 1.0, np.empty(width)
    for k in range(width):
        first[k] = x
        x = (a[k] * x + b[k]) / (c[k] * x + d[k])
    out = np.empty((length, width))
    x = first
    for t in range(length):
        p, q, r, s = m[t]
        x = (p * x + q) / (r * x + s)
        out[t] = x
    return out.T.reshape(-1)[:n]


def forward_backward(e: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of the toxic state, forward ratios, backward ratios); begins marks each sequence's first word."""
    n = len(e)
    if n == 0:
        return np.empty(0), np.empty(0), np.empty(0)
    o, t = np.exp(np.clip(e, -30, 30)), np.exp(trans)
    m = np.empty((n, 4))
    m[:, 0], m[:, 1], m[:, 2], m[:, 3] = t[1, 1] * o, t[0, 1] * o, t[1, 0], t[0, 0]
    m[begins] = np.stack([np.zeros(begins.sum()), o[begins] * np.exp(start), np.zeros(begins.sum()), np.ones(begins.sum())], 1)
    x = np.clip(_scan(m), 1e-300, 1e300)
    # y_t from y_{t+1}; the word after t decides, and a sequence's last word starts from 1
    m = np.empty((n, 4))
    nxt = np.empty(n)
    nxt[:-1], nxt[-1] = o[1:], 1.0
    m[:, 0], m[:, 1], m[:, 2], m[:, 3] = t[1, 1] * nxt, t[1, 0], t[0, 1] * nxt, t[0, 0]
    last = np.empty(n, bool)
    last[:-1], last[-1] = begins[1:], True
    m[last] = (0.0, 1.0, 0.0, 1.0)
    y = np.clip(_scan(m[::-1])[::-1], 1e-300, 1e300)
    r = x * y
    return np.where(np.isfinite(r), r / (1 + r), 1.0), x, y


def gradient(e: np.ndarray, y: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: float, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the log-likelihood of labels y over the sequences that `use` marks: by each word's emission, the transitions, the start weight."""
    p, x, back = forward_backward(e, begins, trans, start)
    over, t = np.where(use, y - p, 0.0), np.exp(trans)
    after = np.flatnonzero(~begins & use)
    o = np.exp(np.clip(e[after], -30, 30)) * back[after]
    q = np.stack([np.full(len(after), t[0, 0]), t[0, 1] * o, x[after - 1] * t[1, 0], x[after - 1] * t[1, 1] * o])
    q /= q.sum(0)
    return over, (np.bincount(y[after - 1] * 2 + y[after], minlength=4) - q.sum(1)).reshape(2, 2), over[begins].sum()


def _begins(doc: np.ndarray) -> np.ndarray:
    b = np.ones(len(doc), bool)
    b[1:] = doc[1:] != doc[:-1]
    return b


def _aggregate(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """What the document score is made of: log of the expected toxic words, their share, log length, an any-toxic term."""
    n = np.bincount(doc, minlength=n_docs)[:n_docs].astype(float)
    e = np.bincount(doc, weights=p, minlength=n_docs)[:n_docs]
    return np.stack([np.ones(n_docs), np.log1p(e), np.minimum(100 * e / np.maximum(n, 1), 10), np.log1p(n), np.minimum(e, 3)], 1)


def _merge(counts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, inv = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    return (keys, *(np.bincount(inv, weights=np.concatenate([c[k] for c in counts]), minlength=len(keys)).astype(np.int32) for k in (1, 2, 3)))


def fit(texts: list[str], toxic: np.ndarray, prior: float, *, max_features: int = 50_000, least_docs: int = 4, lift: float = 6.0, steps: int = 20) -> Field:
    """Fits the field on labelled texts held in memory. Near copies of a text count once.

    No toxic or no clean text: a field that scores everything alike.
    """
    model = Field()
    toxic = np.asarray(toxic, bool)
    column = pa.array(texts, pa.large_string())
    seen: set[int] = set()
    keep = np.zeros(len(texts), bool)
    for rows, buf, offs in slices([], column, 1 << 19):
        doc, _, _, h = words(buf, offs, ALNUM)
        who, _, fp = runs(doc, h, 5, len(offs) - 1)
        bounds = np.searchsorted(who, np.arange(len(offs)))
        for d in range(len(offs) - 1):
            own = fp[bounds[d] : bounds[d + 1]]
            low = [int(x.min()) for k in range(4) if len(x := own[(own & np.uint64(3)) == k])]
            keep[rows.start + d] = bool(low) and sum(x in seen for x in low) < 2
            seen.update(low)
    column, label = column.filter(pa.array(keep)), toxic[keep]
    n_docs = len(label)
    if n_docs == 0 or label.all() or not label.any():
        return model
    # the field learns from two thirds of the documents, calibration from the rest
    held = mix(np.arange(n_docs, dtype=np.uint64)) % np.uint64(3) == 0
    # first reading, into a fixed table by hash: in how many toxic documents each slot's features are; a slot never shows too few
    slots = np.zeros(1 << _FILTER_BITS, np.uint16)
    low = np.uint64((1 << _FILTER_BITS) - 1)
    for rows, buf, offs in slices([], column, 1 << 18):
        doc, s, e, h = words(buf, offs, ALNUM)
        use = (label & ~held)[rows.start : rows.stop]
        for at, f in features(buf, s, e, h):
            ok = use[doc[at]]
            pairs = np.unique((f[ok] & low).astype(np.int64) * len(offs) + doc[at[ok]])
            np.add.at(slots, pairs // len(offs), 1)
    promising = slots >= least_docs
    # second reading: exact counts of the features in slots that may be common enough
    counts, wt, wc = [], 1, 1
    for rows, buf, offs in slices([], column, 1 << 18):
        doc, s, e, h = words(buf, offs, ALNUM)
        tok, fps = [], []
        for at, f in features(buf, s, e, h):
            ok = promising[(f & low).astype(np.int64)] & ~held[rows.start + doc[at]]
            tok.append(doc[at[ok]])
            fps.append(f[ok])
        tok, fps = np.concatenate(tok), np.concatenate(fps)
        bad = label[rows.start + tok]
        keys, inv = np.unique(fps, return_inverse=True)
        pairs = np.unique(inv[bad] * len(offs) + tok[bad]) // len(offs)
        counts.append((keys, *(np.bincount(x, minlength=len(keys)).astype(np.int32) for x in (inv[bad], inv[~bad], pairs))))
        wt += int((label & ~held)[rows.start + doc].sum())
        wc += int((~label & ~held)[rows.start + doc].sum())
        if len(counts) == 16:
            counts = [_merge(counts)]
    keys, ct, cc, in_docs = _merge(counts)
    del counts, slots, promising
    ratio = np.log((ct + 0.5) / wt) - np.log((cc + 0.5) / wc)
    strong = np.flatnonzero((in_docs >= least_docs) & (ratio >= np.log(lift)))
    strong = strong[np.argsort(-in_docs[strong] * ratio[strong], kind="stable")][:max_features]
    strong.sort()
    if len(strong) == 0:
        return model
    # third reading: where the chosen features stand
    chosen, tok, feat, doc_of, at = keys[strong], [], [], [], 0
    for rows, buf, offs in slices([], column, 1 << 19):
        doc, s, e, h = words(buf, offs, ALNUM)
        for w, f in features(buf, s, e, h):
            pos = np.minimum(np.searchsorted(chosen, f), len(chosen) - 1)
            hit = np.flatnonzero(chosen[pos] == f)
            tok.append(w[hit] + at)
            feat.append(pos[hit])
        doc_of.append((doc + rows.start).astype(np.int32))
        at += len(doc)
    doc, tok, feat = np.concatenate(doc_of), np.concatenate(tok), np.concatenate(feat)
    y = np.zeros(len(doc), bool)
    y[tok] = True
    y &= label[doc]
    model.keys = chosen
    k = len(chosen)
    begins = _begins(doc)
    train = ~held[doc]
    order = np.argsort(tok, kind="stable")
    tok, feat = tok[order], feat[order]
    # documents are worked through in runs of some 100,000 words, so that memory does not follow the sample
    firsts = np.flatnonzero(begins)
    edges = np.unique(np.append(firsts[np.searchsorted(firsts, np.arange(0, len(doc), 100_000))[np.searchsorted(firsts, np.arange(0, len(doc), 100_000)) < len(firsts)]], len(doc)))
    parts = list(zip(edges[:-1], edges[1:], np.searchsorted(tok, edges[:-1]), np.searchsorted(tok, edges[1:]), strict=True))

    def unpack(theta):
        return theta[:k], theta[k], theta[k + 1 : k + 5].reshape(2, 2), theta[-1]

    def scores(theta, part):
        lo, hi, i, j = part
        w, bias, tr, start = unpack(theta)
        e = np.full(hi - lo, bias)
        np.add.at(e, tok[i:j] - lo, w[feat[i:j]])
        return e, begins[lo:hi], tr, start

    share = (float((y & train).sum()) + 1.0) / (float(train.sum()) + 2.0)
    theta = np.concatenate([np.full(k, 2.0), [np.log(share / (1 - share)) - 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, _, tr, start = unpack(theta)
        grad = np.concatenate([-0.5 * w, [0.0], -0.5 * tr.reshape(-1), [-0.5 * start]])
        for part in parts:
            lo, hi, i, j = part
            if not train[lo:hi].any():
                continue
            e, first, tr, start = scores(theta, part)
            over, moves, first_over = gradient(e, y[lo:hi].astype(np.int64), first, tr, start, train[lo:hi])
            grad[:k] += np.bincount(feat[i:j], weights=over[tok[i:j] - lo], minlength=k)
            grad[k] += over.sum()
            grad[k + 1 : k + 5] += moves.reshape(-1)
            grad[-1] += first_over
        mean, var = 0.9 * mean + 0.1 * grad, 0.97 * var + 0.03 * grad * grad
        theta = theta + 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.97**step)) + 1e-8)
    model.weights, model.bias, model.trans, model.start = (x if isinstance(x, np.ndarray) else float(x) for x in unpack(theta))
    p = np.concatenate([forward_backward(*scores(theta, part))[0] for part in parts])
    # calibration: logistic regression, with the sample weighted back to the labels' prior
    xs, ys = _aggregate(p, doc, n_docs)[held], label[held].astype(float)
    wt = np.where(ys > 0, prior / max(ys.mean(), 1e-9), (1 - prior) / max(1 - ys.mean(), 1e-9))
    c = np.zeros(xs.shape[1])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(xs @ c, -30, 30)))
        g = xs.T @ (wt * (ys - z)) - np.array([0, 0.1, 0.1, 0.1, 0.1]) * c
        hess = (xs * (wt * z * (1 - z))[:, None]).T @ xs + np.diag([1e-6, 0.1, 0.1, 0.1, 0.1])
        c = c + np.linalg.solve(hess, g)
    model.calib = c
    return model


def spans_of(p: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, chars: np.ndarray, offs: np.ndarray, at: float) -> list[list[dict]]:
    """Runs of words with marginals of `at` or more, as character offsets (begin, end) and mean marginal, for each text."""
    out: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
    hit = np.flatnonzero(p >= at)
    if len(hit) == 0:
        return out
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (doc[hit][1:] != doc[hit][:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(hit) - 1]])
    mean = np.add.reduceat(p[hit], first) / (last - first + 1)
    for a, b, m in zip(hit[first], hit[last], mean, strict=True):
        d = doc[a]
        out[d].append({"begin": int(chars[start[a]] - chars[offs[d]]), "end": int(chars[end[b]] - chars[offs[d]]), "score": float(m)})
    return out


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 1000, max_clean: int = 2500, folds: int = 3, held: int = 1, max_train_chars: int = 1_000_000, max_total_chars: int = 32_000_000) -> Field:
    """Fits on a bounded sample of labelled documents outside the held-out fold: at most max_toxic and max_clean rows, by hash order, of at most
    max_train_chars characters each and max_total_chars together. A doc_id with two labels counts under each; rows that repeat a doc_id are one."""
    lab = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), folds) != held).select("doc_id", "toxic").distinct()
    prior = lab.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    some = [lab.where(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    # at most max_toxic + max_clean ids: bounded, so it may be broadcast; of rows that repeat an id, one text is taken, the least by hash
    ids = F.broadcast(some[0].union(some[1]))
    known = docs.select("doc_id", "text").join(ids, "doc_id").where(F.length("text").between(1, max_train_chars))
    sizes = known.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("g"), F.length("text").alias("n"))).alias("x")).select("doc_id", "toxic", "x.*").toArrow().sort_by([("g", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    few = sizes.slice(0, int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), max_total_chars, "right")))
    if few.num_rows == 0:
        return Field()
    chosen = docs.sparkSession.createDataFrame(few.select(["doc_id", "toxic", "g"]))
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("g")).dropDuplicates(["doc_id", "toxic"]).select("doc_id", "text", "toxic").toArrow()
    order = np.lexsort((got["toxic"].to_numpy(), got["doc_id"].to_numpy()))
    texts, tox = got["text"].take(order), got["toxic"].to_numpy()[order] == 1
    model = fit(texts.combine_chunks().cast(pa.large_string()), tox, float(prior or 0.0))
    del got, texts
    trim()
    return model


def score(docs: DataFrame, model: Field, *, spans: bool = True, span_at: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, n_words, n_toxic (expected toxic words) and spans for each row; with `carry`, also the row's text and, as struct
    `rest`, its columns of these names. Null and empty texts have no words and get the length-0 score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = docs.select(F.struct(*carry).alias("rest")) if carry else None
    names = ["doc_id", "score", "n_words", "n_toxic", "spans", *(["text", "rest"] if carry else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        filt = model.filter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows, buf, offs in slices(ids, texts):
                n = len(offs) - 1
                doc, s, e, h = words(buf, offs, ALNUM)
                p, _, _ = forward_backward(emissions(model, filt, buf, s, e, h), _begins(doc), model.trans, model.start)
                agg = _aggregate(p, doc, n)
                z = 1 / (1 + np.exp(-np.clip(agg @ model.calib, -30, 30)))
                if spans:
                    chars = np.zeros(len(buf) + 1, np.int64)
                    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
                    found = spans_of(p, doc, s, e, chars, offs, span_at)
                else:
                    found = [None] * n
                yield pa.RecordBatch.from_arrays(
                    [ids[rows], pa.array(z), pa.array(np.bincount(doc, minlength=n)[:n].astype(np.int64)), pa.array(np.bincount(doc, weights=p, minlength=n)[:n].astype(float)), pa.array(found, SPANS), *[c[rows] for c in batch.columns[1 if carry else 2 :]]],
                    names=names,
                )
        trim()

    kind = StructType.fromDDL("doc_id long, score double, n_words long, n_toxic double, spans array<struct<begin:int,end:int,score:double>>")
    if carry:
        kind = kind.add("text", "string").add("rest", rest.schema["rest"].dataType)
    return docs.select("doc_id", "text", *([F.struct(*carry).alias("rest")] if carry else [])).mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, n_words, n_toxic, spans.

    Null texts score as empty ones. Texts of any length are scored whole. Repeated rows and rows without doc_id are scored each; equal texts
    score alike. Extra columns are ignored, whatever their names. An empty table gives no rows. Without labels all score alike and low.
    """
    model = train(docs, labels)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "n_toxic", "spans"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below threshold: one scan, each row judged by its own text, with or without doc_id."""
    kept = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = score(docs, train(docs, labels), spans=False, carry=kept or ("doc_id",)).where(F.col("score") < threshold)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
