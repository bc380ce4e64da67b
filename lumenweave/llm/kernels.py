"""Vectorised byte kernels: words, their fingerprints, word shingles. All work on whole texts.

A text is UTF-8; separators are ASCII, so cutting bytes and cutting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit touches each output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _table(keep) -> np.ndarray:
    t = _FOLD.copy()
    t[[b for b in range(256) if not keep(b)]] = 0
    return t


#: folded byte for a byte of a word, 0 for a separator
ALNUM = _table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 0x20  # the byte 0 belongs to words here; it takes the code of the space, which never does
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def slices(ids: pa.Array | list, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cuts a column of strings into runs of whole texts of about `most` bytes: (rows, bytes, offsets). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        to = min(to, len(texts))
        yield slice(at, to), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end, fingerprint) of each word, in order. Bytes are folded by `table`; no word spans texts."""
    n = len(buf)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    folded = table[buf]
    inside = folded != 0
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edge = offs[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _upto(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[folded] * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return np.searchsorted(offs, start, "right") - 1, start, end, mix(h + (end - start).astype(np.uint64))


def runs(doc: np.ndarray, h: np.ndarray, size: int, n_docs: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of `size` consecutive words: (text index, first word, fingerprint), in order of texts.

    With `short`, a text of fewer words, but not none, has one run: its whole sequence.
    """
    n = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    if len(h) >= size:
        m = len(h) - size + 1
        acc = np.zeros(m, np.uint64)
        for k in range(size):
            acc = acc * _U(_BASE) + h[k : k + m]
        ok = doc[:m] == doc[size - 1 :]
        at = np.flatnonzero(ok)
        who, fp = doc[at], mix(acc[at] + _U(size))
    else:
        at, who, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    few = np.flatnonzero((n > 0) & (n < size)) if short else np.empty(0, np.int64)
    if len(few):
        extra = []
        for d in few:
            a = _U(0)
            with np.errstate(over="ignore"):
                for x in h[first[d] : first[d] + n[d]]:
                    a = a * _U(_BASE) + x
            extra.append(a + _U(n[d]))
        who, at, fp = np.concatenate([who, few]), np.concatenate([at, first[few]]), np.concatenate([fp, mix(np.array(extra, np.uint64))])
        order = np.argsort(who, kind="stable")
        who, at, fp = who[order], at[order], fp[order]
    return who, at, fp
