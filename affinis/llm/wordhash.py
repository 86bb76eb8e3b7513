"""Words of a batch of texts as 64-bit hashes, by NumPy over the batch's bytes.

A word is a run of anything but the six ASCII white-space bytes. Its hash is a polynomial over its bytes
modulo 2^64, each byte mapped by a fixed random table, then mixed. Hashes of word windows are polynomials
over word hashes, mixed likewise. The same bytes give the same hash in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WORD_ODD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once: bounds the arrays of a step to some MB.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of data; a word that crosses a step's edge is carried whole into the next."""
    hs, starts, ends, at, n = [], [], [], 0, len(data)
    raw = np.frombuffer(data, np.uint8)
    while at < n:
        stop = min(n, at + CHUNK)
        while stop < n and not _SPACE[raw[stop]] and not _SPACE[raw[stop - 1]]:
            more = np.flatnonzero(_SPACE[raw[stop : stop + CHUNK]])
            stop = stop + int(more[0]) if len(more) else min(n, stop + CHUNK)
        part = raw[at:stop]
        edge = np.diff(np.r_[True, _SPACE[part], True].astype(np.int8))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * _powers(_ODD_INV, len(part)), dtype=np.uint64)]
        h = (sums[b] - sums[a]) * _powers(_ODD, len(part) + 1)[a]
        hs.append(mix(h + (b - a).astype(np.uint64)))
        starts.append(a + at)
        ends.append(b + at)
        at = stop
    cat = lambda x, t: np.concatenate(x) if x else np.array([], t)
    return cat(hs, np.uint64), cat(starts, np.int64), cat(ends, np.int64)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.array([], np.uint64)
    # doubling: a window of length a + b is the first a, then the next b
    power, have, out, got = h, 1, None, 0
    left = size
    while left:
        if left & 1:
            if out is None:
                out, got = power, have
            else:
                m = len(h) - (got + have) + 1
                out = out[:m] * _mult(have) + power[got : got + m]
                got += have
        left >>= 1
        if left:
            m = len(h) - 2 * have + 1
            power = power[:m] * _mult(have) + power[have : have + m]
            have *= 2
    return mix(out[:n])


def _mult(n: int) -> np.uint64:
    return np.uint64(pow(int(_WORD_ODD), n, 2**64))


def texts(doc_texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, owner) of successive runs of texts of about `limit` bytes: owner is each word's text number."""
    i = 0
    while i < len(doc_texts):
        j, size = i, 0
        while j < len(doc_texts) and (j == i or size + len(doc_texts[j]) <= limit):
            size += len(doc_texts[j]) + 1
            j += 1
        h, start, _ = hash_words(b" ".join(doc_texts[i:j]))
        bounds = np.cumsum([len(t) + 1 for t in doc_texts[i:j]])
        yield i, j, h, np.searchsorted(bounds, start, side="right") + i
        i = j


def runs(column: pa.Array, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, owner) of successive runs of a column's texts; few texts are held as Python objects at a time."""
    for i in range(0, len(column), rows):
        for _, _, h, owner in texts([(x.as_py() or "").encode() for x in column.slice(i, rows)]):
            yield h, owner + i


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` gram hashes, the place of the smallest (the leftmost of equal ones)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.array([], np.int64)
    # sliding minimum by doubling over (value, place), compared by value and then by place
    best, at, have = grams, np.arange(len(grams)), 1
    while have * 2 <= window:
        m = len(best) - have
        left = best[:m] <= best[have:]
        best, at = np.where(left, best[:m], best[have:]), np.where(left, at[:m], at[have:])
        have *= 2
    rest = window - have
    left = best[:n] <= best[rest : rest + n]
    return np.where(left, at[:n], at[rest : rest + n])
