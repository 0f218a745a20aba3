"""Sets of word shingles as 64-bit hashes, computed over whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2 ** 64, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 2 ** 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_SHORT = _RNG.integers(1, 2 ** 64, WIDTH, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the texts, in order; A-Z are lower-cased."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = int(off[-1] - off[0])
    if not size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < size]  # a word never runs on into the next text
    begins[edge] |= inside[edge]
    kept = np.flatnonzero(inside)
    if not len(kept):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.flatnonzero(begins[kept])
    lens = np.diff(np.append(starts, len(kept)))
    place = np.arange(len(kept)) - np.repeat(starts, lens)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(lens.max()), _BASE)]))
    data = data[kept]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes = np.add.reduceat(_BYTE[data] * power[place], starts)
    rows = np.searchsorted(off, kept[starts], side="right") - 1
    return mix64(hashes + lens.astype(np.uint64)), rows


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text, one after another.

    A text with fewer words than ``WIDTH`` has its whole sequence as one
    shingle; one without words has none.
    """
    words, rows = _words(texts)
    n = len(texts)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    full = np.zeros(max(0, len(words) - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        full += words[k:k + len(full)] * _PLACE[k]
    full = mix64(full)
    out, size = [], np.zeros(n, dtype=np.int64)
    for r in range(n):
        a, c = first[r], count[r]
        if c >= WIDTH:
            s = np.unique(full[a:a + c - WIDTH + 1])
        elif c:
            s = mix64(np.sum(words[a:a + c] * _PLACE[:c], keepdims=True) + _SHORT[c:c + 1])
        else:
            continue
        out.append(s)
        size[r] = len(s)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(size)])
