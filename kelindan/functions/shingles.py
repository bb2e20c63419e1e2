"""Shingle sets of normalised texts by arrays of numbers, many texts at a time, for Python workers.

Words are hashed by a polynomial over their bytes, whose running sum gives any word's value from two places; a shingle's hash is a mixed sum of its words'
hashes by place. Nothing depends on how texts are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20250917)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text, and so many words' bytes, that are gone through at once.
BLOCK = 1 << 21


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Every bit of the result depends on every bit of the hashes."""
    h = h + np.uint64((salt * _BASE + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low = int(starts[at])
        part = data[low : int(ends[upto - 1])]
        up, down = _powers(1 << max(16, int(len(part)).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64, out=total[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((total[e] - total[s]) * down[s], 1)
        at = upto
    return out


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends) of non-empty normalised texts, words apart by one blank: the sorted distinct hashes of each text's k-word sequences, one text after the
    other, and where each text's begin, the last one's end included. Fewer words are one sequence; k is 64 at most. A text that is several, apart by a line break each, has the sequences of all."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    blanks, breaks = np.nonzero(data == 32)[0], np.nonzero(data == 10)[0]
    whole = np.arange(len(bounds)) + np.searchsorted(breaks, bounds)  # of each text's parts
    begin, end = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
    n = 1 + np.searchsorted(blanks, end) - np.searchsorted(blanks, begin)
    first = np.concatenate([[0], np.cumsum(n)])  # of each part's words
    w = _word_hashes(data, np.sort(np.concatenate([begin, blanks + 1])), np.sort(np.concatenate([blanks, end])))
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    runs = np.zeros(len(w), np.uint64)
    for j in range(k):
        runs += _PLACE[j] * padded[j : j + len(w)]
    for i in np.nonzero(n < k)[0]:
        own = w[first[i] : first[i + 1]]
        runs[first[i] : first[i] + 1] = (_PLACE[: len(own)] * own).sum(dtype=np.uint64, keepdims=True) + mix(np.array([len(own)], np.uint64), 2)
    size = np.maximum(n - k + 1, 1)
    at = np.concatenate([[0], np.cumsum(size)])
    hashes = mix(runs[np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], size)], 3)
    at = at[whole]
    for a, b in zip(at[:-1], at[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in pieces whose texts have about ``BLOCK`` bytes at most."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
            yield batch.slice(at, upto - at)
            at = upto
