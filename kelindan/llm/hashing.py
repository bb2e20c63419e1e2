"""Hashes of words and of runs of words, and a filter of bounded size; shared by the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MULTIPLIER = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words, of one seed; those seen are kept, up to a bound, as texts repeat their words."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, built from those of runs of half the length; empty for fewer words."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    power, factor, have, out, length = h, _MULTIPLIER, 1, None, 0
    while True:
        if k & have:
            # `out` covers the first `length` words of a run; the block of `have` words follows it.
            out = power if out is None else out[: len(power) - length] * np.uint64(factor) + power[length:]
            length += have
        if length == k:
            return mixed(out[: len(h) - k + 1])
        power, factor, have = power[: len(power) - have] * np.uint64(factor) + power[have:], factor * factor % (1 << 64), have * 2


def run_minima(a: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive values."""
    if len(a) < w:
        return a[:0]
    power, have = a, 1
    while have * 2 <= w:
        power, have = np.minimum(power[: len(power) - have], power[have:]), have * 2
    return np.minimum(power[: len(a) - w + 1], power[w - have : w - have + len(a) - w + 1])


#: Where the cells of a key are read from its bits.
_SHIFTS = (0, 13, 29)


def bounded_filter(keys: DataFrame, key: str, bits: int) -> bytes:
    """A Bloom filter of ``2 ** bits`` cells, 30 bits at most, of well mixed 64-bit keys, built by aggregation: whatever the number of keys, what reaches the
    driver has this size. A key sets four cells; one that is not among them finds its four set with a small chance, one that is always does."""
    cells = [F.expr(f"shiftrightunsigned({key}, {64 - bits})"), *[F.expr(f"shiftrightunsigned({key}, {s}) & {(1 << bits) - 1}L") for s in _SHIFTS]]
    cell = keys.select(F.explode(F.array(*cells)).alias("cell"))
    parts = cell.select(F.shiftright("cell", 15).alias("bucket"), F.col("cell").bitwiseAND(32767).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = bytearray(1 << (bits - 3))
    for p in parts.toLocalIterator():
        out[p.bucket * 4096 : p.bucket * 4096 + 4096] = p.bits
    return bytes(out)


def in_filter(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the unsigned keys the filter, an array of bytes, may hold."""
    out = np.ones(len(keys), dtype=bool)
    for cell in (keys >> np.uint64(64 - bits), *((keys >> np.uint64(s)) & np.uint64((1 << bits) - 1) for s in _SHIFTS)):
        out &= (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
