"""Near-duplicate texts with small edits, by HyperMinHash.

A text is its set of five-word shingles. Its sketch has ``REGISTERS`` registers, each the least value of one hash permutation kept as
leading-zero count and mantissa bits (16 bits in all). Four registers make a band, whose key is their very bits; texts that share a band
are candidates. Their sketches give a Jaccard estimate corrected for chance collisions of registers, which drops what is far below the threshold;
the rest is verified on the full shingle sets. Texts of one shingle set are one class, of which only the first takes part.

At similarity s a pair is a candidate with chance 1 - (1 - s^4)^40, which is 0.99998 at 0.70 and 1 - 1e-10 at 0.80.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.llm.hashing import WordHashes, mixed, run_hashes
from kelindan.session import keep

BANDS, ROWS, MANTISSA = 40, 4, 10
REGISTERS = BANDS * ROWS
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_WORD = re.compile(r"\w+")
#: Ids of up to this number, of 20 bytes on average, are broadcast.
MOST_IDS = 1_000_000


def words_of(text: str) -> list[str]:
    """Lower case, NFKD without combining marks, split at what is no word character."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if not text.isascii():
            text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text)


def shingle_set(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word sequences; fewer words are one sequence; none for a text without a word."""
    h = hashes.of(words_of(text))
    return np.unique(run_hashes(h, min(k, len(h)))) if len(h) else h


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty shingle set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 4096):
        np.minimum(least, (_A * low[start : start + 4096] + _B).min(axis=1), out=least)
    zeros = 32 - np.frexp(least.astype(np.float64))[1].astype(np.uint32)
    zeros[least == 0] = 32
    after = (least.astype(np.uint64) << (zeros + np.uint32(1)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (after >> np.uint64(32 - MANTISSA))).astype(np.uint16)


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The expected share of registers that agree by chance, for disjoint sets of sizes n and m."""
    total = np.zeros(len(n))
    for z in range(33):
        hi, lo = 2.0 ** -z, (2.0 ** -(z + 1) if z < 32 else 0.0)
        width = (hi - lo) / (1 << MANTISSA)
        for part in range(0, 1 << MANTISSA, 128):
            # Within 1/8 of a level the chance of a cell hardly changes: one term stands for its 128 cells.
            at = lo + (part + 64) * width
            total += 128 * (n * width * (1 - at) ** np.maximum(n - 1, 0)) * (m * width * (1 - at) ** np.maximum(m - 1, 0))
    return np.minimum(total, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for chance collisions."""
    chance = chance_collisions(n.astype(float), m.astype(float))
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketches(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """(d, n, c1, c2, regs): number of shingles, a 128-bit hash of the shingle set, and the registers of every text with a word."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keep_rows, n, c1, c2, regs = [], [], [], [], []
                for i in range(part.num_rows):
                    s = shingle_set(part.column(1)[i].as_py(), k, hashes)
                    if len(s):
                        keep_rows.append(i)
                        n.append(len(s))
                        c1.append(int(mixed(s, 1).sum()))
                        c2.append(int(np.bitwise_xor.reduce(mixed(s, 2))))
                        regs.append(sketch(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep_rows, pa.int32())), pa.array(n, pa.int32()), _i64(np.array(c1, np.uint64)), _i64(np.array(c2, np.uint64)), pa.array(regs, pa.binary())],
                    ["d", "n", "c1", "c2", "regs"],
                )

    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"d {kind}, n int, c1 long, c2 long, regs binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.int64)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("n"), pa.ListArray.from_arrays(ends, pa.array(keys))], ["d", "n", "keys"])


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8, k: int = 5, slack: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Pairs between class representatives, (a, b, jaccard) with a < b, and membership, (d, rep): every text with a word and the least id of its class.

    Null ids and texts, and texts without a word, take no part. A repeated row is one text; several texts of one shingle set are one class, whose
    members are alike by 1. Texts that the ``slack`` below the threshold separates in the estimate (over five standard errors) are not verified. An empty table
    gives empty results; further columns are ignored.
    """
    sk = keep(sketches(docs, doc, text, k), "sketches")
    kind = sk.schema["d"].dataType.simpleString()
    first = sk.groupBy("c1", "c2").agg(F.min("d").alias("rep"))
    members = keep(sk.select("c1", "c2", "d").join(first, ["c1", "c2"]).select("d", "rep").distinct(), "members")
    reps = keep(sk.join(members.where("d = rep").select("d"), "d", "left_semi").dropDuplicates(["d"]).select("d", "n", "regs"), "reps")
    banded = reps.mapInArrow(_bands, f"d {kind}, n int, keys array<long>").select("d", "n", F.posexplode("keys").alias("band", "key"))
    x, y = banded.alias("x"), banded.alias("y")
    alike = (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.d") < F.col("y.d"))
    alike &= (F.col("x.n") >= threshold * F.col("y.n")) & (F.col("y.n") >= threshold * F.col("x.n"))
    pairs = x.join(y, alike).select(F.col("x.d").alias("a"), F.col("y.d").alias("b")).distinct()
    left = reps.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = reps.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    likely = keep(pairs.join(left, "a").join(right, "b").mapInArrow(_estimated(threshold - slack), f"a {kind}, b {kind}"), "likely")
    # Only texts of likely pairs are shingled again; their ids are broadcast up to a checked number and size of them.
    needed = keep(likely.select(F.col("a").alias("d")).union(likely.select("b")).distinct(), "needed")
    size = needed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("d").cast("string"))), F.lit(0)).alias("bytes")).first()
    few = F.broadcast(needed) if size.n <= MOST_IDS and size.bytes <= 20 * MOST_IDS else needed
    sets = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).join(few, "d", "left_semi").mapInArrow(_sets(k), f"d {kind}, s binary").dropDuplicates(["d"])
    sets = keep(sets, "sets")
    left, right = sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), sets.select(F.col("d").alias("b"), F.col("s").alias("sb"))
    verified = likely.join(left, "a").join(right, "b").mapInArrow(_verified(threshold), f"a {kind}, b {kind}, jaccard double")
    return keep(verified, "verified"), members


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                ok = estimate(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, k, hashes).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["d", "s"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(sa.as_buffer(), dtype=np.uint64), np.frombuffer(sb.as_buffer(), dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                j.append(shared / (len(both) - shared))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], ["a", "b", "jaccard"])
            yield out.filter(pa.array(np.asarray(j) >= threshold, pa.bool_()))

    return run


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: the pairs of all texts that ``pairs`` of representatives stand for, those within a class included."""
    sized = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    of_a, of_b = members.select(F.col("rep").alias("a"), F.col("d").alias("x")), members.select(F.col("rep").alias("b"), F.col("d").alias("y"))
    between = pairs.select("a", "b").unionByName(sized).join(of_a, "a").join(of_b, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return between.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
