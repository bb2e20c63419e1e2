"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts up to a leaf's length are encoded where they lie. Longer ones are cut into leaves that are encoded in parallel, and neighbouring
results are joined pairwise up a tree. A join re-encodes a window around the cut that grows until both sides agree exactly: it reaches from
and to a place where a pre-token surely begins, and both encodings must have the ids of the window's halves there, so what lies outside
cannot change. Where no such place is near, as in one endless run of letters, the window grows to the whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = "/opt/tokenizers"
#: Fixed value: the split pattern of the tokenizer byte_bpe_50k.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space after a letter or digit always begins a pre-token, whatever comes before and after.
_SURE = regex.compile(r"(?<=[\p{L}\p{N}])\s")


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", path: str = DEFAULT_PATH) -> tiktoken.Encoding:
    """The tokenizer of the given name, without special tokens; read once per worker."""
    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Piece:
    """A stretch of text and its ids."""

    text: str
    ids: np.ndarray


def encode_piece(text: str, enc: tiktoken.Encoding) -> Piece:
    return Piece(text, np.asarray(enc.encode_ordinary(text), dtype=np.int32))


def join(left: Piece, right: Piece, enc: tiktoken.Encoding, window: int = 64) -> Piece:
    """The encoding of both texts together."""
    a, b = left.text, right.text
    while True:
        lo, hi = max(0, len(a) - window), min(len(b), window)
        begin = max((lo + m.start() for m in _SURE.finditer(a[lo:])), default=0 if lo == 0 else None)
        meet = next((m.start() for m in _SURE.finditer(b[:hi])), hi if hi == len(b) else None)
        if begin is not None and meet is not None:
            tail, head = encode_piece(a[begin:], enc).ids, encode_piece(b[:meet], enc).ids
            before = len(left.ids) - len(tail)
            if before >= 0 and np.array_equal(left.ids[before:], tail) and np.array_equal(right.ids[: len(head)], head):
                middle = encode_piece(a[begin:] + b[:meet], enc).ids
                return Piece(a + b, np.concatenate([left.ids[:before], middle, right.ids[len(head) :]]))
        if lo == 0 and hi == len(b):
            return encode_piece(a + b, enc)
        window *= 4


def join_all(pieces: list[Piece], enc: tiktoken.Encoding) -> Piece:
    """Neighbours joined pairwise, level by level."""
    while len(pieces) > 1:
        pieces = [join(*pieces[i : i + 2], enc) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def encode_texts(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", path: str = DEFAULT_PATH, leaf: int = 1 << 15
) -> DataFrame:
    """(doc, ids array<int>) of every row, without special tokens; an empty and a null text both give an empty list.

    Strings of special tokens are ordinary text. Texts longer than ``leaf`` characters are cut and joined, others encoded at once: the ids are the
    same. A repeated row gives repeated rows; further columns are ignored; null ids stay.
    """
    rows = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema[doc].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [np.asarray(enc.encode_ordinary(t), dtype=np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["d", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, path)
        for batch in batches:
            ids = [np.asarray(enc.encode_ordinary(t), dtype=np.int32) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "u", "k", "t")), _lists(ids)], ["d", "u", "k", "t", "ids"])

    def merge(table: pa.Table) -> pa.Table:
        enc = encoder(name, path)
        table = table.sort_by("k")
        k = np.asarray(table["k"])
        copies = int((k == 0).sum())
        one = table.take(pa.array(np.arange(0, len(k), copies)))
        whole = join_all([Piece(t, np.asarray(i, dtype=np.int32)) for t, i in zip(one["t"].to_pylist(), one["ids"].to_pylist())], enc)
        return pa.table({"d": table["d"].slice(0, copies), "ids": _lists([whole.ids] * copies)})

    few = rows.where(F.length("t") <= leaf).mapInArrow(short, f"d {kind}, ids array<int>")
    # Only long texts move: each is cut in the JVM, its leaves spread over all tasks, and one text's leaves, a single row's worth (and its copies'), meet
    # again by id and hash of the text, which stay the same when a lost task runs again.
    long = rows.where(F.length("t") > leaf).withColumn("u", F.xxhash64("t"))
    cuts = F.expr(f"transform(sequence(0, cast((length(t) - 1) div {leaf} as int)), k -> struct(k, substring(t, k * {leaf} + 1, {leaf}) as t))")
    cut = long.select("d", "u", F.inline(cuts)).select("d", "u", F.col("k").cast("int").alias("k"), "t")
    schema = f"d {kind}, u long, k int, t string, ids array<int>"
    joined = cut.repartition("d", "u", "k").mapInArrow(leaves, schema).groupBy("d", "u").applyInArrow(merge, f"d {kind}, ids array<int>")
    return few.unionByName(joined).select(F.col("d").alias(doc), "ids")
