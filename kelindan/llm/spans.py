"""Long exact spans shared between records, by repeated-phrase automata.

Every run of ``span`` words has one least phrase (by hash) among its runs of ``phrase`` words, the same wherever the run stands. The runs around one phrase, at most
``2 * span - phrase`` words unless the phrase repeats itself, are its neighbourhood; a text is cut into neighbourhoods, and only those of phrases that recur go
on. A neighbourhood goes to the shard of its phrase and to no other, so what is shipped does not depend on the number of shards. There the phrases that
stand in two records or more, compared as text, make an Aho-Corasick automaton over word numbers, through which the shard's neighbourhoods are streamed to
locate every occurrence. The runs of ``span`` words that hold a located phrase are told apart by 128 bits, and those that stand in two records are joined to stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelindan.llm.hashing import WordHashes, bounded_filter, in_filter, run_hashes, run_minima
from kelindan.session import keep

_BLANKS = re.compile("[ \\t\\n\\u00a0]+")


def span_words(text: str) -> list[str]:
    """Words split at runs of blank, tab, newline and U+00A0."""
    return [w for w in _BLANKS.split(text) if w]


def _least_phrases(h: np.ndarray, span: int, phrase: int) -> np.ndarray:
    """The hash of the least phrase of every run of ``span`` words."""
    return run_minima(run_hashes(h, phrase), span - phrase + 1) if len(h) >= span else np.zeros(0, dtype=np.uint64)


def shared_spans(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = 50, phrase: int = 26, bits: int | None = None, phrases_per_shard: int = 5_000, bytes_per_task: int = 1 << 25
) -> DataFrame:
    """(doc, start_word, end_word): the maximal stretches of words, end exclusive, that lie in ``span`` consecutive words which also stand, in a row, in
    another record.

    Words are compared as they are. Null ids and texts and texts shorter than ``span`` words give no rows; a run that one record repeats is not shared by
    that; repeated rows of one id are one record; an empty table gives an empty result; further columns are ignored. ``bits`` sizes the filter between the
    passes, by default 16 to 32 cells a recurring phrase and 64 MB at most: too few let more text into the later passes, and change nothing else. A shard of more than
    ``bytes_per_task`` of text, as a phrase in a third of all records makes one, is cut into tasks that each have all its phrases.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).alias("t"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [np.unique(_least_phrases(hashes.of(span_words(t.as_py())), span, phrase)) for t in part.column(1)]
                of = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.concatenate(found).view(np.int64))], ["d", "p"])

    recurring = rows.mapInArrow(phrases, f"d {kind}, p long").groupBy("p").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y")
    recurring = keep(recurring.select("p"), "recurring")
    if bits is None:
        bits = max(20, min(29, (16 * recurring.count()).bit_length()))
    bitmap = rows.sparkSession.sparkContext.broadcast(bounded_filter(recurring, "p", bits))

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                of, at, off, said, keys = [], [], [], [], []
                for i in range(part.num_rows):
                    words = span_words(part.column(1)[i].as_py())
                    h = run_hashes(hashes.of(words), phrase)
                    least = run_minima(h, span - phrase + 1)
                    runs = np.nonzero(in_filter(cells, least, bits))[0]
                    if not len(runs):
                        continue
                    new = np.r_[True, (np.diff(runs) > 1) | (np.diff(least[runs].view(np.int64)) != 0)]
                    begins, ends = runs[new], runs[np.r_[new[1:], True]] + span
                    for s, e, p in zip(begins.tolist(), ends.tolist(), least[begins]):
                        of.append(i)
                        at.append(s)
                        off.append(int(np.argmax(h[s : s + span - phrase + 1] == p)))
                        said.append(" ".join(words[s:e]))
                    keys.append(least[begins])
                key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                columns = [part.column(0).take(pa.array(of, pa.int32())), pa.array(at, pa.int32()), pa.array(off, pa.int32()), pa.array(said, pa.string()), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["d", "at", "off", "said", "p"])

    near = keep(rows.mapInArrow(neighbourhoods, f"d {kind}, at int, off int, said string, p long"), "neighbourhoods")
    worded = near.select("d", "p", F.array_join(F.slice(F.split("said", " "), F.col("off") + 1, phrase), " ").alias("said"))
    confirmed = worded.groupBy("p", "said").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y")
    confirmed = keep(confirmed.select("p", "said"), "phrases")
    shards = max(1, -(-confirmed.count() // phrases_per_shard))
    shard = F.pmod("p", F.lit(shards)).alias("shard")
    sized = near.groupBy(shard).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("said")) / bytes_per_task)).cast("int").alias("cuts"))
    sized = keep(sized, "shards")
    cut = F.pmod(F.xxhash64("d", "at"), F.col("cuts")).cast("int").alias("cut")
    routed = near.select("d", "at", "said", shard).join(sized, "shard").select("d", "at", "said", "shard", "cuts", cut)
    patterns = confirmed.select("said", shard).join(sized, "shard").select("said", "shard", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    found = patterns.groupBy("shard", "cut").cogroup(routed.groupBy("shard", "cut")).applyInArrow(_locator(span, phrase), f"d {kind}, s int, e int, h1 long, h2 long")
    found = keep(found, "runs")
    undecided = found.where("h1 is not null")
    shared = undecided.groupBy("h1", "h2").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y").select("h1", "h2")
    late = undecided.where("s >= 0").join(shared, ["h1", "h2"], "left_semi")
    pieces = found.where("h1 is null").select("d", "s", "e").unionByName(late.select("d", "s", "e"))
    order = Window.partitionBy("d").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", F.coalesce(F.col("s") > reached, F.lit(True)).cast("int"))
    pieces = pieces.withColumn("stretch", F.sum("new").over(order))
    return pieces.groupBy("d", "stretch").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select(F.col("d").alias(doc), "start_word", "end_word")


def _locator(span: int, phrase: int):
    """Of one task of a shard: (d, s, e) of the words of runs that stand in two of its records; if the shard has more tasks, also (d, s, e, h1, h2) of the runs that stand
    in one of its records, and of the others two records as witnesses, without a place (s is -1)."""

    def locate(patterns: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.array([], pa.int32())
        if not len(patterns) or not len(rows):
            return pa.table({"d": rows["d"].take(none), "s": none, "e": none, "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())})
        numbers: dict[str, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in patterns["said"].to_pylist():
            automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in p.split(" ")))
        automaton.make_automaton()
        one, two = WordHashes(1), WordHashes(2)
        found = [_located(rows["said"].slice(k, 2000).to_pylist(), k, automaton, numbers, one, two, span, phrase) for k in range(0, len(rows), 2000)]
        of, at, h1, h2 = (np.concatenate(x) for x in zip(*found))
        at = at + rows["at"].to_numpy()[of]
        record = rows["d"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[of]
        # Runs of the same words side by side; a group is shared if its records are not all one.
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        head = np.nonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[0] if len(order) else np.zeros(0, np.int64)
        low, high = (f.reduceat(record[order], head) if len(head) else head for f in (np.minimum, np.maximum))
        group = np.zeros(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
        sure = (low != high)[group]
        # Adjoining runs of one neighbourhood are one piece.
        k = np.nonzero(sure)[0]
        new = np.r_[True, (np.diff(of[k]) != 0) | (np.diff(at[k]) > span)] if len(k) else np.zeros(0, bool)
        first, last = k[new], k[np.r_[new[1:], True]] if len(k) else k
        out = [(of[first], at[first], at[last] + span, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.ones(len(first), bool))]
        if rows["cuts"][0].as_py() > 1:
            u = np.nonzero(~sure)[0]
            out.append((of[u], at[u], at[u] + span, h1[u].view(np.int64), h2[u].view(np.int64), np.zeros(len(u), bool)))
            for end in (low, high):
                shared = np.nonzero(low != high)[0]
                # Any run of the record will do as its witness.
                member = np.zeros(int(record.max(initial=0)) + 1, np.int64)
                member[record] = of
                w = member[end[shared]]
                out.append((w, np.full(len(w), -1), np.full(len(w), -1), a[head[shared]].view(np.int64), b[head[shared]].view(np.int64), np.zeros(len(w), bool)))
        of, s, e, h1, h2, blank = (np.concatenate(x) for x in zip(*out))
        return pa.table(
            {"d": rows["d"].take(pa.array(of)), "s": pa.array(s.astype(np.int32)), "e": pa.array(e.astype(np.int32)), "h1": pa.array(h1, mask=blank), "h2": pa.array(h2, mask=blank)}
        )

    return locate


def _located(said: list[str], base: int, automaton, numbers: dict[str, int], one: WordHashes, two: WordHashes, span: int, phrase: int) -> tuple[np.ndarray, ...]:
    """(row, run's first word in it, 64 bits, 64 more bits) of the runs that hold a phrase of the automaton, over many rows at once: a word that is in no phrase ends each."""
    words = [[*s.split(" "), ""] for s in said]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    located = np.zeros(len(flat) + 1, np.int64)
    for end, _ in automaton.iter(tuple(map(numbers.get, flat, [0] * len(flat)))):
        located[end + 2 - phrase] = 1
    before = np.cumsum(located)
    starts = np.cumsum(lengths) - lengths
    runs = np.maximum(0, lengths - span)
    of = np.repeat(np.arange(len(words)), runs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    place = starts[of] + at
    # Phrases that begin within the run and end in it.
    held = before[place + span - phrase + 1] > before[place]
    of, at, place = of[held], at[held], place[held]
    return of + base, at, run_hashes(one.of(flat), span)[place], run_hashes(two.of(flat), span)[place]
