"""De-duplicated corpora: exact groups by hash, similar pairs by shared shingles, clusters, canonical records.

Similar pairs come from prefix filtering: shingles are ordered, those of many documents last, and two sets of similarity t or more must share l among the
first n - ceil(t n) + l of each, l being a part of the smaller set, so only those join. Nothing is lost, and frequent shingles, which make most pairs, hardly ever take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kelindan.functions import shingles as S
from kelindan.functions import text as T
from kelindan.session import keep


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the k-word sequences of an array of words, which should be a column of its own; fewer words are one sequence."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))
    return F.array_sort(F.array_distinct(F.when(F.size(words) >= k, each).otherwise(F.array(F.xxhash64(words)))))


def shingle_sets(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """(doc, s): the shingles of every normalised text that has a word, in one pass over the texts."""
    words = F.split(T.norm_words(F.col(text)), " ")
    return docs.where(F.col(text).isNotNull()).select(doc, T.bound(words, lambda w: F.when(w[0] != "", shingle_hashes(w, k))).alias("s")).where("s is not null")


def exact_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, group_size, group_id): texts equal after normalisation; the id is the least of the group. Null texts are left out; all empty ones
    are one group."""
    hashed = docs.where(F.col(text).isNotNull()).select(doc, F.sha2(T.norm_words(F.col(text)), 256).alias("text_hash")).distinct()
    groups = hashed.groupBy("text_hash").agg(F.count("*").alias("group_size"), F.min(doc).alias("group_id"))
    return hashed.join(groups, "text_hash").select(doc, "text_hash", "group_size", "group_id")


#: Shingles that stand this often in a piece of the texts are listed with their counts, as many of the most frequent as fit; any list gives the same pairs.
OFTEN, MOST_LISTED, PIECE = 3, 2_000_000, 4_000_000
#: Up to this many ids of documents are broadcast, more are joined by shuffling.
MOST_BROADCAST = 1_000_000
#: Entries of prefixes that one task holds, about, and pairs that it counts before it hands them on.
ENTRIES, PAIRS = 1_500_000, 2_000_000
#: Pairs must share so much of the smaller set in the prefixes, which are longer by as much.
SHARE = 0.05


def _normalised(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("d"), T.norm_words(F.col(text)).alias("t")).where("t <> ''")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _codes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(S.mix(hashes, 11), at[:-1]), np.bitwise_xor.reduceat(S.mix(hashes, 12), at[:-1])


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(n * threshold - 1e-9).astype(np.int64) + _least(n, threshold))


def _least(n: np.ndarray, threshold: float) -> np.ndarray:
    """What two prefixes share at least if the smaller set has n; no more than the threshold itself asks for."""
    return np.floor(n * (SHARE if threshold >= 4 * SHARE else 0)).astype(np.int64) + 1


def _surveyed(k: int, threshold: float, kind: pa.DataType):
    """Of each text its set's 128-bit hash, size and prefix; of each piece of the texts the shingles that stand in it often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(d, c1, c2, n, p, s, times):
            columns = [(d, kind), (c1, pa.int64()), (c2, pa.int64()), (n, pa.int64()), (p, pa.int64()), (s, pa.int64()), (times, pa.int64())]
            size = max(len(x) for x, _ in columns if x is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else x.cast(t) for x, t in columns], ["d", "c1", "c2", "n", "p", "s", "times"])

        def often():
            s, times = np.unique(np.concatenate(held), return_counts=True)
            return row(None, None, None, None, None, _i64(s[times >= OFTEN]), pa.array(times[times >= OFTEN]))

        held, size = [], 0
        for part in S.slices(batches):
            hashes, at = S.shingle_sets(part.column(1), k)
            n = np.diff(at)
            yield row(part.column(0), *map(_i64, _codes(hashes, at)), pa.array(n), pa.array(_prefix(n, threshold)), None, None)
            held.append(hashes)
            size += len(hashes)
            if size >= PIECE:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    return run


def _prefixes(k: int, threshold: float, listed, buckets: int):
    """(bucket, entries): 14 bytes an entry, 6 each of the shingle and of the set's hash, 2 of the size on a scale of logarithms. Prefixes are of the shingles that are not
    listed, by hash, then of the listed, the least frequent first."""

    def packed(s: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(s)
        s, c, n = s[order], c[order], n[order]
        out = np.empty((len(s), 14), np.uint8)
        out[:, :6], out[:, 6:12], out[:, 12:] = s.view(np.uint8).reshape(-1, 8)[:, 2:], c.view(np.uint8).reshape(-1, 8)[:, 2:], n.view(np.uint8).reshape(-1, 2)
        bucket = ((s >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(48)
        ids, first = np.unique(bucket, return_index=True)
        ends = [*first[1:], len(s)]
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array([out[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = listed.value
        held, size = [], 0
        for part in S.slices(batches):
            hashes, at = S.shingle_sets(part.column(1), k)
            n = np.diff(at)
            p = _prefix(n, threshold)
            times = np.zeros(len(hashes), np.int64)
            if len(known):
                near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                times = np.where(known[near] == hashes, rank[near], 0)
            taken = np.concatenate([a + np.argsort(times[a:b], kind="stable")[:m] for a, b, m in zip(at[:-1], at[1:], p)])
            scale = np.floor(np.log2(n) * 1000).astype(np.uint16)
            held.append((hashes[taken], np.repeat(_codes(hashes, at)[0], p), np.repeat(scale, p)))
            size += len(taken)
            if size >= ENTRIES // 2:
                yield packed(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    return run


def _met(threshold: float):
    """(a, b, times, least): how many entries two sets share in this task's buckets, and how many they must in all."""
    far = int(np.ceil(1000 * np.log2(1 / threshold))) + 1

    def counted(pairs: list) -> pa.RecordBatch:
        a, b, n = map(np.concatenate, zip(*pairs))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.nonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))[0]
        least = _least(np.ceil(2 ** (n[first] / 1000) - 1e-6), threshold)
        return pa.RecordBatch.from_arrays([_i64(a[first]), _i64(b[first]), pa.array(np.diff([*first, len(a)])), pa.array(least)], ["a", "b", "times", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(x for batch in batches for x in batch.column("entries").to_pylist()), np.uint8).reshape(-1, 14)
        s, c = np.zeros((2, len(raw), 8), np.uint8)
        s[:, :6], c[:, :6] = raw[:, :6], raw[:, 6:12]
        s, c, n = s.view(np.uint64).ravel(), c.view(np.uint64).ravel(), np.ascontiguousarray(raw[:, 12:]).view(np.uint16).ravel().astype(np.int64)
        order = np.lexsort((c, s))
        s, c, n = s[order], c[order], n[order]
        once = np.ones(len(s), bool)
        once[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        s, c, n = s[once], c[once], n[once]
        held, size = [], 0
        for low in range(0, len(s), PAIRS):
            i, step = np.arange(low, min(low + PAIRS, len(s))), 0
            while len(i):
                step += 1
                i = i[i + step < len(s)]
                i = i[s[i] == s[i + step]]
                near = i[np.abs(n[i] - n[i + step]) <= far]
                if len(near):
                    held.append((c[near], c[near + step], np.minimum(n[near], n[near + step])))
                    size += len(near)
                if size >= PAIRS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _packed_sets(k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.slices(batches):
            hashes, at = S.shingle_sets(part.column(1), k)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array(np.diff(at).astype(np.int32)), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["d", "n", "s"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("sa", "sb"))
        shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(shared, pa.int32())], ["a", "b", "na", "nb", "shared"])


def similar_classes(docs: DataFrame, threshold: float = 0.7, k: int = 5, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of classes, (a, b, shared, jaccard), each class named by its least document, whose shingle sets have at least the threshold's similarity; and members,
    (d, rep, n): every document that has a word, the least of its class, and the size of their one shingle set. An id with several texts has the shingles of all.

    The texts are gone through three times, the last time only those of likely pairs, as sets of hashes are larger than the texts. What moves is the prefixes, counts of
    what they share, and the sets of likely pairs."""
    spark = docs.sparkSession
    texts = _normalised(docs, doc, text)
    kind, arrow = texts.schema["d"].dataType.simpleString(), to_arrow_type(texts.schema["d"].dataType)
    surveyed = lambda: keep(texts.mapInArrow(_surveyed(k, threshold, arrow), f"d {kind}, c1 long, c2 long, n long, p long, s long, times long"), "survey")
    survey = surveyed()
    several = keep(survey.where("s is null").select("d", "c1", "c2", "n").distinct().groupBy("d").count().where("count > 1").select("d"), "several")
    if not several.isEmpty():
        few = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
        joined = texts.join(few, "d", "left_semi").groupBy("d").agg(F.array_join(F.array_sort(F.collect_set("t")), "\n").alias("t"))
        texts = texts.join(few, "d", "left_anti").unionByName(joined)
        survey = surveyed()
    own = survey.where("s is null").select("d", "c1", "c2", "n")
    first = own.groupBy("c1", "c2", "n").agg(F.min("d").alias("rep"))
    members = keep(own.join(first, ["c1", "c2", "n"]).select("d", "rep", "n", "c1", "c2").distinct(), "members")
    often = keep(survey.where("s is not null").groupBy("s").agg(F.sum("times").alias("times")), "often")
    room, least = MOST_LISTED, None
    for r in often.groupBy(F.least("times", F.lit(100_000)).alias("times")).agg(F.count("*").alias("n")).orderBy(F.desc("times")).collect():
        if r.n > room:
            break
        room, least = room - r.n, r.times
    chosen = often.where(F.col("times") >= least if least is not None else F.lit(False)).toArrow()
    known, rank = np.asarray(chosen.column("s")).astype(np.int64).view(np.uint64), np.asarray(chosen.column("times")).astype(np.int64)
    order = np.argsort(known)
    listed = spark.sparkContext.broadcast((known[order], rank[order]))
    entries = survey.agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries // ENTRIES))
    prefixes = texts.mapInArrow(_prefixes(k, threshold, listed, 8 * tasks), "bucket int, entries binary")
    met = prefixes.repartition(tasks, "bucket").mapInArrow(_met(threshold), "a long, b long, times long, least long")
    met = keep(met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("least").alias("least")).where("times >= least").select("a", "b"), "met")
    listed.unpersist()
    # A code of 48 bits may stand for several classes, which are all compared.
    classes = members.where("d = rep").select(F.shiftrightunsigned("c1", 16).alias("c"), "rep", "n").distinct()
    left, right = (classes.select(F.col("c").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    likely = met.join(left, "a").join(right, "b").where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")))
    likely = keep(likely.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "likely")
    needed = keep(likely.select(F.col("a").alias("d")).union(likely.select("b")).distinct(), "needed")
    few = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed
    sets = keep(texts.join(few, "d", "left_semi").mapInArrow(_packed_sets(k, arrow), f"d {kind}, n int, s binary").dropDuplicates(["d"]), "sets")
    sa, sb = (sets.select(F.col("d").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    scored = likely.join(sa, "a").join(sb, "b").mapInArrow(_shared, f"a {kind}, b {kind}, na int, nb int, shared int")
    scored = scored.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= threshold)
    return keep(scored.select("a", "b", "shared", "jaccard"), "scored"), members.select("d", "rep", "n")


def similar_pairs(docs: DataFrame, threshold: float = 0.7, k: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, shared, jaccard) of all pairs of documents, a < b, whose shingle sets have at least the threshold's similarity; repeated rows of one id count once, and its set is
    that of all its texts."""
    pairs, members = similar_classes(docs, threshold, k, doc, text)
    alike = members.groupBy("rep", "n").agg(F.count("*").alias("size")).where("size > 1")
    pairs = pairs.unionByName(alike.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").cast("int").alias("shared"), F.lit(1.0).alias("jaccard")))
    of_a, of_b = members.select(F.col("rep").alias("a"), F.col("d").alias("x")), members.select(F.col("rep").alias("b"), F.col("d").alias("y"))
    between = pairs.join(of_a, "a").join(of_b, "b").where("a <> b and x <> y or x < y")
    return between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "jaccard")


def similar_clusters(docs: DataFrame, threshold: float = 0.7, k: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``clusters`` of ``similar_pairs``, by way of classes: documents of one set are not paired with each other."""
    pairs, members = similar_classes(docs, threshold, k, doc, text)
    links = pairs.select("a", "b").union(members.where("d <> rep").select(F.col("rep").alias("a"), F.col("d").alias("b")))
    return clusters(docs, links, doc)


def clusters(nodes: DataFrame, pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, cluster_id): least document linked directly or indirectly. Labels spread along pairs and by pointer doubling, so rounds grow with the logarithm
    of a chain's length; each round is written to the shared folder."""
    edges = keep(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")), "edges")
    labels = keep(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        spread = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        better = labels.join(spread, "u").select("u", "label", F.least("label", "l").alias("next"))
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("far"))
        new = keep(better.join(jump, "next", "left").select("u", F.coalesce(F.least("next", "far"), "next").alias("label"), (F.coalesce(F.least("next", "far"), "next") < F.col("label")).alias("moved")), "labels")
        labels = new.select("u", "label")
        if new.where("moved").isEmpty():
            break
    named = labels.withColumnRenamed("u", doc)
    return nodes.select(doc).distinct().join(named, doc, "left").select(doc, F.coalesce("label", doc).alias("cluster_id"))


def canonical(records: DataFrame, cluster: str, doc: str, order: list) -> DataFrame:
    """Adds (is_canonical, cluster_size, duplicate_of): the first record of a cluster in the given order stands for it."""
    first = records.groupBy(cluster).agg(F.min(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col(doc).alias("id"))).alias("f"), F.count("*").alias("cluster_size"))
    joined = records.join(first, cluster)
    same = F.col(doc) == F.col("f.id")
    return joined.withColumn("is_canonical", same).withColumn("duplicate_of", F.when(~same, F.col("f.id"))).drop("f")


def upper_median(rows: DataFrame, value: str, block: int = 1024) -> DataFrame:
    """One row (upper_median): the value at position n div 2, from 0, of the whole numbers of a column; null for none. Counts per block of values say in which block that
    position lies, and only that block's values, of which there are ``block`` at most, are gone through in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("v") / block))
    blocks = counts.groupBy("b").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    at = blocks.withColumn("upto", F.sum("n").over(upto)).join(total).where("upto > total div 2").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "total")).alias("at")).select("at.*")
    inner = counts.join(at, "b").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return inner.where("upto > total div 2").agg(F.min("v").alias("upper_median"))
