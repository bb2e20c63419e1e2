"""Lines repeated across one site's documents.

First pass: a summary of each source, which counts its lines by fingerprint; every task builds its own, and they merge by addition, as partial and final aggregates. A
summary counts documents that hold a line, a repeated row more than once, so it never counts too few. Second pass: exact counts of distinct documents, by
128 bits, of the lines that are frequent in their source's summary, the only ones that shuffle again. The confirmed lines are a small set, which goes to every
task where its checked size allows, both to name the lines (``repeated_lines``) and to take them out of the texts (``remove_house_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.session import keep

#: Sets of up to this many rows of two or three numbers, about 64 MB in a task's memory, are broadcast; larger ones are joined by shuffling.
MOST_BROADCAST = 1_000_000


def line_keys(text: Column) -> Column:
    """The lines of a text in lower case, runs of blank, tab and U+00A0 made one blank, trimmed. Blank and case are mended in the whole text at once."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), "[ \\t\\u00a0]+", " "), "\n"), lambda x: F.trim(x))


def _prints(source: Column, line: Column) -> tuple[Column, Column]:
    """Two fingerprints of a line within its source."""
    return F.xxhash64(source, line).alias("h1"), F.xxhash64(F.lit(7), line, source).alias("h2")


def _sent(rows: DataFrame) -> DataFrame:
    """A set, marked for broadcast if it is small."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows


def _usable(docs: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    return docs.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(source).cast("string").alias("src"), line_keys(F.col(text)).alias("lines"))


def _frequent(docs: DataFrame, doc: str, source: str, text: str, least: int) -> DataFrame:
    """(d, src, line_no, h1, h2): where the lines of at least ``least`` documents of their source stand."""
    texts = _usable(docs, doc, source, text)
    # A text's lines are made distinct where they lie, so what is counted is texts.
    once = texts.select("src", F.explode(F.array_distinct("lines")).alias("line")).where("line <> ''").select(F.xxhash64("src", "line").alias("h1"))
    summary = keep(once.groupBy("h1").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1"), "frequent")
    lines = texts.select("d", "src", F.posexplode("lines").alias("line_no", "line")).where("line <> ''").select("d", "src", "line_no", *_prints(F.col("src"), F.col("line")))
    frequent = keep(lines.join(_sent(summary), "h1", "left_semi"), "candidate-lines")
    # A document counts once per line: the pairs are made distinct before they are counted, so a hot line is spread over its documents.
    counted = frequent.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1", "h2")
    return frequent.join(_sent(keep(counted, "confirmed-lines")), ["h1", "h2"], "left_semi")


def repeated_lines(docs: DataFrame, doc: str = "doc_id", source: str = "domain", text: str = "text", least: int = 5) -> DataFrame:
    """(doc, line_no) of every line that stands in at least ``least`` distinct documents of its source.

    Lines are numbered from 0 at every newline. Null texts and sources give no rows, nor do blank lines; a line that one document repeats
    counts once for it; repeated rows change nothing. Lines are told apart by a 128-bit hash of source and text.
    """
    return _frequent(docs, doc, source, text, least).select(F.col("d").alias(doc), "line_no").distinct()


def remove_house_lines(docs: DataFrame, doc: str = "doc_id", source: str = "domain", text: str = "text", least: int = 5) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` names; other lines stay as they are, as do null texts and texts without a source. Each text meets the set of its source,
    by broadcast, so texts don't move; sets beyond the bound take the lines out by document."""
    found = keep(_frequent(docs, doc, source, text, least), "house-lines")
    lines = keep(found.select("src", "h1", "h2").distinct(), "house-sets")
    if lines.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return drop_lines(docs, found.select(F.col("d").alias(doc), "line_no").distinct(), doc, text)
    sets = lines.groupBy(F.col("src").alias("__src")).agg(F.collect_set(F.struct("h1", "h2")).alias("__set"))
    joined = docs.join(F.broadcast(sets), F.col(source).cast("string") == F.col("__src"), "left")
    pairs = F.arrays_zip(F.split(F.col(text), "\n").alias("raw"), line_keys(F.col(text)).alias("key"))
    kept = F.filter(pairs, lambda p: ~F.array_contains(F.col("__set"), F.struct(*_prints(F.col("__src"), p["key"]))) | (p["key"] == ""))
    new = F.when(F.col("__set").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda p: p["raw"]), "\n"))
    return joined.withColumn(text, new).drop("__src", "__set")


def drop_lines(docs: DataFrame, lines: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the given (doc, line_no) taken out of ``text``; texts without such lines stay as they are, null stays null."""
    gone = lines.groupBy(doc).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("__gone"), s["i"]))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return docs.join(gone, doc, "left").withColumn(text, new).drop("__gone")
