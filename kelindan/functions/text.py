"""Text normalisers, sentences, shingles and names of places as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _accents() -> tuple[str, str]:
    """Letters with accents and their bases, by canonical decomposition (Latin to Greek Extended), then combining marks, which vanish."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) for c in range(0xC0, 0x2000)]
    one = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(a for a, _ in one) + "".join(marks), "".join(b for _, b in one)


def deaccent(c: Column) -> Column:
    """Without accents and combining marks; stays inside the JVM. Most texts have no such letter, which a regular expression tells much faster than ``translate`` goes
    through them; dashes and quotes, which many have, lie outside its range."""
    return F.when(c.rlike(r"[\u00c0-\u1fff]"), F.translate(c, *_accents())).otherwise(c)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often its lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def collapse(c: Column) -> Column:
    """White space, no-break space included, made one blank and trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def norm_words(c: Column) -> Column:
    """Corpus normaliser: lower case, no accents, everything but letters, digits and _ a blank, collapsed."""
    return F.trim(F.regexp_replace(deaccent(F.lower(c)), r"[^\p{L}\p{N}_]+", " "))


def norm_padded(c: Column) -> Column:
    """Linking normaliser: only a-z and 0-9, single blanks, padded at both ends so that ' x ' tests whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(deaccent(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " ")), F.lit(" "))


def norm_name(c: Column) -> Column:
    """Dimension key: lower case, blanks collapsed."""
    return F.lower(collapse(c))


def norm_region(c: Column) -> Column:
    """Region key: without the type word, a-z and 0-9 only."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*(?:kabupaten|kab\.?|kota)\s+", ""), "[^a-z0-9]", "")


def norm_key(c: Column, size: int = 120) -> Column:
    """Sentence key: a-z and 0-9 with single blanks, the first ``size`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), 1, size)


#: A sentence ends after . ! or ? before white space, unless a lone capital stands before the stop, and at newlines.
SENTENCE_END = r"(?<=[.!?])(?<!\b[A-Z]\.)\s+|\n+"


def sentences(c: Column) -> Column:
    """Sentences in order, without blank ones; null for null."""
    return F.filter(F.split(c, SENTENCE_END), lambda s: F.trim(s) != "")


#: A line that teases a video or points at a related story.
TEASER = r"(?i)\b(?:simak|lihat|saksikan)\s+(?:juga\s+)?video\b|^[^a-z0-9]*(?:baca|simak|lihat)\s+juga\b"


def drop_teasers(c: Column) -> Column:
    """A text without its lines of teasers; other lines, blank ones included, stay as they are."""
    return F.when(c.rlike(r"(?i)video|juga"), F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(TEASER)), "\n")).otherwise(c)


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct k-word sequences of an array of words, which should be a column of its own, not an expression; shorter texts are one
    sequence; no words give an empty array."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.when(F.size(words) > 0, F.array_distinct(many)).otherwise(F.array().cast("array<string>"))


def place_forms(name: Column) -> Column:
    """Written forms of a place: as it is and run together, padded, sorted."""
    base = F.trim(norm_padded(name))
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.array(pad(base), pad(F.replace(base, F.lit(" "), F.lit("")))))))


def place_type(name: Column) -> Column:
    """kabupaten or kota where the name begins with that word and goes on; else null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(name), r"^(?i)(kabupaten|kota) +\S", 1)), F.lit(""))


def place_name(name: Column) -> Column:
    """The name without its type word."""
    bare = F.regexp_replace(F.trim(name), r"^(?i)(?:kabupaten|kota) +(?=\S)", "")
    return F.when(place_type(name) == "kota", F.regexp_replace(bare, "^Administrasi ", "")).otherwise(bare)


def strip_tags(c: Column) -> Column:
    """Markup without tags and with the common entities resolved."""
    t = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapse(t)


def first_day(c: Column) -> Column:
    """Date of an ISO day, or the first of an ISO month; null for anything else."""
    return F.when(F.length(c) == 7, F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")).otherwise(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def final_day(c: Column) -> Column:
    """As ``first_day``, but a month stands for its last day."""
    return F.when(F.length(c) == 7, F.last_day(first_day(c))).otherwise(first_day(c))
