"""Linking articles to events by time window and named venue or place, refusing to guess where several match.

Terms become equi-join keys by their rarest word, so that no article meets every event. The date window is a condition on what joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.functions import text as T
from kelindan.session import keep


#: Length of the buckets of dates; any value gives the same result.
BUCKET_DAYS = 32


def event_terms(events: DataFrame) -> DataFrame:
    """(event_id, opens, closes, kind, term): where an event can be named, and when. ``events``: event_id, date_start, date_end, venues (array), place. Events
    without a date or a place are left out; venues need 8 normalised characters and must not be unspecified."""
    # Written once: both kinds of terms are read from it, and its expressions are long.
    keyed = events.select(
        "event_id",
        F.date_sub(T.first_day(F.col("date_start")), 1).alias("opens"),
        F.date_add(F.greatest(T.first_day(F.col("date_start")), T.final_day(F.coalesce(F.nullif("date_end", F.lit("")), "date_start"))), 30).alias("closes"),
        F.filter(F.transform("venues", lambda v: F.when(~F.lower(v).contains("spesifik"), F.trim(T.norm_padded(v)))), lambda v: F.length(v) >= 8).alias("venue"),
        F.transform(T.place_forms(T.place_name(F.col("place"))), lambda p: F.trim(p)).alias("place"),
    )
    keyed = keep(keyed, "event-names").where("opens is not null and closes is not null and size(place) > 0")
    as_terms = lambda kind: keyed.select("event_id", "opens", "closes", F.lit(kind).alias("kind"), F.explode(kind).alias("term"))
    return as_terms("venue").unionByName(as_terms("place")).distinct()


def _keys(words: Column) -> Column:
    """Words of an array and pairs of neighbours."""
    n = F.size(words)
    pairs = F.when(n > 1, F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>"))))


def anchors(terms: DataFrame) -> DataFrame:
    """(term, anchor): a term of one word or two is its own anchor; of a longer one it is the pair of neighbours that is in the fewest terms, as a first
    word may be in thousands."""
    each = terms.select("term").distinct().select("term", F.explode(_keys(F.split("term", " "))).alias("w"))
    own = each.where("w = term").select("term", F.col("w").alias("anchor"))
    pairs = each.where("instr(w, ' ') > 0").join(own.select("term"), "term", "left_anti")
    rare = pairs.groupBy("w").agg(F.count("*").alias("n"))
    return own.unionByName(pairs.join(rare, "w").groupBy("term").agg(F.min(F.struct("n", "w")).alias("m")).select("term", F.col("m.w").alias("anchor")))


def find_terms(texts: DataFrame, terms: DataFrame, doc: str, text: Column, anchored: DataFrame | None = None) -> DataFrame:
    """(doc, term) of the terms that stand in a text as whole words: texts' words and pairs of words meet the terms' anchors in an equi-join, which decides
    terms of up to two words. Longer ones that met are looked up in the text, which is joined back once per document. ``anchored``: the terms' anchors, where
    they are at hand."""
    padded = texts.select(doc, T.norm_padded(text).alias("__t"))
    keys = padded.select(doc, F.split(F.trim("__t"), " ").alias("__w")).select(doc, F.explode(_keys(F.col("__w"))).alias("anchor"))
    met = keep(keys.join(anchors(terms) if anchored is None else anchored, "anchor"), "met")
    short = met.where("anchor = term").select(doc, "term")
    long = met.where("anchor <> term").groupBy(doc).agg(F.collect_set("term").alias("__terms"))
    said = padded.join(long, doc).select(doc, F.explode(F.filter("__terms", lambda t: F.contains(F.col("__t"), F.concat(F.lit(" "), t, F.lit(" "))))).alias("term"))
    return short.unionByName(said).distinct()


def _within(found: DataFrame, articles: DataFrame, terms: DataFrame, doc: str, when: str) -> DataFrame:
    """(doc, event_id, kind): events of the terms found whose window holds the article's date; if any is named by its venue, only those."""
    # Dates are part of the key, in buckets about as long as a window: a place with many events meets an article only with those of its weeks.
    bucket = lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS)
    dated = articles.select(doc, when, bucket(F.col(when)).alias("bucket")).where(F.col(when).isNotNull())
    spread = terms.withColumn("bucket", F.explode(F.sequence(bucket(F.col("opens")), bucket(F.col("closes")))))
    hit = found.join(dated, doc).join(spread, ["term", "bucket"]).where(F.col(when).between(F.col("opens"), F.col("closes")))
    one = hit.groupBy(doc, "event_id").agg(F.max("kind").alias("kind"))
    best = one.groupBy(doc).agg(F.max("kind").alias("best"))
    return one.join(best, doc).where("kind = best").select(doc, "event_id", "kind")


def matches(articles: DataFrame, terms: DataFrame, doc: str, text: Column, when: str, anchored: DataFrame | None = None) -> DataFrame:
    """(doc, event_id, kind): events whose window holds the article's date and which its text names; if any is named by its venue, only those."""
    return _within(find_terms(articles.where(F.col(when).isNotNull()), terms, doc, text, anchored), articles, terms, doc, when)


def matches_twice(articles: DataFrame, terms: DataFrame, doc: str, lead: Column, body: Column, when: str) -> tuple[DataFrame, DataFrame]:
    """``matches`` of the lead and of the body. A body is searched only where its lead names no event, as it decides nothing elsewhere."""
    anchored = keep(anchors(terms), "anchors")
    strong = keep(matches(articles, terms, doc, lead, when, anchored), "strong")
    rest = articles.join(strong.select(doc).distinct(), doc, "left_anti")
    return strong, matches(rest, terms, doc, body, when, anchored)


def decide(articles: DataFrame, strong: DataFrame, weak: DataFrame, doc: str) -> DataFrame:
    """(doc, decision, tier, event_ids): one strong match links, several are ambiguous, else matches of the body are weak, else none."""
    of = lambda m, p: m.groupBy(doc).agg(F.sort_array(F.collect_set("event_id")).alias(p))
    j = articles.select(doc).distinct().join(of(strong, "s"), doc, "left").join(of(weak, "w"), doc, "left")
    return j.select(
        doc,
        F.when(F.size("s") == 1, "linked").when(F.size("s") > 1, "ambiguous").when(F.size("w") > 0, "weak").otherwise("none").alias("decision"),
        F.when(F.size("s") > 0, "headline_or_lead").when(F.size("w") > 0, "body_only").otherwise("").alias("tier"),
        F.array_join(F.coalesce("s", "w", F.array().cast("array<string>")), "|").alias("event_ids"),
    )


def audit(cited: DataFrame, strong: DataFrame, decisions: DataFrame, terms: DataFrame, found: DataFrame, dated: DataFrame, doc: str) -> DataFrame:
    """(doc, check) of articles that some row cites as a source of an event: agrees, ambiguous_includes_cited, place_not_named_in_lead, place_ok_date_unknown or
    place_ok_but_dates_or_other_event. ``cited``: (doc, event_id); ``strong``: matches of the lead; ``found``: terms in the lead whatever the date; ``dated``:
    (doc, when)."""
    named = found.join(terms.select("term", "event_id").distinct(), "term").join(cited, [doc, "event_id"]).select(doc).distinct().withColumn("named", F.lit(True))
    overlap = strong.join(cited, [doc, "event_id"]).select(doc).distinct().withColumn("overlap", F.lit(True))
    j = cited.select(doc).distinct().join(decisions.select(doc, "decision"), doc).join(dated, doc, "left").join(named, doc, "left").join(overlap, doc, "left")
    check = (
        F.when((F.col("decision") == "linked") & F.col("overlap"), "agrees")
        .when((F.col("decision") == "ambiguous") & F.col("overlap"), "ambiguous_includes_cited")
        .when(F.col("named").isNull(), "place_not_named_in_lead")
        .when(F.col("when").isNull(), "place_ok_date_unknown")
        .otherwise("place_ok_but_dates_or_other_event")
    )
    return j.select(doc, check.alias("check"))
