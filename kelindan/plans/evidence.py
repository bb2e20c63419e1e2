"""Queries that link articles to events and code what they say, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelindan.functions import cells
from kelindan.functions import lexicon as X
from kelindan.functions import text as T
from kelindan.operators import incidents as I
from kelindan.operators import linking as K
from kelindan.plans import evidence_sql as Q
from kelindan.session import keep, spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "title", "text", "source", "lang", "publish_date", "domain")
    return spread(docs)  # doc_id is unique


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return K.event_terms(_events(spark, d).withColumn("place", F.col("kabkota")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with what links and reports need of them."""
    rows = table(spark, d, "incidents").dropDuplicates(["incident_id"])
    first = lambda c: F.min_by(c, F.struct("table_row", "incident_id"))
    return rows.groupBy("event_id").agg(
        F.min("date_iso").alias("date_start"),
        F.max("date_end_iso").alias("date_end"),
        F.collect_set(I.named_venue(F.col("venue_raw"))).alias("venues"),
        first("kabkota").alias("kabkota"),
        first("symptomatic").alias("symptomatic"),
        first(F.map_values("symptomatic_by_subject")).alias("parts"),
    )


def containment_link(spark: SparkSession, d: str) -> DataFrame:
    """Names and other names of the master list that stand in a text as whole words."""
    codes = table(spark, d, "kabkota_codes")
    listed = codes.select(T.place_name(F.col("nama")).alias("n")).union(codes.select(F.explode(F.split("nama_lain", ";"))))
    names = listed.select(F.trim(T.norm_padded(F.col("n"))).alias("term")).where("term <> ''").distinct()
    found = K.find_terms(_docs(spark, d), names, "doc_id", F.col("text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_set("term")), "|")).alias("digest"))


def link_tiers(spark: SparkSession, d: str) -> DataFrame:
    docs, terms = _docs(spark, d).withColumn("day", T.first_day(F.col("publish_date"))), keep(_terms(spark, d), "terms")
    lead = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 500))
    strong, weak = K.matches_twice(docs, terms, "doc_id", lead, F.col("text"), "day")
    return K.decide(docs, strong, weak, "doc_id")


def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Does the headline of a read source name the event that a row cites it for?"""
    inc = table(spark, d, "incidents").dropDuplicates(["incident_id"])
    cited = inc.select("event_id", F.explode("source_urls").alias("url")).distinct()
    read = table(spark, d, "fetch_ledger").where("title <> ''").groupBy("url").agg(F.max_by(F.struct("title", "publish_date"), F.struct("fetched_at", "entry_id")).alias("a"))
    docs = read.join(cited, "url", "left_semi").select("url", F.col("a.title").alias("title"), T.first_day(F.col("a.publish_date")).alias("when"))
    docs, terms = keep(docs, "sources"), keep(_terms(spark, d), "terms")
    cited = cited.join(docs.select("url"), "url")
    strong = K.matches(docs, terms, "url", F.col("title"), "when")
    decisions = K.decide(docs, strong, strong.limit(0), "url")
    return K.audit(cited, strong, decisions, terms, K.find_terms(docs, terms, "url", F.col("title")), docs.select("url", "when"), "url")


def label_frame(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the strata of a frame for labelling: sentences of 41 to 399 characters, by domain."""
    s = _docs(spark, d).where("domain is not null").select("domain", F.explode(T.sentences(F.col("text"))).alias("said")).where(F.length("said").between(41, 399))
    return s.select("domain", X.stratum(F.col("said")).alias("stratum")).where("stratum is not null").groupBy("domain", "stratum").agg(F.count("*").alias("n"))


def dates_in_text(spark: SparkSession, d: str) -> DataFrame:
    f = _docs(spark, d).select("doc_id", cells.find_dates(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").cast("long").alias("n"), F.coalesce(F.try_element_at("f", F.lit(1)), F.lit("")).alias("first_date"), F.md5(F.array_join("f", "|")).alias("digest"))


def interval_link(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of an order were shipped from a day before to 30 days after it."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("ship"))
    n = o.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("ship").between(F.date_sub("day", 1), F.date_add("day", 30)), "left").groupBy("o_orderkey").agg(F.count("ship").alias("n"))
    return n.groupBy(F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("decision")).agg(F.count("*").alias("orders"))


def lexicon_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Certainty and all indicators of every text."""
    s = _docs(spark, d).select("doc_id", "title", "text", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", X.certainty(F.col("text"), F.col("s")).alias("certainty"), *X.coded(F.col("title"), F.col("text"), F.col("s")))


def suspected_foods(spark: SparkSession, d: str) -> DataFrame:
    """Foods named in the same sentence as a word of suspicion."""
    s = _docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(X.suspected(F.col("s"), f), F.lit(f)) for f in X.FOODS])), "|").alias("foods"))


def certainty_ladder(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", X.certainty(F.col("text"), F.col("s")).alias("certainty"))


def flagged_sentences(spark: SparkSession, d: str) -> DataFrame:
    """How many sentences of a text a rule on results flags."""
    s = _docs(spark, d).select("doc_id", F.filter(T.sentences(F.col("text")), X.flagged).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("flagged"))


def headline_causes(spark: SparkSession, d: str) -> DataFrame:
    """Does a headline report a cause, rather than ask for one?"""
    return _docs(spark, d).select("doc_id", F.coalesce(X.headline_cause(F.col("title")), F.lit(False)).alias("cause"))


def without_teasers(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the lines that tease a video or a related story, which bring in other stories' headlines."""
    clean = _docs(spark, d).select("doc_id", "text", T.drop_teasers(F.col("text")).alias("t")).where("t <> text")
    return clean.select("doc_id", (F.length("text") - F.length("t")).cast("long").alias("cut"), F.md5("t").alias("digest"))


def _findings_of(docs: DataFrame) -> DataFrame:
    """First sentence of each kind per article: kinds of a sentence are stacked, the least position per (article, kind) is an aggregate."""
    rows = docs.select("doc_id", "text", T.sentences(F.col("text")).alias("s")).select("doc_id", "text", "s", F.posexplode("s").alias("i", "said"))
    c = F.col("said")
    state = F.when(X.states_finding(c), "contamination").when(X.states_clean(c), "clean").when(X.says(c, X.AWAITING), "awaiting")
    kinds = F.array_compact(F.array(state, F.when(X.has(c, X.RESPONSES["halted"]), "halted"), *[F.when(X.has(c, X.MECHANISMS[m]), F.lit(m)) for m in ("spoilage", "storage", "hygiene")]))
    before = F.when(F.col("i") > 0, F.try_element_at("s", F.col("i")))
    each = rows.select("doc_id", "i", "said", before.alias("before_"), F.expr("locate(substring(said, 1, 80), text) - 1").alias("at"), F.explode(kinds).alias("kind"))
    return each.groupBy("doc_id", "kind").agg(F.min(F.struct("i", "said", "before_", "at")).alias("f")).select("doc_id", "kind", "f.i", "f.said", "f.before_", "f.at")


def first_finding(spark: SparkSession, d: str) -> DataFrame:
    f = _findings_of(_docs(spark, d))
    return f.select("doc_id", "kind", F.col("i").cast("long").alias("i"), F.col("at").cast("long").alias("char_start"), F.md5(F.substring("said", 1, 400)).alias("digest"))


def _spoken(f: DataFrame) -> DataFrame:
    """Findings with the bodies named in their sentence or the one before, and the agents named in the sentence."""
    context = F.concat(F.coalesce("before_", F.lit("")), F.lit(" "), F.col("said"))
    return f.select("doc_id", "kind", X.named(context, X.SPEAKERS).alias("who"), X.named(F.col("said"), X.AGENTS).alias("agents"))


def attribution_prev(spark: SparkSession, d: str) -> DataFrame:
    """Who is named in the sentence of a finding or the one before it."""
    f = _spoken(_findings_of(_docs(spark, d)))
    return f.select("doc_id", "kind", F.array_join("who", "|").alias("attributed_to"), F.array_join("agents", "|").alias("agents"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, event_id) of the articles that link to one event by headline or lead."""
    return keep(link_tiers(spark, d).where("decision = 'linked'").select("doc_id", F.col("event_ids").alias("event_id")), "linked")


def best_state(spark: SparkSession, d: str) -> DataFrame:
    """Best state of the articles linked to an event, by rank; events without one have no article read."""
    linked = _linked(spark, d)
    read = _docs(spark, d).join(linked, "doc_id").select("event_id", "text", T.sentences(F.col("text")).alias("s"))
    rank = F.create_map(*[F.lit(x) for kv in X.CERTAINTY.items() for x in kv])
    ranked = read.select("event_id", X.certainty(F.col("text"), F.col("s")).alias("state")).withColumn("rank", rank[F.col("state")])
    best = ranked.groupBy("event_id").agg(F.max(F.struct("rank", "state")).alias("b"), F.count("*").alias("articles"))
    j = _events(spark, d).select("event_id").join(best, "event_id", "left")
    return j.select("event_id", F.coalesce("b.state", F.lit("no article read")).alias("state"), F.coalesce("articles", F.lit(0)).alias("articles"))


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per event: articles that cite it and that link to it, best state, first day of a cause found and its lag, agents, and who says so."""
    linked = _linked(spark, d)
    docs = _docs(spark, d).join(linked, "doc_id").withColumn("day", T.first_day(F.col("publish_date")))
    rank = F.create_map(*[F.lit(x) for kv in X.CERTAINTY.items() for x in kv])
    coded = docs.select("event_id", "day", "text", T.sentences(F.col("text")).alias("s")).select("event_id", "day", X.certainty(F.col("text"), F.col("s")).alias("state"))
    states = coded.withColumn("rank", rank[F.col("state")]).groupBy("event_id").agg(
        F.count("*").alias("n"), F.max(F.struct("rank", "state")).alias("b"), F.min(F.when(F.col("rank") >= 3, F.col("day"))).alias("resolved")
    )
    said = _spoken(_findings_of(docs).where("kind in ('contamination', 'clean')")).join(linked, "doc_id")
    said = said.groupBy("event_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == "contamination", F.col("agents")))))).alias("agents"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("who")))).alias("who"),
    )
    cited = cited_events(spark, d).groupBy("event_id").agg(F.count("*").alias("cited"))
    j = _events(spark, d).select("event_id", "date_start", "kabkota").join(states, "event_id", "left").join(said, "event_id", "left").join(cited, "event_id", "left")
    by = F.when(F.col("who").isNull(), "").when(F.array_contains("who", "health_body"), "health_body").when(F.size("who") > 0, "other_official_only").otherwise("unattributed")
    return j.select(
        "event_id", "date_start", "kabkota", F.coalesce("cited", F.lit(0)).alias("cited_articles"), F.coalesce("n", F.lit(0)).alias("linked_articles"), F.coalesce("b.state", F.lit("no article read")).alias("state"),
        F.col("resolved").cast("string").alias("first_finding_date"), F.datediff("resolved", T.first_day(F.col("date_start"))).cast("long").alias("lag_days"),
        F.coalesce(F.array_join("agents", "|"), F.lit("")).alias("agents"), by.alias("attributed_to"), F.coalesce(F.array_join("who", "|"), F.lit("")).alias("classes"),
    )


def evidence_headline(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run: decisions, states and attributions of events, and the median lag of those with a finding."""
    decided = link_tiers(spark, d).groupBy(F.concat(F.lit("decision "), "decision").alias("name")).agg(F.count("*").cast("double").alias("value"))
    e = keep(event_summary(spark, d), "summary")
    states = e.groupBy(F.concat(F.lit("events "), "state").alias("name")).agg(F.count("*").cast("double").alias("value"))
    told = e.where("state in ('contamination', 'clean')").groupBy(F.concat(F.lit("resolved by "), "attributed_to").alias("name")).agg(F.count("*").cast("double").alias("value"))
    lag = e.agg(F.percentile("lag_days", 0.5).alias("value")).select(F.lit("median lag").alias("name"), "value")
    return decided.unionByName(states).unionByName(told).unionByName(lag)


def cited_events(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, event_id): events that a record of the corpus is cited for, through its incidents; an unknown incident fails the job."""
    cited = table(spark, d, "corpus").select("doc_id", F.explode("incident_ids").alias("incident_id")).distinct()
    rows = table(spark, d, "incidents").select("incident_id", "event_id").distinct()
    known = F.when(F.col("event_id").isNull(), F.raise_error(F.concat(F.lit("unknown incident "), "incident_id"))).otherwise(F.col("event_id"))
    return cited.join(rows, "incident_id", "left").select("doc_id", known.alias("event_id")).distinct()


def doc_events(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the corpus with its events, and of those with just one, place and date."""
    of = cited_events(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))
    one = of.where(F.size("ids") == 1).select("doc_id", F.col("ids")[0].alias("event_id")).join(_events(spark, d).select("event_id", "date_start", "kabkota"), "event_id").drop("event_id")
    docs = table(spark, d, "corpus").select("doc_id").distinct()
    return docs.join(of, "doc_id", "left").join(one, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("ids", "|"), F.lit("")).alias("event_ids"), "date_start", "kabkota")


def url_incidents(spark: SparkSession, d: str) -> DataFrame:
    """URLs that were read with the incidents that cite them, in order."""
    cited = table(spark, d, "incidents").select("incident_id", F.explode("source_urls").alias("url")).groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("incident_id")), "|").alias("incidents"))
    return table(spark, d, "fetch_ledger").where("status = 'ok'").select("url").distinct().join(cited, "url", "left").select("url", F.coalesce("incidents", F.lit("")).alias("incidents"))


def feed_only(spark: SparkSession, d: str) -> DataFrame:
    """Domains all of whose articles come from feeds."""
    docs = _docs(spark, d).where("domain is not null and source is not null").groupBy("domain").agg(F.collect_set("source").alias("s"))
    return docs.where(F.forall("s", lambda x: x.startswith("tag_feed"))).select("domain")


def count_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of people in an article against the table's figure for the one event that it links to, or the figure of one group in it."""
    n, figure = F.col("n"), F.col("symptomatic")
    ev = _linked(spark, d).join(_events(spark, d).where("symptomatic is not null").select("event_id", "symptomatic", "parts"), "event_id")
    rows = _docs(spark, d).join(ev, "doc_id").select("doc_id", "event_id", "symptomatic", "parts", cells.prose_counts(F.concat_ws("\n", F.coalesce("title", F.lit("")), "text")).alias("n"))
    return rows.select(
        "doc_id", "event_id", figure.cast("long").alias("figure"), F.size(n).cast("long").alias("numbers"), F.array_max(n).cast("long").alias("largest"), cells.agreement(n, figure, F.col("parts")).alias("verdict"),
        F.round(F.try_divide(F.array_max(n), figure), 2).alias("ratio"),
    )


def source_rank(spark: SparkSession, d: str) -> DataFrame:
    """Targets by rank of source, newest first, undated last; the id breaks ties."""
    rank = F.when(F.col("source") == "cited", 0).when(F.col("source") == "tag_feed", 1).otherwise(2)
    w = Window.partitionBy("domain").orderBy(rank, F.col("publish_date").desc_nulls_last(), "doc_id")
    return _docs(spark, d).where("domain is not null").select("doc_id", "domain", F.row_number().over(w).cast("long").alias("turn")).where("turn <= 3")


QUERIES = {
    "containment_link": containment_link,
    "link_tiers": link_tiers,
    "interval_link": interval_link,
    "citation_audit": citation_audit,
    "label_frame": label_frame,
    "dates_in_text": dates_in_text,
    "lexicon_indicators": lexicon_indicators,
    "suspected_foods": suspected_foods,
    "certainty_ladder": certainty_ladder,
    "flagged_sentences": flagged_sentences,
    "headline_causes": headline_causes,
    "without_teasers": without_teasers,
    "first_finding": first_finding,
    "attribution_prev": attribution_prev,
    "best_state": best_state,
    "event_summary": event_summary,
    "evidence_headline": evidence_headline,
    "doc_events": doc_events,
    "url_incidents": url_incidents,
    "feed_only": feed_only,
    "count_agreement": count_agreement,
    "source_rank": source_rank,
}

_D = "d AS (SELECT DISTINCT doc_id, title, text, source, lang, publish_date, domain FROM documents WHERE text IS NOT NULL)"
_S = r"""m AS (SELECT *, regexp_replace(regexp_replace(text, '\b([A-Z])\.', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g') AS t FROM d),
    c AS (SELECT doc_id, title, text, source, publish_date, domain, list_filter(list_transform(regexp_split_to_array(t, chr(2) || '|\n+'), lambda x: replace(x, chr(1), '.')), lambda x: trim(x) <> '') AS s FROM m)"""
_KINDS = f"""{_D}, {_S}, e AS (SELECT doc_id, text, s, generate_subscripts(s, 1) AS k, unnest(s) AS x FROM c),
    f AS (SELECT doc_id, text, k, x, CASE WHEN k > 1 THEN s[k - 1] END AS before_, unnest(list_filter([CASE WHEN {Q.FINDS} THEN 'contamination' WHEN {Q.CLEANS} THEN 'clean' WHEN {Q.AWAITS} THEN 'awaiting' END,
        CASE WHEN {Q.says("x", Q.HALTED)} THEN 'halted' END, {", ".join(f"CASE WHEN {Q.says('x', Q.MECH[m])} THEN '{m}' END" for m in ("spoilage", "storage", "hygiene"))}], lambda z: z IS NOT NULL)) AS kind FROM e),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) AS r FROM f)"""
_N = lambda c: f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g'))"
_M = "|".join(sorted(cells.MONTHS, key=lambda m: (-len(m), m)))
_MONTHS = "map {" + ", ".join(f"'{m}': {n}" for m, n in cells.MONTHS.items()) + "}"
_NUM = r"[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+"

_TERMS = f"""WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id) AS rn_ FROM incidents) WHERE rn_ = 1),
        ev AS (SELECT event_id, min(date_iso) AS ds, max(date_end_iso) AS de, arg_min_null(kabkota, (table_row, incident_id)) AS place,
               list(DISTINCT trim(venue_raw)) FILTER (trim(venue_raw) <> '' AND NOT regexp_matches(venue_raw, '(?i)tidak\\s+(?:disebutkan|diumumkan)|spesifik')) AS venues FROM i GROUP BY event_id),
        w AS (SELECT *, try_cast(CASE WHEN length(ds) = 7 THEN ds || '-01' ELSE substr(ds, 1, 10) END AS DATE) AS a,
               CASE WHEN length(coalesce(nullif(de, ''), ds)) = 7 THEN last_day(try_cast(coalesce(nullif(de, ''), ds) || '-01' AS DATE)) ELSE try_cast(substr(coalesce(nullif(de, ''), ds), 1, 10) AS DATE) END AS b,
               {_N("regexp_replace(trim(place), '^(?i:kabupaten|kota) +', '')")} AS base FROM ev),
        e AS (SELECT event_id, (a - 1)::DATE AS opens, (greatest(a, b) + 30)::DATE AS closes, venues, base FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND base <> ''),
        terms AS (SELECT DISTINCT event_id, opens, closes, 'place' AS kind, unnest([base, replace(base, ' ', '')]) AS term FROM e
                  UNION SELECT event_id, opens, closes, 'venue', v FROM (SELECT event_id, opens, closes, {_N("v")} AS v FROM (SELECT event_id, opens, closes, unnest(venues) AS v FROM e)) WHERE length(v) >= 8)"""

_HEADS = rf"(?:{_NUM})\s+(?:orang\s+)?(?:pelajar|santri|balita|siswa|siswi|murid|warga|orang|anak|guru|korban|pasien|penerima)"
_LINKS = f"""{_TERMS}, {_D}, {_S}, a AS (SELECT doc_id, ' ' || {_N("coalesce(title, '') || chr(10) || left(text, 500)")} || ' ' AS lead, ' ' || {_N("text")} || ' ' AS body,
               try_cast(CASE WHEN length(publish_date) = 7 THEN publish_date || '-01' ELSE substr(publish_date, 1, 10) END AS DATE) AS day FROM d),
        sm AS (SELECT doc_id, event_id, max(kind) AS kind FROM a JOIN terms ON day BETWEEN opens AND closes AND contains(lead, ' ' || term || ' ') GROUP BY ALL),
        wm AS (SELECT doc_id, event_id, max(kind) AS kind FROM a JOIN terms ON day BETWEEN opens AND closes AND contains(body, ' ' || term || ' ') GROUP BY ALL),
        sl AS (SELECT doc_id, list_sort(list(DISTINCT event_id)) AS s FROM (SELECT *, max(kind) OVER (PARTITION BY doc_id) AS best FROM sm) WHERE kind = best GROUP BY doc_id),
        wl AS (SELECT doc_id, list_sort(list(DISTINCT event_id)) AS w FROM (SELECT *, max(kind) OVER (PARTITION BY doc_id) AS best FROM wm) WHERE kind = best GROUP BY doc_id),
        dec AS (SELECT a.doc_id, CASE WHEN len(s) = 1 THEN 'linked' WHEN len(s) > 1 THEN 'ambiguous' WHEN len(w) > 0 THEN 'weak' ELSE 'none' END AS decision,
               CASE WHEN len(s) > 0 THEN 'headline_or_lead' WHEN len(w) > 0 THEN 'body_only' ELSE '' END AS tier, coalesce(array_to_string(coalesce(s, w), '|'), '') AS event_ids
        FROM a LEFT JOIN sl USING (doc_id) LEFT JOIN wl USING (doc_id))"""
_LINKED = f"{_LINKS}, l AS (SELECT doc_id, event_ids AS event_id FROM dec WHERE decision = 'linked')"
_RANK = "CASE state WHEN 'contamination' THEN 4 WHEN 'clean' THEN 3 WHEN 'awaiting' THEN 2 WHEN 'samples' THEN 1 ELSE 0 END"
_SUMMARY = f"""{_LINKED}, z AS (SELECT l.event_id, a.day, {Q.STATE} AS state FROM c JOIN l USING (doc_id) JOIN a USING (doc_id)), r AS (SELECT *, {_RANK} AS rank FROM z),
        st AS (SELECT event_id, arg_max(state, rank) AS state, count(*) AS n, min(day) FILTER (rank >= 3) AS resolved FROM r GROUP BY event_id),
        se AS (SELECT doc_id, s, generate_subscripts(s, 1) AS k, unnest(s) AS x FROM c WHERE doc_id IN (SELECT doc_id FROM l)),
        sf AS (SELECT doc_id, k, x, CASE WHEN k > 1 THEN s[k - 1] END AS before_, CASE WHEN {Q.FINDS} THEN 'contamination' WHEN {Q.CLEANS} THEN 'clean' END AS kind FROM se),
        sg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) AS r, coalesce(before_, '') || ' ' || x AS ctx FROM sf WHERE kind IS NOT NULL),
        sh AS (SELECT l.event_id, kind, string_split({Q.agents("x")}, '|') AS ag, string_split({Q.speakers("ctx")}, '|') AS who FROM sg JOIN l USING (doc_id) WHERE r = 1),
        sw AS (SELECT event_id, list_sort(list_distinct(list_filter(flatten(list(ag) FILTER (kind = 'contamination')), lambda v: v <> ''))) AS ag, list_sort(list_distinct(list_filter(flatten(list(who)), lambda v: v <> ''))) AS who FROM sh GROUP BY event_id),
        ci AS (SELECT event_id, count(DISTINCT doc_id) AS cited FROM (SELECT doc_id, unnest(incident_ids) AS incident_id FROM corpus) JOIN incidents USING (incident_id) GROUP BY event_id),
        eb AS (SELECT event_id, min(date_iso) AS date_start, arg_min_null(kabkota, (table_row, incident_id)) AS kabkota FROM i GROUP BY event_id),
        summary AS (SELECT event_id, date_start, kabkota, coalesce(cited, 0) AS cited_articles, coalesce(n, 0) AS linked_articles, coalesce(state, 'no article read') AS state, resolved::VARCHAR AS first_finding_date,
            date_diff('day', try_cast(CASE WHEN length(date_start) = 7 THEN date_start || '-01' ELSE substr(date_start, 1, 10) END AS DATE), resolved) AS lag_days, coalesce(array_to_string(ag, '|'), '') AS agents,
            CASE WHEN who IS NULL THEN '' WHEN list_contains(who, 'health_body') THEN 'health_body' WHEN len(who) > 0 THEN 'other_official_only' ELSE 'unattributed' END AS attributed_to, coalesce(array_to_string(who, '|'), '') AS classes
            FROM eb LEFT JOIN st USING (event_id) LEFT JOIN sw USING (event_id) LEFT JOIN ci USING (event_id))"""

ORACLES = {
    "containment_link": f"""WITH l AS (SELECT regexp_replace(regexp_replace(nama, '^(Kabupaten|Kota) +', ''), '^Administrasi ', '') AS n FROM kabkota_codes UNION ALL SELECT unnest(string_split(nama_lain, ';')) FROM kabkota_codes),
        n AS (SELECT DISTINCT {_N("n")} AS term FROM l WHERE {_N("n")} <> ''),
        t AS (SELECT DISTINCT doc_id, ' ' || {_N("text")} || ' ' AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) AS n, md5(string_agg(term, '|' ORDER BY term)) AS digest FROM t JOIN n ON contains(t, ' ' || term || ' ') GROUP BY doc_id""",
    "link_tiers": f"{_LINKS} SELECT * FROM dec",
    "citation_audit": f"""{_TERMS},
        c AS (SELECT DISTINCT event_id, unnest(source_urls) AS url FROM i), l AS (SELECT url, title, publish_date, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, entry_id DESC) AS k FROM fetch_ledger WHERE title <> ''),
        a AS (SELECT url, ' ' || {_N("title")} || ' ' AS t, try_cast(CASE WHEN length(publish_date) = 7 THEN publish_date || '-01' ELSE substr(publish_date, 1, 10) END AS DATE) AS day FROM l WHERE k = 1 AND url IN (SELECT url FROM c)),
        f AS (SELECT url, event_id, opens, closes, kind, day FROM a JOIN terms ON contains(t, ' ' || term || ' ')),
        m AS (SELECT url, event_id, max(kind) AS kind FROM f WHERE day BETWEEN opens AND closes GROUP BY ALL), b AS (SELECT url, event_id FROM (SELECT *, max(kind) OVER (PARTITION BY url) AS best FROM m) WHERE kind = best),
        n AS (SELECT url, count(DISTINCT event_id) AS n FROM b GROUP BY url), o AS (SELECT DISTINCT url FROM b JOIN c USING (url, event_id)), p AS (SELECT DISTINCT url FROM f JOIN c USING (url, event_id))
        SELECT a.url, CASE WHEN n = 1 AND o.url IS NOT NULL THEN 'agrees' WHEN n > 1 AND o.url IS NOT NULL THEN 'ambiguous_includes_cited' WHEN p.url IS NULL THEN 'place_not_named_in_lead'
               WHEN day IS NULL THEN 'place_ok_date_unknown' ELSE 'place_ok_but_dates_or_other_event' END AS check FROM a LEFT JOIN n USING (url) LEFT JOIN o USING (url) LEFT JOIN p USING (url)""",
    "label_frame": f"""WITH {_D}, {_S}, e AS (SELECT domain, unnest(s) AS x FROM c WHERE domain IS NOT NULL), k AS (SELECT domain, {Q.STRATUM} AS stratum FROM e WHERE length(x) BETWEEN 41 AND 399)
        SELECT domain, stratum, count(*) AS n FROM k WHERE stratum IS NOT NULL GROUP BY ALL""",
    "dates_in_text": f"""WITH {_D}, r AS (SELECT doc_id, regexp_extract_all(text, '(?i)\\b(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\\s+(?:{_M})\\s+[0-9]{{4}}|(?:{_M})\\s+[0-9]{{4}})\\b') AS f FROM d),
        e AS (SELECT doc_id, generate_subscripts(f, 1) AS k, unnest(f) AS m FROM r),
        p AS (SELECT doc_id, k, CASE WHEN contains(m, '/') THEN split_part(m, '/', 1) WHEN regexp_matches(m, '^(?:0?[1-9]|[12][0-9]|3[01])[^0-9]') THEN regexp_extract(m, '^([0-9]+)', 1) END AS d,
                     CASE WHEN contains(m, '/') THEN split_part(m, '/', 2)::INT ELSE {_MONTHS}[lower(regexp_extract(m, '([A-Za-z]+)', 1))] END AS mo, right(m, 4) AS y FROM e),
        o AS (SELECT doc_id, k, y || '-' || lpad(mo::VARCHAR, 2, '0') || CASE WHEN d IS NULL THEN '' ELSE '-' || lpad(d, 2, '0') END AS iso FROM p WHERE mo BETWEEN 1 AND 12 AND (d IS NULL OR d::INT BETWEEN 1 AND 31)),
        g AS (SELECT doc_id, count(*) AS n, string_agg(iso, '|' ORDER BY k) AS s FROM o GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n, coalesce(split_part(s, '|', 1), '') AS first_date, md5(coalesce(s, '')) AS digest FROM d LEFT JOIN g USING (doc_id)""",
    "interval_link": """
        WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate::DATE BETWEEN o_orderdate::DATE - 1 AND o_orderdate::DATE + 30 GROUP BY o_orderkey)
        SELECT CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS decision, count(*) AS orders FROM n GROUP BY 1""",
    "lexicon_indicators": f"WITH {_D}, {_S} SELECT doc_id, {Q.STATE} AS certainty, {Q.INDICATORS} FROM c",
    "suspected_foods": f"WITH {_D}, {_S} SELECT doc_id, {Q.FOODS_SUSPECTED} AS foods FROM c",
    "certainty_ladder": f"WITH {_D}, {_S} SELECT doc_id, {Q.STATE} AS certainty FROM c",
    "flagged_sentences": f"WITH {_D}, {_S} SELECT doc_id, len(list_filter(s, lambda x: {Q.FINDS} OR {Q.CLEANS} OR {Q.AWAITS})) AS flagged FROM c",
    "headline_causes": f"WITH {_D} SELECT doc_id, {Q.HEADLINE} AS cause FROM d",
    "without_teasers": rf"""WITH {_D}, t AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i)\b(?:simak|lihat|saksikan)\s+(?:juga\s+)?video\b|^[^a-z0-9]*(?:baca|simak|lihat)\s+juga\b')), chr(10)) AS t FROM d)
        SELECT doc_id, length(text) - length(t) AS cut, md5(t) AS digest FROM t WHERE t <> text""",
    "first_finding": f"WITH {_KINDS} SELECT doc_id, kind, k - 1 AS i, instr(text, left(x, 80)) - 1 AS char_start, md5(left(x, 400)) AS digest FROM g WHERE r = 1",
    "attribution_prev": f"""WITH {_KINDS}, h AS (SELECT *, coalesce(before_, '') || ' ' || x AS ctx FROM g WHERE r = 1)
        SELECT doc_id, kind, {Q.speakers("ctx")} AS attributed_to, {Q.agents("x")} AS agents FROM h""",
    "best_state": f"""{_LINKED}, z AS (SELECT l.event_id, {Q.STATE} AS state FROM c JOIN l USING (doc_id)), r AS (SELECT event_id, state, {_RANK} AS rank FROM z),
        b AS (SELECT event_id, arg_max(state, rank) AS state, count(*) AS articles FROM r GROUP BY event_id)
        SELECT event_id, coalesce(state, 'no article read') AS state, coalesce(articles, 0) AS articles FROM (SELECT DISTINCT event_id FROM i) LEFT JOIN b USING (event_id)""",
    "event_summary": f"{_SUMMARY} SELECT * FROM summary",
    "evidence_headline": f"""{_SUMMARY} SELECT 'decision ' || decision AS name, count(*)::DOUBLE AS value FROM dec GROUP BY 1 UNION ALL SELECT 'events ' || state, count(*) FROM summary GROUP BY 1
        UNION ALL SELECT 'resolved by ' || attributed_to, count(*) FROM summary WHERE state IN ('contamination', 'clean') GROUP BY 1 UNION ALL SELECT 'median lag', median(lag_days) FROM summary""",
    "doc_events": """WITH x AS (SELECT DISTINCT doc_id, unnest(incident_ids) AS incident_id FROM corpus), m AS (SELECT DISTINCT doc_id, event_id FROM x JOIN incidents USING (incident_id)),
        o AS (SELECT doc_id, string_agg(event_id, '|' ORDER BY event_id) AS ids, count(*) AS n FROM m GROUP BY doc_id),
        e AS (SELECT event_id, min(date_iso) AS date_start, arg_min_null(kabkota, (table_row, incident_id)) AS kabkota FROM incidents GROUP BY event_id)
        SELECT doc_id, coalesce(ids, '') AS event_ids, date_start, kabkota FROM (SELECT DISTINCT doc_id FROM corpus) LEFT JOIN o USING (doc_id) LEFT JOIN e ON n = 1 AND ids = event_id""",
    "url_incidents": """WITH x AS (SELECT DISTINCT incident_id, unnest(source_urls) AS url FROM incidents), g AS (SELECT url, string_agg(incident_id, '|' ORDER BY incident_id) AS incidents FROM x GROUP BY url)
        SELECT url, coalesce(incidents, '') AS incidents FROM (SELECT DISTINCT url FROM fetch_ledger WHERE status = 'ok') LEFT JOIN g USING (url)""",
    "feed_only": "SELECT domain FROM documents WHERE text IS NOT NULL AND domain IS NOT NULL AND source IS NOT NULL GROUP BY domain HAVING bool_and(starts_with(source, 'tag_feed'))",
    "count_agreement": rf"""{_LINKED}, f AS (SELECT event_id, arg_min_null(symptomatic, (table_row, incident_id)) AS figure, arg_min_null(map_values(symptomatic_by_subject), (table_row, incident_id)) AS parts FROM i GROUP BY event_id),
        p AS (SELECT doc_id, event_id, figure, parts, regexp_replace(coalesce(title, '') || chr(10) || text, '(?i)\b(?:dari|memiliki)\s+(?:(?:total|jumlah)\s+)?(?:sekitar\s+)?{_HEADS}|\b{_HEADS}\s+(?:(?:\w+\s+){{0,3}}?(?:yang\s+)?(?:terdaftar|mengikuti|ikut\s+mencicipi)|penerima\s+manfaat)', ' ', 'g') AS t
              FROM c JOIN l USING (doc_id) JOIN f USING (event_id) WHERE figure IS NOT NULL),
        x AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '(?i)\b{_HEADS}', 0), lambda v: try_cast(replace(regexp_extract(v, '^({_NUM})', 1), '.', '') AS INTEGER))) AS n FROM p)
        SELECT doc_id, event_id, figure::BIGINT AS figure, len(n) AS numbers, list_max(n)::BIGINT AS largest, CASE WHEN len(n) = 0 THEN 'no counts in article' WHEN list_contains(n, figure) OR coalesce(list_has_any(n, parts), false) THEN 'table figure appears in article'
               WHEN list_max(n) > figure THEN 'article reports more than table' ELSE 'article reports less than table' END AS verdict, CASE WHEN figure <> 0 THEN round(list_max(n) / figure, 2) END AS ratio FROM x""",
    "source_rank": f"""WITH {_D}, k AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY CASE source WHEN 'cited' THEN 0 WHEN 'tag_feed' THEN 1 ELSE 2 END, publish_date DESC NULLS LAST, doc_id) AS turn FROM d WHERE domain IS NOT NULL)
        SELECT doc_id, domain, turn FROM k WHERE turn <= 3""",
}
