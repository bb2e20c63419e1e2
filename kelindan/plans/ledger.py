"""Queries on attempts, citations and URLs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.functions import cells as C
from kelindan.functions import urls as U
from kelindan.operators import ledger as L
from kelindan.session import table


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_ledger").dropDuplicates(["entry_id"])


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fetch_ledger").select("url", "entry_id", "fetched_at", "status", "http_status", "n_chars")
    return L.last_wins(rows, "url", ["fetched_at", "entry_id"])


def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    last = L.last_wins(table(spark, d, "fetch_ledger").select("url", "entry_id", "fetched_at", "status", "via"), "url", ["fetched_at", "entry_id"])
    return last.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("via") == "wayback").alias("via_archive"))


def failures_by_domain(spark: SparkSession, d: str) -> DataFrame:
    last = L.last_wins(table(spark, d, "fetch_ledger").select("url", "entry_id", "fetched_at", "status", "domain"), "url", ["fetched_at", "entry_id"])
    return last.where("status <> 'ok'").groupBy("domain").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "domain")


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """URLs that were read in the end after a failed attempt."""
    g = _ledger(spark, d).groupBy("url").agg(
        F.min(F.when(F.col("status") == "ok", F.col("fetched_at"))).alias("read_at"), F.min(F.when(F.col("status") != "ok", F.col("fetched_at"))).alias("failed_at"), F.count("*").alias("attempts")
    )
    return g.where("failed_at < read_at").select("url", "attempts")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "fetch_ledger").where("status = 'ok'").select("url")
    return table(spark, d, "citations").where("url like 'http%'").select("url").distinct().join(done, "url", "left_anti")


def semi_refs(spark: SparkSession, d: str) -> DataFrame:
    """Citations that some incident row cites, second references folded onto their base."""
    base = lambda c: F.regexp_replace(c, r"\.[0-9]+$", "")
    cited = table(spark, d, "incidents").select(F.explode("ref_ids").alias("r")).select(base(F.col("r")).alias("base"))
    return table(spark, d, "citations").dropDuplicates(["citation_id"]).withColumn("base", base(F.col("ref_id"))).join(cited, "base", "left_semi").select("citation_id", "base")


def incident_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs under the references of a row, in the order in which it cites them."""
    refs = table(spark, d, "incidents").dropDuplicates(["incident_id"]).select("incident_id", F.posexplode("ref_ids").alias("pos", "ref_id"))
    cites = table(spark, d, "citations").dropDuplicates(["citation_id"]).select("ref_id", "citation_id", F.coalesce(F.nullif("archive_url", F.lit("")), F.nullif("url", F.lit(""))).alias("best"))
    joined = refs.join(cites, "ref_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("pos", "citation_id", "best"))))
    return joined.groupBy("incident_id").agg(F.array_join(F.transform(listed, lambda s: s["best"]), " ").alias("urls"))


def unique_urls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").where("url like 'http%'")
    return c.groupBy("url").agg(
        F.array_join(F.sort_array(F.collect_set("ref_id")), "|").alias("refs"), F.min_by("date", F.when(F.trim(F.col("date")) != "", F.struct("citation_id", "date"))).alias("first_date")
    )


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "citations").where("url like 'http%'").groupBy("url").agg(F.min("citation_id").alias("seq")).withColumn("host", U.domain_of(F.col("url")))
    return L.interleave(seen, "host", ["seq", "url"], F.format_string("%012d", F.floor(F.col("seq") / 100_000))).select("url", F.col("round").cast("long").alias("round"), F.col("group_first").alias("host_first"))


def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = L.failure_runs(_ledger(spark, d).where(F.col("domain").isNotNull()), "domain", ["fetched_at", "entry_id"], F.col("status") != "ok", 3, F.substring("fetched_at", 1, 10))
    return runs.groupBy("domain").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


def throttle_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = L.gaps(table(spark, d, "events"), "user_id", F.col("ts"), ["ts", "event_id"], 60.0, F.to_date("ts"))
    return g.groupBy("user_id").agg(F.round(F.sum("wait_s"), 3).alias("wait_s"), F.round(F.min("gap_s"), 3).alias("least_gap_s"))


def nearest_before(spark: SparkSession, d: str) -> DataFrame:
    """For every archived attempt the last attempt at the origin before it."""
    log = _ledger(spark, d).select("entry_id", "url", "via", "fetched_at")
    left = log.where("via = 'wayback'").select("entry_id", "url", "fetched_at")
    right = log.where("via = 'origin'").select("url", "fetched_at", F.col("entry_id").alias("origin_entry"))
    return L.as_of(left, right, "url", "fetched_at", "fetched_at", "origin_entry", lambda t: F.substring(t, 1, 10)).select("entry_id", "origin_entry")


def nearest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """For every cited URL the archived attempt nearest to its first attempt, either side, the earlier of two as near."""
    log = _ledger(spark, d).select("entry_id", "url", "via", F.unix_seconds(F.to_timestamp("fetched_at")).alias("t"))
    first = log.groupBy("url").agg(F.min("t").alias("t0"))
    near = log.where("via = 'wayback'").join(first, "url").groupBy("url").agg(F.min(F.struct(F.abs(F.col("t") - F.col("t0")).alias("off"), "t", "entry_id")).alias("s"))
    return near.select("url", F.col("s.entry_id").alias("entry_id"), F.col("s.off").alias("off_s"))


def source_merge(spark: SparkSession, d: str) -> DataFrame:
    """Cited and fetched URLs, full outer; what the ledger read comes before what the citation says."""
    c = table(spark, d, "citations").where("url <> ''").groupBy("url").agg(F.min(F.nullif("title", F.lit(""))).alias("cited_title"))
    f = table(spark, d, "fetch_ledger").where("url <> ''").groupBy("url").agg(F.max_by(F.nullif("title", F.lit("")), F.when(F.col("title") != "", F.struct("fetched_at", "entry_id"))).alias("read_title"))
    m = c.join(f, "url", "full_outer")
    return m.select("url", F.coalesce("read_title", "cited_title", F.lit("")).alias("title"), F.when(F.col("read_title").isNotNull(), "read").when(F.col("cited_title").isNotNull(), "cited").otherwise("none").alias("from_"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "corpus").select("url").distinct()
    url = F.col("url")
    return u.select(
        "url", U.domain_of(url).alias("host"), U.registrable(U.domain_of(url)).alias("registrable"), U.is_archived(url).alias("archived"), U.original_of(url).alias("original"),
        U.raw_snapshot(url).alias("raw"), U.host_key(url).alias("key"),
    )


def covered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Share of incident rows by province of which some URL was read."""
    rows = table(spark, d, "incidents").dropDuplicates(["incident_id"]).select("incident_id", F.coalesce("province", F.lit("unknown")).alias("province"), "source_urls")
    ok = table(spark, d, "fetch_ledger").where("status = 'ok'").select("url").distinct().withColumn("read", F.lit(1))
    hit = rows.select("incident_id", F.explode("source_urls").alias("url")).join(ok, "url").select("incident_id").distinct().withColumn("hit", F.lit(1))
    return rows.join(hit, "incident_id", "left").groupBy("province").agg(F.count("*").alias("n"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 4).alias("rate"))


def host_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Per domain: attempts, answers that trip its breaker, and attempts made while it was to be left alone."""
    log = _ledger(spark, d).select("domain", "entry_id", "fetched_at", "http_status")
    b = L.breaker(log, "domain", "fetched_at", "http_status", ["fetched_at", "entry_id"], F.substring("fetched_at", 1, 10))
    return b.groupBy("domain").agg(F.count("*").alias("attempts"), F.count("trips").alias("trips"), F.count_if("open").alias("while_open"))


def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of every URL from the last answers of origin and archive; the sample of skipped and walled domains stands for lists that a user gives."""
    order = F.struct("fetched_at", "entry_id")
    log = table(spark, d, "fetch_ledger").where("url <> ''")
    last = lambda via, c: F.max_by(c, F.when(F.col("via") == via, order))
    ask = lambda p, via: [last(via, "http_status").alias(f"{p}_status"), last(via, "n_chars").alias(f"{p}_chars"), last(via, F.coalesce(F.col("n_chars") > 0, F.lit(False)).cast("int")).alias(f"{p}_bytes")]
    landed = log.groupBy("url").agg(F.max("domain").alias("domain"), (~F.max(F.coalesce(F.col("status") == "robots_disallowed", F.lit(False)))).alias("allowed"), *ask("origin", "origin"), *ask("archive", "wayback"))
    return L.outcomes(landed, skip=("news.example",), paywalled=("radargupol.example",))


def publish_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of publication of read pages; one that is the day of the crawl and what the page's own date was read as was made up by the reading, and is discarded."""
    last = L.last_wins(table(spark, d, "fetch_ledger").where("status = 'ok'").select("url", "entry_id", "fetched_at", "publish_date", "extracted_date"), "url", ["fetched_at", "entry_id"])
    day = C.iso_day(F.col("publish_date"))
    crawl = (day == F.substring("fetched_at", 1, 10)) & (day == C.iso_day(F.col("extracted_date")))
    made_up = F.coalesce(crawl, F.lit(False))
    return last.select("url", F.when(~made_up, day).alias("day"), made_up.alias("crawl_day"))


def gallery_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").dropDuplicates(["citation_id"])
    return c.select("citation_id", U.is_gallery(F.col("url"), F.col("title")).alias("gallery"))


def snapshot_requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citations").where("url like 'http%'").dropDuplicates(["citation_id"])
    return c.select("citation_id", U.snapshot_request("https://arsip.example/available", F.col("url"), C.iso_day(F.col("date"))).alias("request"))


def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Text of a read URL: the article's, else the raw page's, else none."""
    last = table(spark, d, "fetch_ledger").where("status = 'ok'").groupBy("url").agg(F.max("cache_path").alias("cache_path"))
    docs = table(spark, d, "documents").where("url <> ''").groupBy("url").agg(F.max(F.length("text")).alias("a"))
    raw = table(spark, d, "page_cache").select("cache_path", F.length("html").alias("b"))
    return last.join(docs, "url", "left").join(raw, "cache_path", "left").select("url", F.coalesce("a", "b").cast("long").alias("chars"))


QUERIES = {
    "host_breaker": host_breaker,
    "fetch_outcomes": fetch_outcomes,
    "publish_days": publish_days,
    "gallery_pages": gallery_pages,
    "snapshot_requests": snapshot_requests,
    "text_lookup": text_lookup,
    "ledger_last_wins": last_wins,
    "ledger_summary": ledger_summary,
    "failures_by_domain": failures_by_domain,
    "recovered_urls": recovered,
    "resume_anti": resume_anti,
    "semi_refs": semi_refs,
    "incident_urls": incident_urls,
    "unique_urls": unique_urls,
    "round_robin": round_robin,
    "failure_runs": failure_runs,
    "throttle_gaps": throttle_gaps,
    "nearest_before": nearest_before,
    "nearest_snapshot": nearest_snapshot,
    "source_merge": source_merge,
    "url_parts": url_parts,
    "covered_rows": covered_rows,
}

_LAST = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, entry_id DESC) AS k FROM fetch_ledger WHERE url IS NOT NULL), l AS (SELECT * FROM r WHERE k = 1)"""
_ONE = "WITH f AS (SELECT DISTINCT entry_id, url, via, status, domain, fetched_at FROM fetch_ledger)"

_M = "|".join(sorted(C.MONTHS, key=lambda m: (-len(m), m)))
_NO = "map {" + ", ".join(f"'{m}': {n}" for m, n in C.MONTHS.items()) + "}"
# The ISO day with which a value begins, or its first date where that is a day.
_DAY = lambda c: f"""coalesce(nullif(regexp_extract(trim({c}), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ''), (SELECT CASE WHEN m LIKE '%/%' THEN right(m, 4) || '-' || lpad(split_part(m, '/', 2), 2, '0') || '-' || lpad(split_part(m, '/', 1), 2, '0')
    WHEN regexp_matches(m, '^(?:0?[1-9]|[12][0-9]|3[01])[^0-9]') THEN right(m, 4) || '-' || lpad(({_NO}[lower(regexp_extract(m, '([A-Za-z]+)', 1))])::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(m, '^([0-9]+)', 1), 2, '0') END
    FROM (SELECT list_filter(regexp_extract_all({c}, '(?i)\\b(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\\s+(?:{_M})\\s+[0-9]{{4}}|(?:{_M})\\s+[0-9]{{4}})\\b'),
        lambda z: NOT (z LIKE '%/%' AND (coalesce(try_cast(split_part(z, '/', 2) AS INT), 0) NOT BETWEEN 1 AND 12 OR coalesce(try_cast(split_part(z, '/', 1) AS INT), 0) NOT BETWEEN 1 AND 31)))[1] AS m)))"""  # noqa: E731

ORACLES = {
    "host_breaker": f"""WITH f AS (SELECT DISTINCT entry_id, domain, fetched_at, coalesce(http_status, 0) AS c, epoch(fetched_at::TIMESTAMPTZ)::BIGINT AS t FROM fetch_ledger WHERE domain IS NOT NULL),
        a AS (SELECT *, sum((c <> 0)::INT) OVER w AS er, sum((c BETWEEN 200 AND 299)::INT) OVER w AS fr FROM f WINDOW w AS (PARTITION BY domain ORDER BY fetched_at, entry_id)),
        b AS (SELECT *, sum((c = 0)::INT) OVER (PARTITION BY domain, er ORDER BY fetched_at, entry_id) AS ek, sum((c = 403)::INT) OVER (PARTITION BY domain, fr ORDER BY fetched_at, entry_id) AS fk FROM a),
        p AS (SELECT *, CASE WHEN c IN (429, 503) THEN 900 WHEN c = 0 AND ek % 3 = 0 THEN 300 WHEN c = 403 AND fr > 0 AND fk % 5 = 0 THEN 1800 END AS trips FROM b),
        u AS (SELECT *, last_value(t + trips IGNORE NULLS) OVER (PARTITION BY domain ORDER BY fetched_at, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM p)
        SELECT domain, count(*) AS attempts, count(trips) AS trips, count(*) FILTER (t < until) AS while_open FROM u GROUP BY domain""",
    "fetch_outcomes": """WITH l AS (SELECT * FROM fetch_ledger WHERE url <> ''), o AS (SELECT url, arg_max_null(http_status, (fetched_at, entry_id)) AS c, arg_max_null(n_chars, (fetched_at, entry_id)) AS n FROM l WHERE via = 'origin' GROUP BY url),
        a AS (SELECT url, arg_max_null(http_status, (fetched_at, entry_id)) AS c, arg_max_null(n_chars, (fetched_at, entry_id)) AS n FROM l WHERE via = 'wayback' GROUP BY url),
        j AS (SELECT u.url, u.domain, allowed, coalesce(o.c, 0) AS oc, coalesce(o.n, 0) AS n0, coalesce(a.c, 0) BETWEEN 1 AND 399 AND coalesce(a.n, 0) > 0 AS kept, coalesce(a.n, 0) AS n1, coalesce(u.domain = 'radargupol.example', false) AS wall
              FROM (SELECT url, max(domain) AS domain, NOT bool_or(coalesce(status = 'robots_disallowed', false)) AS allowed FROM l GROUP BY url) u LEFT JOIN o USING (url) LEFT JOIN a USING (url)),
        k AS (SELECT *, oc = 0 OR oc >= 400 OR n0 = 0 AS bad, coalesce(domain LIKE '%.news.example' OR domain = 'news.example', false) AS skip FROM j), v AS (SELECT *, kept AND (NOT allowed OR bad OR (n0 < 400 AND NOT wall AND n1 > n0)) AS ar FROM k),
        z AS (SELECT *, CASE WHEN ar THEN n1 ELSE n0 END AS n FROM v), y AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n >= 400 THEN 'ok' WHEN wall THEN 'paywalled' ELSE 'short_body' END AS body FROM z)
        SELECT url, CASE WHEN skip THEN 'skipped_domain' WHEN ar THEN body WHEN NOT allowed THEN 'robots_disallowed' WHEN bad THEN CASE WHEN oc = 0 THEN 'network_error' WHEN oc >= 400 THEN 'http_error' ELSE 'no_archive' END ELSE body END AS status,
               CASE WHEN skip THEN '' WHEN ar THEN 'wayback' ELSE 'origin' END AS via FROM y""",
    "publish_days": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, entry_id DESC) AS k FROM fetch_ledger WHERE status = 'ok' AND url IS NOT NULL), e AS (SELECT url, fetched_at, {_DAY("publish_date")} AS day, {_DAY("extracted_date")} AS found FROM r WHERE k = 1)
        SELECT url, CASE WHEN NOT coalesce(day = left(fetched_at, 10) AND day = found, false) THEN day END AS day, coalesce(day = left(fetched_at, 10) AND day = found, false) AS crawl_day FROM e""",
    "gallery_pages": r"""SELECT DISTINCT citation_id, coalesce(regexp_matches(url, '^[^/]*//(?:www\.)?(?:20|video)\.'), false) OR coalesce(regexp_matches(url, '^[^/]*//[^/]*/(?:(?:video|foto|tv)/|(?:.*/)?foto[a-z-]*/)'), false)
        OR coalesce(regexp_matches(title, '^(?i:video:|video |foto:)'), false) AS gallery FROM citations""",
    "snapshot_requests": f"""SELECT DISTINCT citation_id, 'https://arsip.example/available?url=' || url_encode(url) || CASE WHEN day IS NULL THEN '' ELSE '&timestamp=' || replace(day, '-', '') END AS request
        FROM (SELECT citation_id, url, {_DAY("date")} AS day FROM citations WHERE url LIKE 'http%')""",
    "text_lookup": """WITH l AS (SELECT url, max(cache_path) AS cache_path FROM fetch_ledger WHERE status = 'ok' AND url IS NOT NULL GROUP BY url), a AS (SELECT url, max(length(text)) AS a FROM documents WHERE url <> '' GROUP BY url)
        SELECT l.url, coalesce(a, length(html))::BIGINT AS chars FROM l LEFT JOIN a USING (url) LEFT JOIN page_cache USING (cache_path)""",
    "ledger_last_wins": f"{_LAST} SELECT url, entry_id, fetched_at, status, http_status, n_chars FROM l",
    "ledger_summary": f"{_LAST} SELECT status, count(*) AS n, count(*) FILTER (via = 'wayback') AS via_archive FROM l GROUP BY status",
    "failures_by_domain": f"{_LAST} SELECT domain, count(*) AS failures FROM l WHERE status <> 'ok' GROUP BY domain",
    "recovered_urls": f"""{_ONE} SELECT url, count(*) AS attempts FROM f GROUP BY url HAVING min(fetched_at) FILTER (status <> 'ok') < min(fetched_at) FILTER (status = 'ok')""",
    "resume_anti": "SELECT DISTINCT url FROM citations WHERE url LIKE 'http%' AND url NOT IN (SELECT url FROM fetch_ledger WHERE status = 'ok' AND url IS NOT NULL)",
    "semi_refs": r"""WITH c AS (SELECT DISTINCT citation_id, regexp_replace(ref_id, '\.[0-9]+$', '') AS base FROM citations), i AS (SELECT DISTINCT regexp_replace(unnest(ref_ids), '\.[0-9]+$', '') AS base FROM incidents)
        SELECT citation_id, base FROM c WHERE base IN (SELECT base FROM i)""",
    "incident_urls": """
        WITH i AS (SELECT DISTINCT incident_id, ref_ids FROM incidents WHERE len(ref_ids) > 0), r AS (SELECT incident_id, generate_subscripts(ref_ids, 1) AS pos, unnest(ref_ids) AS ref_id FROM i),
        c AS (SELECT DISTINCT citation_id, ref_id, coalesce(nullif(archive_url, ''), nullif(url, '')) AS best FROM citations)
        SELECT incident_id, coalesce(string_agg(best, ' ' ORDER BY pos, citation_id), '') AS urls FROM r LEFT JOIN c USING (ref_id) GROUP BY incident_id""",
    "unique_urls": """SELECT url, coalesce(string_agg(DISTINCT ref_id, '|' ORDER BY ref_id), '') AS refs, arg_min(date, citation_id) FILTER (trim(date) <> '') AS first_date FROM citations WHERE url LIKE 'http%' GROUP BY url""",
    "round_robin": r"""
        WITH s AS (SELECT url, min(citation_id) AS seq, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM citations WHERE url LIKE 'http%' GROUP BY url)
        SELECT url, row_number() OVER (PARTITION BY host ORDER BY seq, url) AS round, min(seq) OVER (PARTITION BY host) AS host_first FROM s""",
    "failure_runs": f"""{_ONE}, m AS (SELECT domain, status <> 'ok' AS bad, sum(CASE WHEN status <> 'ok' THEN 0 ELSE 1 END) OVER (PARTITION BY domain ORDER BY fetched_at, entry_id) AS run FROM f WHERE domain IS NOT NULL),
        r AS (SELECT domain, run, count(*) AS n FROM m WHERE bad GROUP BY ALL HAVING count(*) >= 3) SELECT domain, count(*) AS runs, max(n) AS longest FROM r GROUP BY domain""",
    "throttle_gaps": """
        WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
        SELECT user_id, round(sum(coalesce(greatest(0.0, 60.0 - gap), 0.0)), 3) AS wait_s, round(min(gap), 3) AS least_gap_s FROM g GROUP BY user_id""",
    "nearest_before": f"""{_ONE}, w AS (SELECT entry_id, url, fetched_at FROM f WHERE via = 'wayback'), o AS (SELECT url, fetched_at, max(entry_id) AS origin_entry FROM f WHERE via = 'origin' GROUP BY ALL)
        SELECT w.entry_id, o.origin_entry FROM w ASOF LEFT JOIN o ON w.url = o.url AND w.fetched_at >= o.fetched_at""",
    "nearest_snapshot": f"""{_ONE}, t AS (SELECT entry_id, url, via, epoch(fetched_at::TIMESTAMPTZ)::BIGINT AS t FROM f), z AS (SELECT url, min(t) AS t0 FROM t GROUP BY url),
        k AS (SELECT t.url, entry_id, abs(t - t0) AS off_s, row_number() OVER (PARTITION BY t.url ORDER BY abs(t - t0), t, entry_id) AS k FROM t JOIN z USING (url) WHERE via = 'wayback')
        SELECT url, entry_id, off_s FROM k WHERE k = 1""",
    "source_merge": """
        WITH c AS (SELECT url, min(nullif(title, '')) AS ct FROM citations WHERE url <> '' GROUP BY url),
        f AS (SELECT url, arg_max(title, (fetched_at, entry_id)) FILTER (title <> '') AS rt FROM fetch_ledger WHERE url <> '' GROUP BY url)
        SELECT url, coalesce(rt, ct, '') AS title, CASE WHEN rt IS NOT NULL THEN 'read' WHEN ct IS NOT NULL THEN 'cited' ELSE 'none' END AS from_ FROM c FULL JOIN f USING (url)""",
    "url_parts": r"""
        WITH u AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS host FROM corpus)
        SELECT url, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS registrable, regexp_matches(url, '/web/[0-9]+[a-z_]*/https?://') AS archived,
               coalesce(nullif(regexp_extract(url, '/web/[0-9]+[a-z_]*/(https?://.+)$', 1), ''), url) AS original,
               regexp_replace(regexp_replace(url, '^http://', 'https://'), '(/web/[0-9]+)(/https?://)', '\1id_\2') AS raw,
               CASE WHEN host LIKE '%arsip.example' OR host LIKE '%archive.org' THEN 'arsip.example' ELSE host END AS key FROM u""",
    "covered_rows": """
        WITH i AS (SELECT DISTINCT incident_id, coalesce(province, 'unknown') AS province, source_urls FROM incidents), u AS (SELECT incident_id, unnest(source_urls) AS url FROM i),
        h AS (SELECT DISTINCT incident_id FROM u WHERE url IN (SELECT url FROM fetch_ledger WHERE status = 'ok'))
        SELECT province, count(*) AS n, count(h.incident_id) AS covered, round(count(h.incident_id) / count(*), 4) AS rate FROM i LEFT JOIN h USING (incident_id) GROUP BY province""",
}
