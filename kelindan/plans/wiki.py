"""Queries on wiki pages and listing pages, with their oracles. The tables hold no markup, so pages are written from their rows, as editors would, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelindan.operators import wiki as W
from kelindan.plans import incidents as P
from kelindan.session import keep, table
from kelindan.sources import listings as G
from kelindan.sources.wikitext import WikiCitations, WikiTable

#: Rows of a page: pages are documents, so a source of any length makes many.
PAGE_ROWS = 200
HEAD = "\n".join(f"! {c}" for c in W.COLUMNS)


def _markup(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, wikitext): incident rows as tables with merged figures, below a heading, with a placeholder before them and a total after them."""
    rows = table(spark, d, "incidents").dropDuplicates(["incident_id"]).withColumn("page", F.concat_ws("/", "source_page", F.floor(F.col("table_row") / PAGE_ROWS).cast("string")))
    order = Window.partitionBy("page").orderBy("table_row", "incident_id")
    rows = rows.withColumn("new", F.coalesce(F.lag("event_id").over(order) != F.col("event_id"), F.lit(True)))
    rows = rows.withColumn("tall", F.count("*").over(Window.partitionBy("page", "event_id")))
    figure = F.when(F.col("new"), F.concat(F.lit('\n| rowspan="'), F.col("tall"), F.lit('" | '), _markup("symptomatic_raw"))).otherwise("")
    refs = F.array_join(F.transform("ref_ids", lambda r: F.concat(F.lit('<ref name="'), r, F.lit('"/>'))), "")
    linked = F.when(F.trim(_markup("kabkota")) == "", "").otherwise(F.concat(F.lit("[["), F.col("kabkota"), F.lit("]]")))
    line = F.concat(
        F.lit("|-\n| "), _markup("date_raw"), F.lit("\n| "), _markup("province_raw"), F.lit("\n| "), linked, F.lit("\n| '''"), _markup("venue_raw"), F.lit("'''"), figure, F.lit("\n| "), _markup("deaths_raw"), F.lit("\n| "), refs
    )
    body = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_row", "incident_id", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"), F.sum("symptomatic").alias("sum"))
    top = F.lit(f"Pengantar\n== Negara lain ==\n{{|\n! x\n|}}\n== Daftar ==\n=== Indonesia ===\n{{| class=\"wikitable\"\n|-\n{HEAD}\n|-\n| \n| Kosong\n| \n| \n| \n| \n| \n")
    total = F.concat(F.lit('\n|-\n| colspan="4" | TOTAL\n| '), F.coalesce(F.col("sum"), F.lit(0)), F.lit("\n| \n| \n|}\n== Lain =="))
    return body.select("page", F.concat(top, "body", total).alias("wikitext"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return keep(W.read_pages(pages(spark, d), "page", "wikitext", "Indonesia"), "table-rows")


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    cites = table(spark, d, "citations").select("ref_id", "citation_id", "url", "archive_url")
    return keep(W.normalise(_rows(spark, d), "page", cites, table(spark, d, "kabkota_codes")), "incidents")


def wiki_report(spark: SparkSession, d: str) -> DataFrame:
    return W.page_report(_rows(spark, d), "page")


def wiki_incidents(spark: SparkSession, d: str) -> DataFrame:
    i = _incidents(spark, d)
    subjects = F.array_join(F.transform(F.map_entries("by_subject"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    numbers = [F.col(c).cast("long").alias(c) for c in ("symptomatic", "symptomatic_min", "symptomatic_max", "symptomatic_counted", "deaths_counted")]
    return i.select(
        "incident_id", "event_id", "date_iso", "date_end_iso", "date_precision", "province", "kode", "kode_match", "venue", "venue_level", "kind", *numbers, F.coalesce(subjects, F.lit("")).alias("subjects"),
        F.array_join("source_urls", " ").alias("urls"), F.array_join("flags", "|").alias("flags"),
    )


def wiki_events(spark: SparkSession, d: str) -> DataFrame:
    e = W.collapse(_incidents(spark, d))
    joined = [F.array_join(c, "|").alias(c) for c in ("venues", "venue_levels", "source_urls", "incident_ids", "flags")]
    return e.select("event_id", "date_start", "date_end", "province", "kode", F.col("symptomatic").cast("long").alias("symptomatic"), "kind", "n_rows", "deaths", *joined)


def wiki_quality(spark: SparkSession, d: str) -> DataFrame:
    return W.quality(_incidents(spark, d))


def wiki_citations(spark: SparkSession, d: str) -> DataFrame:
    """References written as templates with the parameter names of two languages, and read back."""
    c = table(spark, d, "citations").dropDuplicates(["citation_id"]).withColumn("page", F.concat_ws("/", "source_page", F.floor(F.col("citation_id") / PAGE_ROWS).cast("string")))
    said = lambda name, col: F.concat(F.lit(f" |{name}="), F.replace(_markup(col), F.lit("|"), F.lit("&#124;")))
    local = F.col("citation_id") % 2 == 0
    body = F.concat(F.when(local, said("judul", "title")).otherwise(said("title", "title")), said("url", "url"), F.when(local, said("tanggal", "date")).otherwise(said("date", "date")), said("archive-url", "archive_url"))
    ref = F.concat(F.lit('<ref name="'), "ref_id", F.lit("~"), "citation_id", F.lit('">{{Cite web'), body, F.lit("}}</ref>"))
    made = c.where("ref_id is not null").groupBy("page").agg(F.array_join(F.collect_list(ref), " teks ").alias("wikitext"))
    read = made.lateralJoin(WikiCitations(F.col("wikitext").outer()))
    return read.select(F.split_part("ref_id", F.lit("~"), F.lit(2)).cast("long").alias("citation_id"), F.split_part("ref_id", F.lit("~"), F.lit(1)).alias("ref_id"), "template", "url", "title", "date", "archive_url")


def grid_carry(spark: SparkSession, d: str) -> DataFrame:
    """Nations by region as a wiki table whose regions are merged cells, read back with the value and its origin carried down."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    each = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    rows = F.transform("l", lambda s, k: F.concat(F.lit("|-\n"), F.when(k == 0, F.concat(F.lit('| rowspan="'), F.size("l"), F.lit('" | '), "r_name", F.lit("\n"))).otherwise(""), F.lit("| "), s["n_name"]))
    body = each.select("r_regionkey", F.array_join(rows, "\n").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "b"))), lambda s: s["b"]), "\n").alias("b"))
    page = body.select(F.concat(F.lit("{|\n! region\n! nation\n"), "b", F.lit("\n|}")).alias("w"))
    t = page.lateralJoin(WikiTable(F.col("w").outer(), F.lit("")))
    origin = F.split_part(F.col("origins")[0], F.lit(","), F.lit(1)).cast("long")
    return t.select(F.col("cells")[1].alias("n_name"), F.col("cells")[0].alias("region"), (origin + 1).alias("origin_row"), (origin == F.col("table_row")).alias("is_origin"))


def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """(outlet, page, origin, html): articles listed on pages of 50 ids, in the markup of one outlet or another."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    docs = table(spark, d, "documents").where("url <> '' and trim(title) <> ''").dropDuplicates(["doc_id"])
    docs = docs.withColumn("outlet", F.when(F.length("domain") % 2 == 0, "kompas").otherwise("liputan6")).withColumn("page", F.floor(F.col("doc_id") / 50).cast("int"))
    day = F.coalesce(F.regexp_extract("publish_date", r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    link = F.concat(F.lit("https://www.liputan6.example/read/"), "doc_id", F.lit("/"), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"))
    kompas = F.concat(F.lit('<div class="articleItem"><a class="article-link" href="'), esc(F.col("url")), F.lit('"><h2 class="articleTitle">'), esc(F.col("title")), F.lit('</h2></a><div class="articlePost-date">'), day, F.lit("</div></div>"))
    liputan = F.concat(F.lit('<article class="text-item" data-title="'), esc(F.col("title")), F.lit('"><a href="'), link, F.lit('">x</a><time datetime="'), day, F.lit('"></time></article>'))
    item = F.struct("doc_id", F.when(F.col("outlet") == "kompas", kompas).otherwise(liputan).alias("h"))
    made = docs.groupBy("outlet", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["h"]), "\n").alias("h"))
    return made.select("outlet", "page", F.concat(F.lit("page="), "page").alias("origin"), F.concat(F.lit("<html><body>"), "h", F.lit("</body></html>")).alias("html"))


def listing_items(spark: SparkSession, d: str) -> DataFrame:
    got = G.parse_listings(listing_pages(spark, d))
    return got.select("outlet", "origin", F.col("pos").cast("long").alias("pos"), F.md5("url").alias("url"), "title", F.coalesce("listed_date", F.lit("")).alias("listed_date"))


def feed_cut(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each feed when its walk ends at the first page that is off the topic or older than a day."""
    items = G.parse_listings(listing_pages(spark, d)).withColumn("page", F.regexp_extract("origin", "page=([0-9]+)", 1).cast("int"))
    return G.cut_feed(items, "siswa|santri|dapur|menu", "2025-06-01", 5, 0.1).groupBy("outlet").agg(F.count("*").alias("items"), F.max("page").cast("long").alias("last_page"))


QUERIES = {
    "wiki_report": wiki_report,
    "wiki_incidents": wiki_incidents,
    "wiki_events": wiki_events,
    "wiki_quality": wiki_quality,
    "wiki_citations": wiki_citations,
    "grid_carry": grid_carry,
    "listing_items": listing_items,
    "feed_cut": feed_cut,
}

_PAGE = f"source_page || '/' || (table_row // {PAGE_ROWS})::VARCHAR"
_O = P.ORACLES
_WIKI = f"""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id) AS rn_ FROM incidents) WHERE rn_ = 1),
    b AS (SELECT *, {_PAGE} AS page, row_number() OVER (PARTITION BY {_PAGE} ORDER BY table_row, incident_id) AS r FROM one),
    o AS (SELECT *, min(r) OVER (PARTITION BY page, event_id) AS o, first(incident_id) OVER (PARTITION BY page, event_id ORDER BY r) AS shows, first(symptomatic_raw) OVER (PARTITION BY page, event_id ORDER BY r) AS figure FROM b),
    cc AS ({_O["count_cells"]}), dc AS ({_O["date_cells"]}), vl AS ({_O["venue_levels"]}), al AS ({_O["alias_lookup"]}),
    u AS (SELECT incident_id, string_agg(best, ' ' ORDER BY pos, citation_id) AS urls FROM (SELECT incident_id, generate_subscripts(ref_ids, 1) AS pos, regexp_replace(unnest(ref_ids), '\\.[0-9]+$', '') AS ref FROM one WHERE len(ref_ids) > 0)
          JOIN (SELECT DISTINCT regexp_replace(ref_id, '\\.[0-9]+$', '') AS ref, citation_id, coalesce(nullif(archive_url, ''), nullif(url, '')) AS best FROM citations) USING (ref) WHERE best IS NOT NULL GROUP BY incident_id),
    pv AS (SELECT lower(trim(provinsi)) AS k, min(provinsi) AS province FROM kabkota_codes WHERE provinsi <> '' GROUP BY 1),
    w AS (SELECT o.page, r, o, format('{{}}#r{{:04d}}', page, r) AS incident_id, format('{{}}#e{{:04d}}', page, o) AS event_id, start_iso AS date_iso, end_iso AS date_end_iso, precision AS date_precision, pv.province, al.kode, al.how AS kode_match, vl.venue, vl.level AS venue_level,
        cc.kind, cc.total AS symptomatic, cc.minimum AS symptomatic_min, cc.maximum AS symptomatic_max, CASE WHEN r = o THEN cc.total END AS symptomatic_counted, coalesce(cc.subjects, '') AS subjects, coalesce(urls, '') AS urls,
        try_cast(replace(regexp_extract(deaths_raw, '(?i)^\\s*([0-9.]+)\\s*(?:{P._S})\\s*$', 1), '.', '') AS BIGINT) AS deaths_counted,
        list_filter([CASE WHEN start_iso IS NULL THEN 'no_date' END, CASE WHEN precision = 'month' THEN 'month_precision_only' END, CASE WHEN start_iso <> end_iso THEN 'date_range' END, CASE WHEN pv.province IS NULL THEN 'unknown_province' END,
            CASE WHEN trim(coalesce(kabkota, ''), ' ' || chr(160)) = '' THEN 'kabkota_unlinked' END, CASE WHEN al.how = 'none' THEN 'kabkota_no_kode' END, CASE WHEN kc.provinsi <> pv.province THEN 'kabkota_province_mismatch' END, CASE WHEN vl.venue IS NULL THEN 'no_venue' END,
            CASE WHEN cc.total IS NOT NULL AND regexp_matches(regexp_replace(figure, '(?i)(?:[0-9]{{1,3}}(?:\\.[0-9]{{3}})+|[0-9]+)\\s*(?:{P._S})\\b', ' ', 'g'), '(?i)\\b(?:{P._S})\\b') THEN 'unnumbered_subject' END,
            CASE WHEN cc.kind IN ('unreported', 'vague', 'unparsed') THEN 'count_' || cc.kind END, CASE WHEN r <> o THEN 'count_shared_across_rows' END, CASE WHEN urls IS NULL THEN 'no_source_url' END], lambda x: x IS NOT NULL) AS fl
        FROM o JOIN cc ON cc.incident_id = o.shows JOIN dc ON dc.incident_id = o.incident_id JOIN vl ON vl.incident_id = o.incident_id JOIN al ON al.incident_id = o.incident_id
        LEFT JOIN u ON u.incident_id = o.incident_id LEFT JOIN pv ON pv.k = lower(trim(province_raw)) LEFT JOIN kabkota_codes kc ON kc.kode = al.kode)"""

_ITEMS = r"""WITH t AS (SELECT DISTINCT doc_id, url AS u, trim(regexp_replace(title, '[\s\x{00a0}]+', ' ', 'g')) AS title, title AS raw, coalesce(regexp_extract(publish_date, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS listed_date,
            CASE WHEN length(domain) % 2 = 0 THEN 'kompas' ELSE 'liputan6' END AS outlet, doc_id // 50 AS page FROM documents WHERE url <> '' AND trim(title) <> ''),
        items AS (SELECT outlet, page, 'page=' || page AS origin, row_number() OVER (PARTITION BY outlet, page ORDER BY doc_id) - 1 AS pos,
            CASE outlet WHEN 'kompas' THEN u ELSE 'https://www.liputan6.example/read/' || doc_id || '/' || regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g') END AS link, title, listed_date FROM t)"""

ORACLES = {
    "listing_items": f"{_ITEMS} SELECT outlet, origin, pos, md5(link) AS url, title, listed_date FROM items",
    "feed_cut": f"""{_ITEMS}, p AS (SELECT outlet, page, count(*) AS n, avg(CASE WHEN regexp_matches(title, '(?i)siswa|santri|dapur|menu') THEN 1 ELSE 0 END) AS topical, max(nullif(listed_date, '')) AS newest FROM items GROUP BY ALL),
        e AS (SELECT outlet, min(page) FILTER (n >= 5 AND topical < 0.1) AS away, min(page) FILTER (newest < '2025-06-01') AS old FROM p GROUP BY outlet)
        SELECT outlet, count(*) AS items, max(page) AS last_page FROM items JOIN e USING (outlet) WHERE (away IS NULL OR page < away) AND (old IS NULL OR page <= old) GROUP BY outlet""",
    "wiki_report": f"""SELECT page, count(*) + 2 AS rendered, count(*) AS kept, 1 AS placeholders, coalesce(sum(symptomatic), 0)::BIGINT::VARCHAR AS total
        FROM (SELECT *, {_PAGE} AS page, row_number() OVER (PARTITION BY incident_id) AS rn_ FROM incidents) WHERE rn_ = 1 GROUP BY page""",
    "wiki_incidents": f"""{_WIKI} SELECT incident_id, event_id, date_iso, date_end_iso, date_precision, province, kode, kode_match, venue, venue_level, kind, symptomatic, symptomatic_min, symptomatic_max, symptomatic_counted, deaths_counted,
        subjects, urls, array_to_string(fl, '|') AS flags FROM w""",
    "wiki_events": f"""{_WIKI}, f AS (SELECT event_id, string_agg(DISTINCT x, '|' ORDER BY x) AS flags FROM (SELECT event_id, unnest(fl) AS x FROM w) GROUP BY event_id),
        s AS (SELECT event_id, string_agg(DISTINCT x, '|' ORDER BY x) AS source_urls FROM (SELECT event_id, unnest(string_split(urls, ' ')) AS x FROM w WHERE urls <> '') GROUP BY event_id)
        SELECT w.event_id, min(date_iso) AS date_start, max(date_end_iso) AS date_end, arg_min_null(province, r) AS province, arg_min_null(kode, r) AS kode, arg_min_null(symptomatic, r) AS symptomatic, arg_min_null(kind, r) AS kind, count(*) AS n_rows,
               nullif(sum(coalesce(deaths_counted, 0))::BIGINT, 0) AS deaths, coalesce(string_agg(venue, '|' ORDER BY r), '') AS venues, coalesce(string_agg(DISTINCT venue_level, '|' ORDER BY venue_level), '') AS venue_levels,
               coalesce(any_value(source_urls), '') AS source_urls, string_agg(incident_id, '|' ORDER BY r) AS incident_ids, coalesce(any_value(flags), '') AS flags FROM w LEFT JOIN f USING (event_id) LEFT JOIN s USING (event_id) GROUP BY w.event_id""",
    "wiki_quality": f"""{_WIKI}, g AS (SELECT count(*) AS n, count(DISTINCT event_id) AS e, sum(symptomatic_counted)::BIGINT AS c, sum(symptomatic)::BIGINT AS a, min(date_iso) AS d0, max(date_iso) AS d1, count(*) FILTER (kode <> '') AS k, sum(deaths_counted)::BIGINT AS x FROM w)
        SELECT 'rows' AS name, n::VARCHAR AS value FROM g UNION ALL SELECT 'events', e::VARCHAR FROM g UNION ALL SELECT 'counted', c::VARCHAR FROM g UNION ALL SELECT 'naive', a::VARCHAR FROM g UNION ALL SELECT 'inflation', round(a / c, 2)::VARCHAR FROM g
        UNION ALL SELECT 'first date', d0 FROM g UNION ALL SELECT 'last date', d1 FROM g UNION ALL SELECT 'coded', k::VARCHAR FROM g UNION ALL SELECT 'deaths', x::VARCHAR FROM g
        UNION ALL SELECT 'flag ' || x, count(*)::VARCHAR FROM (SELECT unnest(fl) AS x FROM w) GROUP BY x""",
    "wiki_citations": """SELECT DISTINCT citation_id, ref_id, 'cite web' AS template, trim(coalesce(url, '')) AS url, trim(replace(coalesce(title, ''), '|', '&#124;')) AS title, trim(replace(coalesce(date, ''), '|', '&#124;')) AS date, trim(coalesce(archive_url, '')) AS archive_url
        FROM citations WHERE ref_id IS NOT NULL""",
    "grid_carry": """WITH r AS (SELECT n_name, r_name, r_regionkey, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT n_name, r_name AS region, min(k) OVER (PARTITION BY r_regionkey) AS origin_row, k = min(k) OVER (PARTITION BY r_regionkey) AS is_origin FROM r""",
}
