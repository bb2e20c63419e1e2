"""Queries on incident rows, events and cells, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.functions import cells
from kelindan.functions import text as T
from kelindan.operators import incidents as I
from kelindan.session import table


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "incidents").dropDuplicates(["incident_id"])


def counted_once(spark: SparkSession, d: str) -> DataFrame:
    shown = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return I.counted_totals(shown, ["o_orderkey"], "o_totalprice")


def incident_counted_once(spark: SparkSession, d: str) -> DataFrame:
    rows = I.counted_once(_incidents(spark, d), ["source_page", "event_id"], ["table_row", "incident_id"], "symptomatic")
    return rows.select("incident_id", F.col("counted").cast("long").alias("counted"), (F.col("counted").isNull() & F.col("symptomatic").isNotNull()).alias("shared"))


def qc_report(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("event_id").alias("n_events"),
        F.sum("symptomatic_counted").alias("counted"),
        F.sum("symptomatic").alias("naive"),
        F.min("date_iso").alias("first_date"),
        F.max("date_end_iso").alias("last_date"),
        F.count_if(F.col("kabkota_kode") != "").alias("coded"),
        F.count_if(F.col("date_precision") == "month").alias("month_only"),
    )


def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def row_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = _incidents(spark, d)
    flags = F.array_compact(
        F.array(
            F.when(F.col("date_iso").isNull(), "no_date"),
            F.when(F.col("date_precision") == "month", "month_precision_only"),
            F.when(F.col("date_iso") != F.col("date_end_iso"), "date_range"),
            F.when(F.col("province").isNull(), "unknown_province"),
            F.when(F.coalesce("kabkota_kode", F.lit("")) == "", "kabkota_no_kode"),
            F.when(I.named_venue(F.col("venue_raw")).isNull(), "no_venue"),
            F.when(F.coalesce(F.size("source_urls"), F.lit(0)) <= 0, "no_source_url"),
        )
    )
    return rows.select("incident_id", F.array_join(flags, "|").alias("flags"))


def running_total_reaches(spark: SparkSession, d: str) -> DataFrame:
    return I.reached(table(spark, d, "orders"), "o_orderdate", "o_totalprice", 10_000_000)


def venue_levels(spark: SparkSession, d: str) -> DataFrame:
    return _incidents(spark, d).select("incident_id", I.venue_level(F.col("venue_raw")).alias("level"), I.named_venue(F.col("venue_raw")).alias("venue"))


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    return I.lookup(_incidents(spark, d).select("incident_id", "kabkota"), "kabkota", table(spark, d, "kabkota_codes")).select("incident_id", "kode", "how")


def place_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("nama")
    return table(spark, d, "kabkota_codes").select(
        "kode", T.place_type(name).alias("kind"), T.place_name(name).alias("bare"), T.norm_region(name).alias("key"), F.array_join(T.place_forms(T.place_name(name)), "|").alias("forms")
    )


def count_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _incidents(spark, d).select("incident_id", cells.count_cell(F.col("symptomatic_raw")).alias("c"))
    subjects = F.array_join(F.transform(F.map_entries("c.by_subject"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return c.select("incident_id", "c.kind", F.col("c.total").cast("long").alias("total"), F.col("c.minimum").cast("long").alias("minimum"), F.col("c.maximum").cast("long").alias("maximum"), subjects.alias("subjects"))


def date_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _incidents(spark, d).select("incident_id", cells.date_cell(F.col("date_raw")).alias("c"))
    return c.select("incident_id", F.col("c.start").alias("start_iso"), F.col("c.end").alias("end_iso"), F.col("c.precision").alias("precision"))


def month_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _incidents(spark, d).select("incident_id", T.first_day(F.col("date_iso")).alias("a"), T.final_day(F.col("date_end_iso")).alias("b")).where("a is not null and b is not null")
    return rows.select("incident_id", F.date_sub("a", 1).cast("string").alias("opens"), F.date_add(F.greatest("a", "b"), 30).cast("string").alias("closes"))


def earliest_events(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 events by date, undated ones last, then by id."""
    e = _incidents(spark, d).groupBy("event_id").agg(F.min("date_iso").alias("date_start"))
    return e.orderBy(F.coalesce("date_start", F.lit("9999")), "event_id").limit(25)


def centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    from kelindan.functions.stats import haversine_km

    codes = table(spark, d, "kabkota_codes").select(F.col("kode").alias("kabkota_kode"), "lat", "lng")
    rows = _incidents(spark, d).select("incident_id", "kabkota_kode", "kabkota_lat", "kabkota_lng").where("kabkota_kode <> ''").join(codes, "kabkota_kode")
    return rows.select("incident_id", F.round(haversine_km(F.col("kabkota_lat"), F.col("kabkota_lng"), F.col("lat"), F.col("lng")), 3).alias("km"))


QUERIES = {
    "counted_once": counted_once,
    "incident_counted_once": incident_counted_once,
    "events_collapse": lambda spark, d: I.events(table(spark, d, "incidents")),
    "qc_report": qc_report,
    "flag_histogram": flag_histogram,
    "row_flags": row_flags,
    "running_total_reaches": running_total_reaches,
    "venue_levels": venue_levels,
    "alias_lookup": alias_lookup,
    "place_parts": place_parts,
    "count_cells": count_cells,
    "date_cells": date_cells,
    "month_windows": month_windows,
    "earliest_events": earliest_events,
    "centroid_distance": centroid_distance,
}

_ONE = "WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id) AS rn_ FROM incidents) WHERE rn_ = 1)"
_MONTHS = "map {" + ", ".join(f"'{m}': {n}" for m, n in cells.MONTHS.items()) + "}"
_SUBJECTS = "map {" + ", ".join(f"'{s}': '{c}'" for s, c in cells.SUBJECTS.items()) + "}"
_S = "|".join(cells.SUBJECTS)
_M = "|".join(sorted(cells.MONTHS, key=lambda m: (-len(m), m)))

ORACLES = {
    "counted_once": """
        SELECT round(sum(o_totalprice), 2) AS naive_sum, round((SELECT sum(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), 2) AS counted_sum,
               round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), 4) AS inflation
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "incident_counted_once": f"""{_ONE}, f AS (SELECT *, row_number() OVER (PARTITION BY source_page, event_id ORDER BY table_row, incident_id) AS k FROM i)
        SELECT incident_id, CASE WHEN k = 1 THEN symptomatic::BIGINT END AS counted, k > 1 AND symptomatic IS NOT NULL AS shared FROM f""",
    "events_collapse": f"""{_ONE}
        SELECT event_id, min(date_iso) AS date_start, max(date_end_iso) AS date_end, arg_min_null(province, (table_row, incident_id)) AS province,
               arg_min_null(kabkota, (table_row, incident_id)) AS kabkota, arg_min_null(symptomatic, (table_row, incident_id)) AS symptomatic, count(*) AS n_rows,
               coalesce(string_agg(venue, '|' ORDER BY table_row, incident_id), '') AS venues,
               coalesce(string_agg(DISTINCT venue_level, '|' ORDER BY venue_level), '') AS venue_levels,
               nullif(sum(coalesce(deaths_counted, 0))::BIGINT, 0) AS deaths
        FROM i GROUP BY event_id""",
    "qc_report": f"""{_ONE}
        SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_events, sum(symptomatic_counted)::BIGINT AS counted, sum(symptomatic)::BIGINT AS naive, min(date_iso) AS first_date,
               max(date_end_iso) AS last_date, count(*) FILTER (kabkota_kode <> '') AS coded, count(*) FILTER (date_precision = 'month') AS month_only FROM i""",
    "flag_histogram": f"{_ONE} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM i) GROUP BY flag",
    "row_flags": f"""{_ONE}
        SELECT incident_id, array_to_string(list_filter([CASE WHEN date_iso IS NULL THEN 'no_date' END, CASE WHEN date_precision = 'month' THEN 'month_precision_only' END,
               CASE WHEN date_iso <> date_end_iso THEN 'date_range' END, CASE WHEN province IS NULL THEN 'unknown_province' END,
               CASE WHEN coalesce(kabkota_kode, '') = '' THEN 'kabkota_no_kode' END,
               CASE WHEN venue_raw IS NULL OR trim(venue_raw) = '' OR regexp_matches(venue_raw, '(?i)tidak\\s+(?:disebutkan|diumumkan)|spesifik') THEN 'no_venue' END,
               CASE WHEN coalesce(len(source_urls), 0) = 0 THEN 'no_source_url' END], lambda x: x IS NOT NULL), '|') AS flags FROM i""",
    "running_total_reaches": """
        WITH d AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(20,2)) AS v FROM orders GROUP BY 1), r AS (SELECT d, sum(v) OVER (ORDER BY d) AS total FROM d)
        SELECT min(d)::VARCHAR AS reached_on, min(total)::DOUBLE AS total FROM r WHERE total >= 10000000""",
    "venue_levels": f"""{_ONE}
        SELECT incident_id, CASE WHEN regexp_matches(trim(venue_raw), '^(?i:tk\\w*|paud|ra|kb)\\b') THEN 'early_childhood' WHEN regexp_matches(trim(venue_raw), '^(?i:sd\\w*|mi[nsm]?)\\b') THEN 'primary'
                 WHEN regexp_matches(trim(venue_raw), '^(?i:(?:smp|mts)\\w*)') THEN 'junior_secondary' WHEN regexp_matches(trim(venue_raw), '^(?i:sm[ak]\\w*|ma[nsk]?)\\b') THEN 'senior_secondary'
                 WHEN regexp_matches(trim(venue_raw), '^(?i:slb)\\b') THEN 'special_needs' WHEN regexp_matches(trim(venue_raw), '^(?i:pesantren|ponpes|pondok)\\b') THEN 'pesantren'
                 WHEN regexp_matches(trim(venue_raw), '^(?i:p[ao]syandu)\\b') THEN 'community_health_post' END AS level,
               CASE WHEN trim(venue_raw) <> '' AND NOT regexp_matches(venue_raw, '(?i)tidak\\s+(?:disebutkan|diumumkan)|spesifik') THEN trim(venue_raw) END AS venue FROM i""",
    "alias_lookup": f"""{_ONE}, n AS (SELECT incident_id, lower(trim(regexp_replace(kabkota, '[\\s\\x{{00a0}}]+', ' ', 'g'))) AS k FROM i),
        e AS (SELECT lower(nama) AS k, min(kode) AS kode FROM kabkota_codes GROUP BY 1),
        o AS (SELECT kode, split_part(nama, ' ', 1) AS t, trim(unnest(string_split(nama_lain, ';'))) AS o FROM kabkota_codes),
        a AS (SELECT k, min(kode) AS kode FROM (SELECT lower(o) AS k, kode FROM o UNION ALL SELECT lower(t || ' ' || o), kode FROM o) WHERE k <> '' GROUP BY k)
        SELECT incident_id, coalesce(e.kode, a.kode, '') AS kode, CASE WHEN e.kode IS NOT NULL THEN 'exact' WHEN a.kode IS NOT NULL THEN 'alias' ELSE 'none' END AS how
        FROM n LEFT JOIN e USING (k) LEFT JOIN a USING (k)""",
    "place_parts": """
        WITH p AS (SELECT kode, nama, lower(regexp_extract(trim(nama), '(?i)^(kabupaten|kota) +', 1)) AS kind,
                          regexp_replace(regexp_replace(trim(nama), '(?i)^(kabupaten|kota) +', ''), '^Administrasi ', '') AS bare FROM kabkota_codes),
        b AS (SELECT *, trim(regexp_replace(strip_accents(lower(bare)), '[^a-z0-9]+', ' ', 'g')) AS base FROM p)
        SELECT kode, nullif(kind, '') AS kind, bare, regexp_replace(regexp_replace(lower(nama), '^\\s*(?:kabupaten|kab\\.?|kota)\\s+', ''), '[^a-z0-9]', '', 'g') AS key,
               CASE WHEN position(' ' IN base) > 0 THEN ' ' || base || ' | ' || replace(base, ' ', '') || ' ' ELSE ' ' || base || ' ' END AS forms FROM b""",
    "count_cells": f"""{_ONE}, t AS (SELECT incident_id, trim(coalesce(symptomatic_raw, '')) AS t FROM i),
        x AS (SELECT *, list_transform(regexp_extract_all(t, '(?i)([0-9]{{1,3}}(?:\\.[0-9]{{3}})+|[0-9]+)\\s*(?:{_S})\\b', 1), lambda v: replace(v, '.', '')::BIGINT) AS nums,
                     list_transform(regexp_extract_all(t, '(?i)(?:[0-9]{{1,3}}(?:\\.[0-9]{{3}})+|[0-9]+)\\s*({_S})\\b', 1), lambda s: {_SUBJECTS}[lower(s)]) AS subs,
                     lower(regexp_extract(t, '(?i)\\b(belasan|puluhan|ratusan|ribuan)\\s+(?:{_S})\\b', 1)) AS vague FROM t),
        k AS (SELECT *, upper(t) LIKE 'TBA%' OR t = '' AS blank, list_sum(nums)::BIGINT AS s FROM x)
        SELECT incident_id, CASE WHEN blank THEN 'unreported' WHEN len(nums) > 0 THEN CASE WHEN regexp_matches(t, '^(?i:±|~|sekitar\\b)') THEN 'approx'
                 WHEN regexp_matches(t, '^(?i:>|≥|lebih dari\\b|minimal\\b)') THEN 'lower_bound' ELSE 'exact' END WHEN vague <> '' THEN 'vague' ELSE 'unparsed' END AS kind,
               CASE WHEN NOT blank AND len(nums) > 0 THEN s END AS total,
               CASE WHEN NOT blank AND len(nums) > 0 THEN s ELSE map {{'belasan': 11, 'puluhan': 20, 'ratusan': 100, 'ribuan': 1000}}[vague] END::BIGINT AS minimum,
               CASE WHEN NOT blank AND len(nums) > 0 THEN CASE WHEN NOT regexp_matches(t, '^(?i:>|≥|lebih dari\\b|minimal\\b)') THEN s END
                 ELSE map {{'belasan': 19, 'puluhan': 99, 'ratusan': 999, 'ribuan': 9999}}[vague] END::BIGINT AS maximum,
               CASE WHEN NOT blank AND len(nums) > 0 THEN array_to_string(list_transform(list_sort(list_distinct(subs)), lambda u: u || '=' ||
                 list_sum(list_transform(list_filter(list_zip(subs, nums), lambda z: z[1] = u), lambda z: z[2]))::BIGINT::VARCHAR), '|') END AS subjects
        FROM k""",
    "date_cells": f"""{_ONE}, t AS (SELECT incident_id, coalesce(date_raw, '') AS t FROM i),
        x AS (SELECT incident_id, t, regexp_extract(t, '(?i)\\b([0-9]{{1,2}})(?:\\s+({_M}))?\\s*(?:s/?d\\.?|-|–)\\s*([0-9]{{1,2}})\\s+({_M})\\s+([0-9]{{4}})\\b', ['d1', 'm1', 'd2', 'm2', 'y']) AS r,
                     regexp_extract(t, '(?i)\\b(?:([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})|([0-9]{{1,2}})\\s+({_M})\\s+([0-9]{{4}})|({_M})\\s+([0-9]{{4}}))\\b',
                                    ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS g FROM t),
        y AS (SELECT incident_id, CASE WHEN r.y <> '' THEN r.y || '-' || lpad(({_MONTHS}[lower(CASE WHEN r.m1 <> '' THEN r.m1 ELSE r.m2 END)])::VARCHAR, 2, '0') || '-' || lpad(r.d1, 2, '0') END AS s1,
                     CASE WHEN r.y <> '' THEN r.y || '-' || lpad(({_MONTHS}[lower(r.m2)])::VARCHAR, 2, '0') || '-' || lpad(r.d2, 2, '0') END AS s2,
                     CASE WHEN g.c <> '' THEN g.c || '-' || lpad(g.b, 2, '0') || '-' || lpad(g.a, 2, '0') WHEN g.f <> '' THEN g.f || '-' || lpad(({_MONTHS}[lower(g.e)])::VARCHAR, 2, '0') || '-' || lpad(g.d, 2, '0')
                          WHEN g.h <> '' THEN g.h || '-' || lpad(({_MONTHS}[lower(g.g)])::VARCHAR, 2, '0') END AS one FROM x)
        SELECT incident_id, coalesce(s1, one) AS start_iso, coalesce(s2, one) AS end_iso, CASE WHEN s1 IS NOT NULL OR length(one) = 10 THEN 'day' WHEN one IS NOT NULL THEN 'month' END AS precision FROM y""",
    "month_windows": f"""{_ONE}, t AS (SELECT incident_id, try_cast(CASE WHEN length(date_iso) = 7 THEN date_iso || '-01' ELSE substr(date_iso, 1, 10) END AS DATE) AS a,
                     CASE WHEN length(date_end_iso) = 7 THEN last_day(try_cast(date_end_iso || '-01' AS DATE)) ELSE try_cast(substr(date_end_iso, 1, 10) AS DATE) END AS b FROM i)
        SELECT incident_id, (a - 1)::DATE::VARCHAR AS opens, (greatest(a, b) + 30)::DATE::VARCHAR AS closes FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
    "earliest_events": "SELECT event_id, min(date_iso) AS date_start FROM incidents GROUP BY event_id ORDER BY coalesce(min(date_iso), '9999'), event_id LIMIT 25",
    "centroid_distance": f"""{_ONE}
        SELECT incident_id, round(12742.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - kabkota_lat) / 2), 2) + cos(radians(kabkota_lat)) * cos(radians(lat)) * pow(sin(radians(lng - kabkota_lng) / 2), 2)))), 3) AS km
        FROM i JOIN kabkota_codes ON kode = kabkota_kode WHERE kabkota_kode <> ''""",
}
