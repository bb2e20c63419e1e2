"""From the rows of a wiki table to incidents and events: filters, normalisation with flags, the full event record, and the report on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.functions import cells as C
from kelindan.functions import text as T
from kelindan.operators import incidents as I
from kelindan.sources.wikitext import WikiTable

#: Columns of the table, in order.
COLUMNS = ("date", "province", "kabkota", "venue", "symptomatic", "deaths", "ref")
#: Other names of provinces than those of the reference list, in lower case.
PROVINCE_ALIASES: dict[str, str] = {}


def read_pages(pages: DataFrame, page: str, wikitext: str, section: str) -> DataFrame:
    """(page, table_row, one column per table column, province_link, kabkota_link, ref_ids, origin_symptomatic, origin_deaths) of every displayed row of the first table
    below a heading that holds ``section``. Merged cells are carried down; origins are the rows in which cells were written. Markup that cannot be read without guessing fails."""
    rows = pages.select(page, wikitext).lateralJoin(WikiTable(F.col(wikitext).outer(), F.lit(section)))
    at = lambda c: COLUMNS.index(c)
    origin = lambda c: F.split_part(F.col("origins")[at(c)], F.lit(","), F.lit(1)).cast("int")
    texts = [F.col("cells")[k].alias(c) for k, c in enumerate(COLUMNS)]
    links = [F.col("links")[at(c)].alias(f"{c}_link") for c in ("province", "kabkota")]
    return rows.select(page, "table_row", *texts, *links, "ref_ids", *[origin(c).alias(f"origin_{c}") for c in ("symptomatic", "deaths")])


def is_total() -> Column:
    """The page's own sum."""
    return F.upper("date") == "TOTAL"


def is_placeholder() -> Column:
    """A province that is listed without incidents."""
    return ~is_total() & (F.concat("date", "venue", "symptomatic", "ref") == "") & (F.size("ref_ids") == 0)


def page_report(rows: DataFrame, page: str) -> DataFrame:
    """(page, rendered, kept, placeholders, total): what a page shows and what of it are incidents."""
    return rows.groupBy(page).agg(
        F.count("*").alias("rendered"), F.count_if(~is_total() & ~is_placeholder()).alias("kept"), F.count_if(is_placeholder()).alias("placeholders"), F.max(F.when(is_total(), F.col("symptomatic"))).alias("total")
    )


def canonical_province(names: list[Column], provinces: DataFrame) -> tuple[DataFrame, list[Column]]:
    """A lookup of provinces by name in lower case, with other names, and the keys of ``names`` to join it by; the first of them that is known counts."""
    known = provinces.where("provinsi <> ''").groupBy(F.lower(F.trim("provinsi")).alias("key")).agg(F.min("provinsi").alias("canonical"))
    if PROVINCE_ALIASES:
        other = F.create_map(*[F.lit(x) for kv in PROVINCE_ALIASES.items() for x in kv])
        known = known.unionByName(provinces.sparkSession.range(1).select(F.explode(other).alias("key", "canonical")))
    return known, [F.lower(F.trim(n)) for n in names]


def normalise(rows: DataFrame, page: str, citations: DataFrame, codes: DataFrame) -> DataFrame:
    """Incidents of the rows that are neither totals nor placeholders, with flags of what is missing, vague or at odds. ``citations``: (ref_id, citation_id, url, archive_url);
    ``codes``: (kode, nama, nama_lain, provinsi)."""
    r = rows.where(~is_total() & ~is_placeholder())
    name = lambda row, mark: F.format_string(f"%s#{mark}%04d", page, row)
    r = r.select("*", name("table_row", "r").alias("incident_id"), name("origin_symptomatic", "e").alias("event_id"), name("origin_deaths", "d").alias("deaths_cell"))
    r = r.select("*", C.date_cell(F.col("date")).alias("d"), C.count_cell(F.col("symptomatic")).alias("c"), C.count_cell(F.col("deaths")).alias("x"))
    r = r.withColumn("place", F.coalesce(F.nullif("kabkota_link", F.lit("")), F.nullif("kabkota", F.lit(""))))
    provinces, (by_link, by_text) = canonical_province([F.col("province_link"), F.col("province")], codes)
    r = r.join(provinces.select(F.col("key").alias("k1"), F.col("canonical").alias("c1")), by_link == F.col("k1"), "left")
    r = r.join(provinces.select(F.col("key").alias("k2"), F.col("canonical").alias("c2")), by_text == F.col("k2"), "left").withColumn("canonical", F.coalesce("c1", "c2"))
    r = I.lookup(r, "place", codes).join(codes.select("kode", F.col("provinsi").alias("of_code")), "kode", "left")
    # A figure that is written once counts on the first of the rows that show it: the least row of its cell, by an aggregate.
    for cell, first in (("event_id", "first_shown"), ("deaths_cell", "first_deaths")):
        r = r.join(r.groupBy(cell).agg(F.min("table_row").alias(first)), cell)
    urls = _urls(r.select("incident_id", "ref_ids"), citations)
    r = r.join(urls, "incident_id", "left")
    shared = F.col("table_row") != F.col("first_shown")
    venue = I.named_venue(F.col("venue"))
    flags = [
        ("no_date", F.col("d").isNull()),
        ("month_precision_only", F.col("d.precision") == "month"),
        ("date_range", F.col("d.start") != F.col("d.end")),
        ("unknown_province", F.col("canonical").isNull()),
        ("kabkota_unlinked", F.col("kabkota_link") == ""),
        ("kabkota_no_kode", F.col("how") == "none"),
        ("kabkota_province_mismatch", F.col("canonical") != F.col("of_code")),
        ("no_venue", venue.isNull()),
        ("unnumbered_subject", F.col("c.unnumbered")),
        *[(f"count_{k}", F.col("c.kind") == k) for k in ("unreported", "vague", "unparsed")],
        ("count_shared_across_rows", shared),
        ("no_source_url", F.coalesce(F.size("urls"), F.lit(0)) <= 0),
    ]
    return r.select(
        "incident_id", page, "table_row", "event_id", F.col("d.start").alias("date_iso"), F.col("d.end").alias("date_end_iso"), F.col("d.precision").alias("date_precision"), F.col("canonical").alias("province"),
        F.col("place").alias("kabkota"), T.place_type(F.col("place")).alias("kabkota_type"), "kode", F.col("how").alias("kode_match"), venue.alias("venue"), I.venue_level(F.col("venue")).alias("venue_level"),
        F.col("c.kind").alias("kind"), F.col("c.total").alias("symptomatic"), F.col("c.minimum").alias("symptomatic_min"), F.col("c.maximum").alias("symptomatic_max"), F.col("c.by_subject").alias("by_subject"),
        F.when(~shared, F.col("c.total")).alias("symptomatic_counted"), F.when(F.col("table_row") == F.col("first_deaths"), F.col("x.total")).alias("deaths_counted"), "ref_ids",
        F.coalesce("urls", F.array().cast("array<string>")).alias("source_urls"), F.array_compact(F.array(*[F.when(test, flag) for flag, test in flags])).alias("flags"),
    )


def _urls(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """(incident_id, urls): what is cited under the references of a row, in the order in which it cites them; second templates of a reference count for it."""
    best = F.coalesce(F.nullif("archive_url", F.lit("")), F.nullif("url", F.lit("")))
    cites = citations.select(F.regexp_replace("ref_id", r"\.[0-9]+$", "").alias("ref"), "citation_id", best.alias("best")).where("best is not null").distinct()
    refs = rows.select("incident_id", F.posexplode("ref_ids").alias("pos", "ref")).withColumn("ref", F.regexp_replace("ref", r"\.[0-9]+$", ""))
    listed = F.array_sort(F.collect_list(F.struct("pos", "citation_id", "best")))
    return refs.join(cites, "ref").groupBy("incident_id").agg(F.transform(listed, lambda s: s["best"]).alias("urls"))


def collapse(incidents: DataFrame) -> DataFrame:
    """One record per event: the rows that share one written figure. Dates span all rows, figures and place are those of the first row, lists and flags are of all."""
    first = lambda c: F.min_by(c, "table_row").alias(c)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("table_row", c)))), lambda s: s[c]).alias(f"{c}s")
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    kept = ("date_precision", "province", "kabkota", "kabkota_type", "kode", "symptomatic", "symptomatic_min", "symptomatic_max", "kind", "by_subject")
    return incidents.groupBy("event_id").agg(
        F.min("date_iso").alias("date_start"), F.max("date_end_iso").alias("date_end"), *[first(c) for c in kept], F.count("*").alias("n_rows"), in_order("venue"), F.array_sort(F.collect_set("venue_level")).alias("venue_levels"),
        F.nullif(F.sum(F.coalesce("deaths_counted", F.lit(0))), F.lit(0).cast("long")).alias("deaths"), distinct("source_urls"), in_order("incident_id"), distinct("flags"),
    )


def quality(incidents: DataFrame) -> DataFrame:
    """(name, value) of the report on a run: rows, events, counted and naive sums and their ratio, span of dates, coded places, deaths, and how often each flag stands."""
    facts = incidents.agg(
        F.count("*").cast("string").alias("rows"), F.countDistinct("event_id").cast("string").alias("events"), F.sum("symptomatic_counted").cast("string").alias("counted"), F.sum("symptomatic").cast("string").alias("naive"),
        F.round(F.try_divide(F.sum("symptomatic"), F.sum("symptomatic_counted")), 2).cast("string").alias("inflation"), F.min("date_iso").alias("first date"), F.max("date_iso").alias("last date"),
        F.count_if(F.col("kode") != "").cast("string").alias("coded"), F.sum("deaths_counted").cast("string").alias("deaths"),
    )
    named = facts.unpivot([], facts.columns, "name", "value")
    flags = incidents.select(F.explode("flags").alias("flag")).groupBy(F.concat(F.lit("flag "), "flag").alias("name")).agg(F.count("*").cast("string").alias("value"))
    return named.unionByName(flags)
