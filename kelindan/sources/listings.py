"""Listing pages of topic feeds: links, titles and dates by a rule per outlet, all in built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.functions.text import strip_tags

# Short month names of listing dates.
SHORT_MONTHS = {"jan": 1, "feb": 2, "peb": 2, "mar": 3, "apr": 4, "mei": 5, "may": 5, "jun": 6, "jul": 7, "agu": 8, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "nop": 11, "des": 12, "dec": 12}


@dataclass(frozen=True)
class Rule:
    """How one outlet writes an item: what begins a block, and where link, title and date stand in it. ``date`` captures an ISO day, digits of a day, or text
    with a day written out."""

    block: str
    href: str
    title: str
    date: str
    only: str = ""


# Rules by outlet.
RULES = {
    "detik": Rule("<article", r'href="([^"]+)"', r'alt="([^"]*)"', r"(?s)(.*)"),
    "antara": Rule('<div class="card__post card__post-list', r'<h2 class="h5"><a href="([^"]+)"', r'(?s)<h2 class="h5"><a href="[^"]+"[^>]*>(.*?)</a>', r"(?s)(.*)", "/berita/"),
    "kompas": Rule('<div class="articleItem">', r'class="article-link" href="([^"]+)"', r'(?s)<h2 class="articleTitle">(.*?)</h2>', r'(?s)<div class="articlePost-date">(.*?)</div>'),
    "cnn": Rule("<article", r'href="(https://[^"/]+/[a-z-]+/[0-9]{14}-[^"]+)"', r"(?s)<h2[^>]*>(.*?)</h2>", r'href="https://[^"/]+/[a-z-]+/([0-9]{8})[0-9]{6}-'),
    "liputan6": Rule("<article[^>]*text-item", r'href="(https://[^"]+/read/[0-9]+/[^"]+)"', r'data-title="([^"]+)"', r'datetime="([0-9]{4}-[0-9]{2}-[0-9]{2})'),
}
_WRITTEN = r"(?i)\b([0-9]{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+([0-9]{4})"


def listed_day(text: Column) -> Column:
    """ISO day of an ISO day, of eight digits, or of the first day written out; else null."""
    months = F.create_map(*[F.lit(x) for kv in SHORT_MONTHS.items() for x in kv])
    day = F.regexp_extract(text, _WRITTEN, 1).try_cast("int")
    month = F.try_element_at(months, F.lower(F.regexp_extract(text, _WRITTEN, 2)))
    written = F.when(month.isNotNull(), F.format_string("%04d-%02d-%02d", F.regexp_extract(text, _WRITTEN, 3).try_cast("int"), month, day))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text).when(text.rlike("^[0-9]{8}$"), F.regexp_replace(text, "^(....)(..)(..)$", "$1-$2-$3")).otherwise(written)


def parse_listings(pages: DataFrame, html: str = "html", outlet: str = "outlet", origin: str = "origin") -> DataFrame:
    """(outlet, url, title, listed_date, origin, pos) of every item; unknown outlets are read by the first rule. Items without link or title drop out, as do
    those that the rule's ``only`` leaves out (videos and galleries)."""
    out = None
    for name, rule in RULES.items():
        mine = (F.col(outlet) == name) if name != "detik" else (F.col(outlet) == name) | ~F.col(outlet).isin(list(RULES))
        blocks = F.slice(F.split(F.regexp_replace(F.col(html), f"(?=({rule.block}))", "\u0001"), "\u0001"), 2, 1 << 30)
        rows = pages.where(mine).select(F.col(outlet).alias("outlet"), F.col(origin).alias("origin"), F.posexplode(blocks).alias("pos", "b"))
        dated = F.regexp_extract("b", rule.date, 1)
        dated = F.when(F.lit(rule.date == r"(?s)(.*)"), strip_tags(F.regexp_replace(dated, ">", "> "))).otherwise(F.trim(dated))
        one = rows.select("outlet", F.replace(F.regexp_extract("b", rule.href, 1), F.lit("&amp;"), F.lit("&")).alias("url"), strip_tags(F.regexp_extract("b", rule.title, 1)).alias("title"), listed_day(dated).alias("listed_date"), "origin", "pos")
        one = one.where((F.col("url") != "") & (F.col("title") != "") & F.contains("url", F.lit(rule.only)))
        out = one if out is None else out.unionByName(one)
    return out


def cut_feed(items: DataFrame, topic: str, since: str | None = None, least: int = 5, share: float = 0.2) -> DataFrame:
    """Items of a feed (with ``page``) up to where it ends: before the first page with ``least`` items or more of which less than ``share`` are on
    topic, and up to the first page whose newest item is older than ``since``, that page included. One aggregate per page, one least page per feed."""
    pages = items.groupBy("outlet", "page").agg(F.count("*").alias("n"), F.avg(F.col("title").rlike("(?i)" + topic).cast("int")).alias("on"), F.max("listed_date").alias("newest"))
    off = F.min(F.when((F.col("n") >= least) & (F.col("on") < share), F.col("page"))).alias("off")
    old = F.min(F.when(F.col("newest") < F.lit(since), F.col("page"))).alias("old") if since else F.lit(None).cast("long").alias("old")
    stop = pages.groupBy("outlet").agg(off, old)
    return items.join(stop, "outlet").where((F.col("off").isNull() | (F.col("page") < F.col("off"))) & (F.col("old").isNull() | (F.col("page") <= F.col("old")))).drop("off", "old")


def html_tables(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """(page, row, cells, links) of every row of every table of a page that has a cell; markup of tables in tables is not taken apart."""
    rows = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: strip_tags(F.regexp_replace(c, "<", " <")))
    out = rows.select(page, "row", cells.alias("cells"), F.regexp_extract_all("r", F.lit('href="([^"]+)"'), F.lit(1)).alias("links"))
    return out.where(F.size("cells") > 0)


def register(pages: DataFrame, page: str, parent: str, html: str = "html") -> DataFrame:
    """(page, parent, name, link) of the numbered rows of landed register pages: a number, then a name with a link to the next level."""
    listed = html_tables(pages, page, html).where(F.try_element_at("cells", F.lit(1)).rlike("^[0-9]+$") & (F.size("cells") > 1) & (F.size("links") > 0))
    return listed.join(pages.select(page, parent), page).select(page, parent, F.col("cells")[1].alias("name"), F.col("links")[0].alias("link"), "cells")
