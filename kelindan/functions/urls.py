"""URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_of(url: Column) -> Column:
    """Lower-case network location without a leading www.; keeps a port; '' without one."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def is_archived(url: Column) -> Column:
    """Is it a copy in a web archive?"""
    return url.rlike(r"/web/[0-9]+[a-z_]*/https?://")


def original_of(url: Column) -> Column:
    """The archived URL inside an archive URL, else the URL itself."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/web/[0-9]+[a-z_]*/(https?://.+)$", 1), F.lit("")), url)


def raw_snapshot(url: Column) -> Column:
    """The archive URL that serves the page as it was kept, over https."""
    return F.regexp_replace(F.regexp_replace(url, "^http://", "https://"), r"(/web/[0-9]+)(/https?://)", "$1id_$2")


def host_key(url: Column, archives: tuple[str, ...] = ("arsip.example", "archive.org")) -> Column:
    """Key of the host that is asked; hosts of web archives share one."""
    host = domain_of(url)
    shared = F.lit(False)
    for a in archives:
        shared |= host.endswith(a)
    return F.when(shared, F.lit(archives[0])).otherwise(host)


# Hosts, paths and titles of pages of videos and galleries.
GALLERY_HOST, GALLERY_PATH, GALLERY_TITLE = "^(?:20|video)[.]", "^(?:video|foto|tv)/|(?:^|/)foto[a-z-]*/", "^(?i)(?:video:|video |foto:)"


def is_gallery(url: Column, title: Column) -> Column:
    """Is it a page of videos or photos, which has captions only?"""
    path = F.regexp_extract(url, r"^[^/]*//[^/]*/(.*)$", 1)
    return F.coalesce(domain_of(url).rlike(GALLERY_HOST), F.lit(False)) | F.coalesce(path.rlike(GALLERY_PATH), F.lit(False)) | F.coalesce(title.rlike(GALLERY_TITLE), F.lit(False))


def snapshot_request(service: str, url: Column, day: Column) -> Column:
    """The question to an archive for the copy of a URL nearest to an ISO day, or to none."""
    return F.concat(F.lit(service + "?url="), F.url_encode(url), F.when(day.isNotNull(), F.concat(F.lit("&timestamp="), F.replace(day, F.lit("-"), F.lit("")))).otherwise(""))
