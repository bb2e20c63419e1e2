"""Declared schemas. Nothing is inferred; readers fail on rows that do not fit."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_LIST, _COUNTS = T.ArrayType(_S), T.MapType(_S, _I)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAGE = _of(lang=_S, title=_S, wikitext=_S, revid=_L, revision_timestamp=T.TimestampType())
CITATION = _of(
    ref_id=_S, url=_S, title=_S, work=_S, date=_S, access_date=_S, archive_url=_S, archive_date=_S, author=_S, language=_S, template=_S, source_page=_S
)
TABLE_ROW = _of(row_id=_S, source_page=_S, table_row=_I, cells=_LIST, links=_LIST, ref_ids=_LIST, origins=T.ArrayType(_S))
LEDGER = _of(
    url=_S, ref_ids=_LIST, status=_S, http_status=_I, via=_S, final_url=_S, domain=_S, cache_path=_S, sha256=_S, n_chars=_I, title=_S, author=_S, publish_date=_S,
    extracted_date=_S, fetched_at=_S, note=_S,
)
LISTED = _of(outlet=_S, url=_S, title=_S, listed_date=_S, origin=_S)
DOCUMENT = _of(
    doc_id=_S, url=_S, original_url=_S, domain=_S, title=_S, author=_S, publish_date=_S, text=_S, n_chars=_I, ref_ids=_LIST, incident_ids=_LIST, via=_S, status=_S,
    content_hash=_S, mentions_incident_place=_B, cluster_id=_S, is_canonical=_B, cluster_size=_I, duplicate_of=_S,
)
REGION = _of(kode=_S, provinsi_kode=_S, provinsi=_S, nama=_S, lat=_D, lng=_D, luas_km2=_D, penduduk=_I)
