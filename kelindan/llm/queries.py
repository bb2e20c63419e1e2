"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.llm import boilerplate, components, houselines, neardup, packing, refmatch, spans, survivors, tokens
from kelindan.plans.corpus import PAIRS_SQL
from kelindan.session import spread, table


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_records(table(spark, sf_dir, "corpus"))


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus").where(F.trim("cluster_id") != "").withColumn("day", survivors.real_day(F.col("publish_date")))
    return survivors.fuse_fields(corpus, "cluster_id", "doc_id", "domain", ["title", "author", "day"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = boilerplate.body_lines(spread(table(spark, sf_dir, "page_cache").select("page_id", "html", "domain")), "page_id", "html", "domain", None, "page")
    raw = boilerplate.body_lines(table(spark, sf_dir, "documents").where("status = 'raw_text'"), "doc_id", "text", "domain", "title", "doc")
    return pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("rec_id"), "line_no").unionByName(
        raw.select(F.lit("doc").alias("origin"), F.col("doc_id").alias("rec_id"), "line_no")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "match_pairs").where("verdict = 'same' and doc_a <> doc_b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    marked = table(spark, sf_dir, "corpus").where("duplicate_of <> '' and duplicate_of <> doc_id").select(F.col("doc_id").alias("a"), F.col("duplicate_of").alias("b"))
    return components.connected_components(pairs.unionByName(marked)).select(F.col("id").alias("doc_id"), "group_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_pairs(*neardup.near_duplicates(_documents(spark, sf_dir), threshold=0.7))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = table(spark, sf_dir, "incidents").select("incident_id", "kabkota", "province")
    codes = table(spark, sf_dir, "kabkota_codes").select(
        F.col("kode").alias("code"), F.col("nama").alias("name"), F.col("nama_lain").alias("other_names"), F.col("provinsi").alias("province")
    )
    found = refmatch.match_reference(incidents, "kabkota", codes, "province")
    same = (incidents["kabkota"] == found["value"]) & incidents["province"].eqNullSafe(found["region"])
    return incidents.join(found, same).select("incident_id", F.col("code").alias("kabkota_kode")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return houselines.repeated_lines(_documents(spark, sf_dir, "domain"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(_documents(spark, sf_dir))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.encode_texts(_documents(spark, sf_dir)).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(_documents(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_fused": p1_fused, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_packed": p9_packed, "p10_found": p10_found}

ORACLES = {
    "p1_found": r"""
        WITH r AS (
          SELECT cluster_id, doc_id, coalesce(n_chars, 0) AS n, fetched_at,
                 CASE WHEN regexp_matches(substr(publish_date, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
                       AND try_cast(substr(publish_date, 1, 10) AS DATE) IS NOT NULL THEN substr(publish_date, 1, 10) ELSE '~' END AS d,
                 coalesce(via <> 'origin', true) AS copy,
                 coalesce(trim(title, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) NOT IN ('', '-'), false) AS has_title,
                 coalesce(trim(author, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) NOT IN ('', '-'), false) AS has_author
          FROM (SELECT DISTINCT cluster_id, doc_id, publish_date, n_chars, via, title, author, fetched_at FROM corpus)
          WHERE trim(cluster_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
        o AS (
          SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, n DESC, doc_id) AS k,
                 row_number() OVER (PARTITION BY cluster_id, has_title ORDER BY copy, d, n DESC, doc_id) AS kt,
                 row_number() OVER (PARTITION BY cluster_id, has_author ORDER BY fetched_at DESC NULLS LAST, doc_id) AS ka
          FROM r)
        SELECT cluster_id, max(CASE WHEN k = 1 THEN doc_id END) AS keep_id,
               coalesce(max(CASE WHEN has_title AND kt = 1 THEN doc_id END), '') AS title_from,
               coalesce(max(CASE WHEN has_author AND ka = 1 THEN doc_id END), '') AS author_from
        FROM o GROUP BY cluster_id HAVING count(DISTINCT doc_id) > 1
    """,
    "p4_found": r"""
        WITH RECURSIVE e AS (
          SELECT doc_a AS a, doc_b AS b FROM match_pairs WHERE verdict = 'same' AND doc_a <> doc_b
          UNION SELECT doc_id, duplicate_of FROM corpus WHERE duplicate_of <> '' AND duplicate_of <> doc_id),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(doc_id, root) AS (SELECT a, a FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.doc_id)
        SELECT doc_id, min(root) AS group_id FROM reach GROUP BY doc_id
    """,
    "p7_found": r"""
        WITH raw AS (
          SELECT doc_id, domain, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line
          FROM documents WHERE domain IS NOT NULL AND text IS NOT NULL),
        l AS (
          SELECT doc_id, domain, line_no, trim(regexp_replace(lower(line), '[ \t' || chr(160) || ']+', ' ', 'g'), ' ') AS line FROM raw),
        k AS (SELECT domain, line FROM l WHERE line <> '' GROUP BY domain, line HAVING count(DISTINCT doc_id) >= 5)
        SELECT DISTINCT doc_id, line_no FROM l JOIN k USING (domain, line)
    """,
    "p5_found": f"WITH {PAIRS_SQL} SELECT a AS doc_a, b AS doc_b FROM j",
    "p6_found": r"""
        WITH RECURSIVE i AS (SELECT DISTINCT incident_id, kabkota, province FROM incidents WHERE regexp_matches(kabkota, '[^\s\x{00a0}]')),
        pr AS (SELECT string_agg(DISTINCT strip_accents(lower(provinsi)), '|') AS p FROM kabkota_codes),
        t0 AS (SELECT incident_id, province, trim(regexp_replace(strip_accents(lower(kabkota)), '[\s\x{00a0}]+', ' ', 'g')) AS t FROM i),
        t1 AS (SELECT incident_id, province, regexp_replace(t, '(?:,|\(| - )\s*(?:(?:provinsi|prov)\.? )?(?:' || p || ')\s*\)?$', '') AS t FROM t0, pr),
        t2 AS (SELECT *, CASE regexp_extract(t, '\b(kabupaten|kab|kotamadya|kodya|kota|kt)\b', 1) WHEN '' THEN '' WHEN 'kabupaten' THEN 'kabupaten' WHEN 'kab' THEN 'kabupaten' ELSE 'kota' END AS kind,
                      trim(regexp_replace(regexp_replace(t, '\b(?:kabupaten|kab|kotamadya|kodya|kota|kt)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n FROM t1),
        t3 AS (SELECT incident_id, province, kind, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n,
                 '^kep ', 'kepulauan '), ' (?:ut|utr)$', ' utara'), ' (?:sel|slt)$', ' selatan'), ' (?:tim|tmr)$', ' timur'), ' (?:bar|brt)$', ' barat'), ' (?:teng|tgh|tng)$', ' tengah'), '^$', ''), ' ', '') AS n FROM t2),
        e0 AS (SELECT kode, provinsi, lower(split_part(nama, ' ', 1)) AS kind, substr(nama, length(split_part(nama, ' ', 1)) + 2) AS n FROM kabkota_codes
               UNION ALL SELECT kode, provinsi, lower(split_part(nama, ' ', 1)), unnest(string_split(nama_lain, ';')) FROM kabkota_codes WHERE nama_lain <> ''),
        e AS (SELECT kode, provinsi, kind, regexp_replace(strip_accents(lower(n)), '[^a-z0-9]', '', 'g') AS n FROM e0),
        m AS (SELECT incident_id, kode, row_number() OVER (PARTITION BY incident_id ORDER BY levenshtein(t3.n, e.n), coalesce(t3.province, '') <> e.provinsi, kode) AS k
              FROM t3 JOIN e ON (t3.kind = '' OR t3.kind = e.kind) AND t3.n <> '' AND levenshtein(t3.n, e.n) <= 2)
        SELECT i.incident_id, coalesce(m.kode, 'none') AS kabkota_kode FROM i LEFT JOIN m ON m.incident_id = i.incident_id AND m.k = 1
    """,
    "p10_found": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n' || chr(160) || ']+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM w WHERE len(w) >= 50), h AS (SELECT doc_id, k - 1 AS p, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM s),
        c AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1), f AS (SELECT DISTINCT doc_id, p FROM h JOIN c USING (h)),
        n AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM f),
        r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n)
        SELECT doc_id, min(p) AS start_word, max(p) + 50 AS end_word FROM r GROUP BY doc_id, run
    """,
}
