"""Queries on the corpus of texts, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelindan.functions import text as T
from kelindan.operators import corpus as C
from kelindan.operators import linking as K
from kelindan.session import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "domain", "title", "n_chars", "publish_date"))


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return C.exact_groups(_texts(spark, d)).select("doc_id", "group_size", "group_id")


def shingle_df(spark: SparkSession, d: str) -> DataFrame:
    """How many shingles stand in how many documents."""
    rows = C.shingle_sets(_texts(spark, d)).select("doc_id", F.explode("s").alias("s"))
    return rows.groupBy("s").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("shingles"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.similar_pairs(table(spark, d, "documents").select("doc_id", "text")).select("a", "b", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 6).alias("jaccard"))


def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.similar_clusters(table(spark, d, "documents").select("doc_id", "text"))


def canonical_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)
    named = docs.join(C.exact_groups(docs).select("doc_id", F.col("group_id").alias("cluster_id")), "doc_id")
    order = [F.coalesce(F.nullif("publish_date", F.lit("")), F.lit("9999")), -F.coalesce(F.length("text"), F.lit(0)), F.col("doc_id")]
    return C.canonical(named, "cluster_id", "doc_id", order).select("doc_id", "cluster_id", "is_canonical", "cluster_size", "duplicate_of")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """With the upper median: the value at position n div 2 from 0."""
    c = table(spark, d, "corpus").dropDuplicates(["doc_id"])
    sizes = c.where("trim(cluster_id) <> ''").groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = c.agg(F.count("*").alias("docs"), F.countDistinct("domain").alias("domains"))
    median = C.upper_median(c, "n_chars").select(F.col("upper_median").cast("long").alias("upper_median"))
    return total.join(sizes.agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))).join(median)


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = _texts(spark, d).where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("chars"))


def sentence_context(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of 41 to 399 characters with the ends of their neighbours; neighbours are slices of the document's own array, so nothing shuffles."""
    s = _texts(spark, d).where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    rows = s.select("doc_id", "s", F.posexplode("s").alias("i", "said")).where(F.length("said").between(41, 399))
    before = F.when(F.col("i") > 0, F.try_element_at("s", F.col("i")))
    return rows.select(
        "doc_id", F.col("i").cast("long").alias("i"), F.length("said").cast("long").alias("chars"), F.md5(F.coalesce(F.substring(before, 1, 320), F.lit(""))).alias("before_"),
        F.md5(F.coalesce(F.substring(F.try_element_at("s", F.col("i") + 2), 1, 320), F.lit(""))).alias("after_"), F.substring(T.norm_key(F.col("said")), 1, 40).alias("key"),
    )


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of pages: scripts and styles cut, related-story lines dropped, tags stripped."""
    seen = F.regexp_replace("html", r"(?is)<(?:script|style|title)\b.*?</(?:script|style|title)>", "")
    lines = F.filter(F.split(seen, "\n"), lambda x: ~x.rlike(r"(?i)(?:baca|simak|lihat) juga|artikel terkait"))
    return table(spark, d, "page_cache").where("html is not null").select("page_id", T.strip_tags(F.array_join(lines, "\n")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def listing_links(spark: SparkSession, d: str) -> DataFrame:
    """(page, position, href, text) of every link of a page."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)">([^<]*)</a>'), F.lit(0))
    rows = table(spark, d, "page_cache").select("page_id", F.posexplode(links).alias("pos", "a"))
    href, said = F.regexp_extract("a", r'href="([^"]+)"', 1), T.strip_tags(F.col("a"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), href.alias("href"), said.alias("said"))


def topic_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with 5 links or more of which fewer than a fifth are on topic."""
    topic = F.col("said").rlike(r"(?i)siswa|santri|murid|pelajar|balita|anak|dapur|porsi")
    g = listing_links(spark, d).groupBy("page_id").agg(F.count("*").alias("items"), F.round(F.avg(topic.cast("int")), 6).alias("on_topic"))
    return g.where("items >= 5 and on_topic < 0.2")


def value_share(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def places_named(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """(doc_id, places): regencies and cities, of any number of words, that a title or text names."""
    terms = codes.select(F.explode(T.place_forms(T.place_name(F.col("nama")))).alias("f")).select(F.trim("f").alias("term")).distinct()
    said = F.concat_ws(" ", "title", "text")
    return K.find_terms(documents, terms, "doc_id", said).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("places"))


def place_mentions(spark: SparkSession, d: str) -> DataFrame:
    return places_named(_texts(spark, d), table(spark, d, "kabkota_codes"))


QUERIES = {
    "exact_dup_groups": exact_dup_groups,
    "shingle_df": shingle_df,
    "near_dup_pairs": near_dup_pairs,
    "dup_clusters": dup_clusters,
    "canonical_docs": canonical_docs,
    "corpus_stats": corpus_stats,
    "sentence_split": sentence_split,
    "sentence_context": sentence_context,
    "page_text": page_text,
    "listing_links": listing_links,
    "topic_pages": topic_pages,
    "value_share": value_share,
    "place_mentions": place_mentions,
}

_NORM = r"trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_SH = rf"""w AS (SELECT DISTINCT doc_id, string_split({_NORM}, ' ') AS w FROM documents WHERE text IS NOT NULL AND {_NORM} <> ''),
    g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w), s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM g),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
PAIRS_SQL = f"""{_SH}, p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    j AS (SELECT a, b, shared, shared / (na.n + nb.n - shared) AS jaccard FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.n + nb.n - shared) >= 0.7)"""
_SENT = r"""m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\b([A-Z])\.', '\1' || chr(1), 'g'), '([.!?])\s+', '\1' || chr(2), 'g') AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, chr(2) || '|\n+'), lambda x: replace(x, chr(1), '.')), lambda x: trim(x) <> '') AS s FROM m)"""

ORACLES = {
    "exact_dup_groups": f"""WITH h AS (SELECT DISTINCT doc_id, {_NORM} AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) OVER (PARTITION BY t) AS group_size, min(doc_id) OVER (PARTITION BY t) AS group_id FROM h""",
    "shingle_df": f"WITH {_SH}, f AS (SELECT s, count(*) AS df FROM s GROUP BY s) SELECT df, count(*) AS shingles FROM f GROUP BY df",
    "near_dup_pairs": f"WITH {PAIRS_SQL} SELECT a, b, shared, round(jaccard, 6) AS jaccard FROM j",
    "dup_clusters": f"""WITH RECURSIVE {PAIRS_SQL}, u AS (SELECT a, b FROM j UNION SELECT b, a FROM j), r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
        SELECT doc_id, min(root) AS cluster_id FROM r GROUP BY doc_id""",
    "canonical_docs": f"""WITH h AS (SELECT doc_id, {_NORM} AS t, coalesce(nullif(publish_date, ''), '9999') AS o, length(text) AS n FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, min(doc_id) OVER w AS cluster_id, count(*) OVER w AS cluster_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY o, n DESC, doc_id) AS first_id FROM h WINDOW w AS (PARTITION BY t))
        SELECT doc_id, cluster_id, doc_id = first_id AS is_canonical, cluster_size, CASE WHEN doc_id <> first_id THEN first_id END AS duplicate_of FROM k""",
    "corpus_stats": """WITH c AS (SELECT DISTINCT doc_id, cluster_id, n_chars, domain FROM corpus)
        SELECT count(*) AS docs, count(DISTINCT domain) AS domains, (SELECT count(DISTINCT cluster_id) FROM c WHERE trim(cluster_id) <> '') AS clusters,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM c WHERE trim(cluster_id) <> '' GROUP BY cluster_id)) AS largest, list_sort(list(n_chars) FILTER (n_chars IS NOT NULL))[count(n_chars) // 2 + 1]::BIGINT AS upper_median FROM c""",
    "sentence_split": f"WITH {_SENT} SELECT doc_id, len(s)::BIGINT AS n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS chars FROM c",
    "sentence_context": f"""WITH {_SENT}, e AS (SELECT doc_id, s, generate_subscripts(s, 1) AS k, unnest(s) AS said FROM c)
        SELECT doc_id, (k - 1)::BIGINT AS i, length(said)::BIGINT AS chars, md5(coalesce(CASE WHEN k > 1 THEN left(s[k - 1], 320) END, '')) AS before_, md5(coalesce(left(s[k + 1], 320), '')) AS after_,
               left(left(trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')), 120), 40) AS key FROM e WHERE length(said) BETWEEN 41 AND 399""",
    "page_text": r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style|title)\b.*?</(?:script|style|title)>', '', 'g') AS h FROM page_cache WHERE html IS NOT NULL),
        b AS (SELECT page_id, array_to_string(list_filter(string_split(h, chr(10)), lambda x: NOT regexp_matches(x, '(?i)(?:baca|simak|lihat) juga|artikel terkait')), chr(10)) AS h FROM a),
        c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g')) AS t FROM b)
        SELECT page_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM c""",
    "listing_links": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 0) AS a FROM page_cache), e AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS a FROM l)
        SELECT page_id, pos::BIGINT AS pos, regexp_extract(a, 'href="([^"]+)"', 1) AS href,
               trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g')) AS said FROM e""",
    "topic_pages": r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1)) AS said FROM page_cache),
        g AS (SELECT page_id, count(*) AS items, round(avg(CASE WHEN regexp_matches(said, '(?i)siswa|santri|murid|pelajar|balita|anak|dapur|porsi') THEN 1 ELSE 0 END), 6) AS on_topic FROM e GROUP BY page_id)
        SELECT * FROM g WHERE items >= 5 AND on_topic < 0.2""",
    "value_share": "SELECT coalesce(lang, '(none)') AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1",
    "place_mentions": r"""WITH b AS (SELECT trim(regexp_replace(strip_accents(lower(regexp_replace(nama, '^(?:Kabupaten|Kota(?: Administrasi)?) ', ''))), '[^a-z0-9]+', ' ', 'g')) AS b FROM kabkota_codes),
        f AS (SELECT b AS w FROM b WHERE b <> '' UNION SELECT replace(b, ' ', '') FROM b WHERE b <> ''),
        t AS (SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(lower(coalesce(title, '') || ' ' || coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)
        SELECT doc_id, string_agg(DISTINCT w, '|' ORDER BY w) AS places FROM t JOIN f ON contains(t, ' ' || w || ' ') GROUP BY doc_id""",
}
