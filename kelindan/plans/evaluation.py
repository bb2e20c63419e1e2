"""Queries on rates, strata, agreement, samples and matches, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelindan.functions.stats import fisher_p
from kelindan.operators import evaluation as E
from kelindan.operators import matching as M
from kelindan.operators.ledger import numbered
from kelindan.session import table

_FLAGS = {"ill": r"sakit|mual|muntah|diare", "lab": r"laborat|hasil uji", "police": r"polisi|kepolisian", "water": r"air sumur"}


def _coded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")  # doc_id is unique
    return docs.select("doc_id", "source", "lang", "status", "domain", "via", *[F.coalesce(F.col("text").rlike("(?i)" + p), F.lit(False)).alias(k) for k, p in _FLAGS.items()])


def group_rates(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).groupBy("domain").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(k).cast("int")), 6).alias(k) for k in _FLAGS]).where("n >= 15")


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    total = F.col("F") + F.col("O") + F.col("P")
    return p.select("o_orderpriority", *[F.round(F.col(s) / total, 6).alias(f"share_{s.lower()}") for s in ("F", "O", "P")])


def quarter_trend(spark: SparkSession, d: str) -> DataFrame:
    q = F.coalesce(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")), F.lit("undated"))
    return table(spark, d, "orders").groupBy(q.alias("quarter")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def lag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed bins, those without rows included."""
    edges = [-1, 0, 1, 3, 7, 30]
    lag = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.datediff("l_shipdate", "o_orderdate").alias("lag"))
    bin_ = F.lit(len(edges))
    for k, e in reversed(list(enumerate(edges))):
        bin_ = F.when(F.col("lag") <= e, k).otherwise(bin_)
    counts = lag.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(len(edges) + 1).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def wilson_strata(spark: SparkSession, d: str) -> DataFrame:
    c = _coded(spark, d)
    return E.strata(c.where("domain is not null"), "domain", F.col("ill") & F.col("lab"))


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = E.kappa(_coded(spark, d), "ill", "lab")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def _recall_table(spark: SparkSession, d: str) -> DataFrame:
    c = _coded(spark, d).withColumn("role", F.when(F.col("lab"), "flagged").otherwise("unflagged")).withColumn("stratum", F.concat_ws("-", "role", "via"))
    return c.groupBy("stratum", "role").agg(F.count_if(F.col("status") == "ok").alias("n"), F.count_if((F.col("status") == "ok") & F.col("water")).alias("k"), F.count("*").alias("pool"))


def recall_estimate(spark: SparkSession, d: str) -> DataFrame:
    r = E.recall(_recall_table(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_recall(_recall_table(spark, d))


def fisher_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Is a flag as frequent in cited articles as in others? Two-sided, times the number of tests, at most 1."""
    c = _coded(spark, d).withColumn("cited", F.col("source") == "cited").where("cited is not null")
    one = c.agg(*[F.count_if(F.col(k) & F.col("cited")).alias(f"{k}_a") for k in _FLAGS], *[F.count_if(F.col(k) & ~F.col("cited")).alias(f"{k}_b") for k in _FLAGS], F.count_if("cited").alias("n1"), F.count_if(~F.col("cited")).alias("n0"))
    rows = one.select("n1", "n0", F.inline(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(f"{k}_a").alias("a"), F.col(f"{k}_b").alias("b")) for k in _FLAGS])))
    p = fisher_p(F.col("a"), F.col("b"), F.col("n1") - F.col("a"), F.col("n0") - F.col("b"))
    return rows.select("flag", "a", "b", p.alias("p")).select("flag", "a", "b", F.round("p", 6).alias("p"), F.round(F.least(F.col("p") * len(_FLAGS), F.lit(1.0)), 6).alias("p_adjusted"))


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _coded(spark, d).where("domain is not null").select("doc_id", "source", "domain")
    return E.quota_sample(rows, "source", "doc_id", "domain", {"cited": 12, "tag_feed": 8, "archive": 5}, 2)


def every_kth(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth flagged article of a domain."""
    rows = _coded(spark, d).where("ill and domain is not null").select("doc_id", "domain")
    block = F.format_string("%015d", F.floor(F.col("doc_id") / 100_000))
    return numbered(rows, "domain", ["doc_id"], block).where("k % 10 = 0").select("doc_id", "domain")


def share_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return E.share(_coded(spark, d), list(_FLAGS))


def top_domains(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("domain")).limit(12)


def venue_matches(spark: SparkSession, d: str) -> DataFrame:
    """Venues of incidents against the register of venues that other rows name in full."""
    inc = table(spark, d, "incidents").where("venue_raw <> ''").select("venue_raw", "province").distinct()
    register = inc.groupBy(F.col("venue_raw").alias("school")).agg(F.min("province").alias("address"))
    names = register.select(F.col("school").alias("venue"))
    return M.tiered(names, register.withColumn("id", F.col("school")), "venue", "venue", "id", "school", "address")


def part_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and size whose names' words are all in another's name."""
    return M.holders(table(spark, d, "part").withColumn("w", F.split(F.lower("p_name"), " +")), "p_partkey", ["p_brand", "p_size"], "w").select(
        "p_partkey", "n", F.col("first").alias("first_match"), F.when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("result")
    )


def fuzzy_tier(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "incidents").where("venue_raw <> ''").select(F.col("venue_raw").alias("venue")).distinct()
    return M.spelling_tier(names, names.select(F.col("venue").alias("id"), F.col("venue").alias("school")), "venue", "venue", "id", "school")


def _sheet(spark: SparkSession, d: str, which: str) -> DataFrame:
    """A labeller's sheet, made by rules that differ a little, as two labellers do."""
    t = F.lower("text")
    label = F.when(t.rlike("hasil uji" if which == "a" else "hasil (?:uji|lab)"), " lab_finding").when(t.rlike("menunggu"), "AWAITING").otherwise("none ")
    about = F.when(t.rlike("siswa"), "yes").when(t.rlike("santri" if which == "a" else "santri|murid"), "UNSURE").otherwise("NO_GENERAL")
    return table(spark, d, "documents").where("text <> ''").select("doc_id", label.alias("label"), about.alias("about"))


def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labellers on the label, on finding or not, and on whether it is about the event."""
    key = table(spark, d, "documents").where("text <> '' and source is not null").select("doc_id", F.col("source").alias("stratum"))
    a, b = (E.scored(key, _sheet(spark, d, w), "doc_id") for w in "ab")
    what = {"label": F.col("label"), "finding": F.when(F.col("label").isin("LAB_FINDING", "LAB_CLEAN"), "FINDING").otherwise("OTHER"), "about": F.col("about")}
    k = E.agreement_of(a, b, "doc_id", what)
    return k.select("what", "n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def strict_strata(spark: SparkSession, d: str) -> DataFrame:
    """Rates of agreement by stratum, with and without what the labeller was unsure about."""
    key = table(spark, d, "documents").where("text <> '' and source is not null").select("doc_id", F.col("source").alias("stratum"))
    s = E.scored(key, _sheet(spark, d, "a"), "doc_id")
    out = [E.strata(s, "stratum", E.positive(F.col("label"), F.col("about"), "LAB_FINDING", strict)).withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return out[0].unionByName(out[1])


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of what a run read: per table its rows and an order-free hash of keys."""
    keys = {"documents": "doc_id", "citations": "citation_id", "fetch_ledger": "entry_id", "incidents": "incident_id", "corpus": "doc_id", "outlets": "domain"}
    out = None
    for name, key in keys.items():
        # Eight hex digits of md5 as a number: sums to the same total in any order.
        h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(h).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "group_rates": group_rates,
    "crosstab": crosstab,
    "quarter_trend": quarter_trend,
    "lag_histogram": lag_histogram,
    "wilson_strata": wilson_strata,
    "cohen_kappa": cohen_kappa,
    "recall_estimate": recall_estimate,
    "bootstrap_ci": bootstrap_ci,
    "fisher_bonferroni": fisher_bonferroni,
    "quota_sample": quota_sample,
    "every_kth": every_kth,
    "share_unpivot": share_unpivot,
    "top_domains": top_domains,
    "venue_matches": venue_matches,
    "part_tiers": part_tiers,
    "fuzzy_tier": fuzzy_tier,
    "label_agreement": label_agreement,
    "strict_strata": strict_strata,
    "manifest": manifest,
}

_C = "c AS (SELECT DISTINCT doc_id, source, lang, status, domain, via, " + ", ".join(f"coalesce(regexp_matches(text, '(?i){p}'), false) AS {k}" for k, p in _FLAGS.items()) + " FROM documents)"
_W = lambda k, n: (f"({k}/{n} + 1.96*1.96/(2*{n})) / (1 + 1.96*1.96/{n})", f"1.96 * sqrt({k}/{n} * (1 - {k}/{n}) / {n} + 1.96*1.96/(4*{n}*{n})) / (1 + 1.96*1.96/{n})")

_SHEET = """s AS (SELECT DISTINCT doc_id, source AS stratum,
        CASE WHEN contains(lower(text), 'hasil uji') THEN 'LAB_FINDING' WHEN contains(lower(text), 'menunggu') THEN 'AWAITING' ELSE 'NONE' END AS la,
        CASE WHEN contains(lower(text), 'hasil uji') OR contains(lower(text), 'hasil lab') THEN 'LAB_FINDING' WHEN contains(lower(text), 'menunggu') THEN 'AWAITING' ELSE 'NONE' END AS lb,
        CASE WHEN contains(lower(text), 'siswa') THEN 'YES' WHEN contains(lower(text), 'santri') THEN 'UNSURE' ELSE 'NO_GENERAL' END AS aa,
        CASE WHEN contains(lower(text), 'siswa') THEN 'YES' WHEN contains(lower(text), 'santri') OR contains(lower(text), 'murid') THEN 'UNSURE' ELSE 'NO_GENERAL' END AS ab FROM documents WHERE text <> '' AND source IS NOT NULL)"""

ORACLES = {
    "label_agreement": f"""WITH {_SHEET}, t AS (SELECT 'label' AS what, la AS x, lb AS y FROM s UNION ALL SELECT 'finding', CASE la WHEN 'LAB_FINDING' THEN 'F' ELSE 'O' END, CASE lb WHEN 'LAB_FINDING' THEN 'F' ELSE 'O' END FROM s UNION ALL SELECT 'about', aa, ab FROM s),
        n AS (SELECT what, count(*) AS n, avg((x = y)::INT) AS o FROM t GROUP BY what), p AS (SELECT what, x AS v, count(*) AS c FROM t GROUP BY ALL), q AS (SELECT what, y AS v, count(*) AS c FROM t GROUP BY ALL),
        e AS (SELECT what, sum(p.c * q.c) AS m FROM p JOIN q USING (what, v) GROUP BY what) SELECT what, n, round(o, 6) AS observed, round(m / (n * n), 6) AS expected, CASE WHEN m = n * n THEN 1.0 ELSE round((o - m / (n * n)) / (1 - m / (n * n)), 6) END AS kappa FROM n JOIN e USING (what)""",
    "strict_strata": f"""WITH {_SHEET}, g AS (SELECT stratum, strict, count(*) AS n, count(*) FILTER (la = 'LAB_FINDING' AND (aa = 'YES' OR (NOT strict AND aa = 'UNSURE'))) AS k FROM s, (SELECT unnest([true, false]) AS strict) GROUP BY ALL)
        SELECT stratum, n, k, round(k / n, 6) AS rate, round(greatest(0.0, {_W("k", "n")[0]} - {_W("k", "n")[1]}), 6) AS ci_low, round(least(1.0, {_W("k", "n")[0]} + {_W("k", "n")[1]}), 6) AS ci_high, strict FROM g""",
    "group_rates": f"WITH {_C} SELECT domain, count(*) AS n, " + ", ".join(f"round(avg({k}::INT), 6) AS {k}" for k in _FLAGS) + " FROM c GROUP BY domain HAVING count(*) >= 15",
    "crosstab": "SELECT o_orderpriority, " + ", ".join(f"round(count(*) FILTER (o_orderstatus = '{s}') / count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 6) AS share_{s.lower()}" for s in ("F", "O", "P")) + " FROM orders GROUP BY 1",
    "quarter_trend": "SELECT coalesce(year(o_orderdate) || 'Q' || quarter(o_orderdate), 'undated') AS quarter, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1",
    "lag_histogram": """WITH l AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        b AS (SELECT CASE WHEN lag <= -1 THEN 0 WHEN lag <= 0 THEN 1 WHEN lag <= 1 THEN 2 WHEN lag <= 3 THEN 3 WHEN lag <= 7 THEN 4 WHEN lag <= 30 THEN 5 ELSE 6 END AS bin, count(*) AS n FROM l GROUP BY 1)
        SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(7) r LEFT JOIN b ON bin = r.range""",
    "wilson_strata": f"""WITH {_C}, g AS (SELECT domain, count(*) AS n, count(*) FILTER (ill AND lab) AS k FROM c WHERE domain IS NOT NULL GROUP BY domain)
        SELECT domain, n, k, round(k / n, 6) AS rate, round(greatest(0.0, {_W("k", "n")[0]} - {_W("k", "n")[1]}), 6) AS ci_low, round(least(1.0, {_W("k", "n")[0]} + {_W("k", "n")[1]}), 6) AS ci_high FROM g""",
    "cohen_kappa": f"""WITH {_C}, s AS (SELECT count(*) AS n, avg((ill = lab)::INT) AS o, avg(ill::INT) AS pa, avg(lab::INT) AS pb FROM c), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS x FROM s)
        SELECT n, round(o, 6) AS observed, round(x, 6) AS expected, round((o - x) / (1 - x), 6) AS kappa FROM e""",
    "recall_estimate": f"""WITH {_C}, t AS (SELECT lab, via, count(*) FILTER (status = 'ok') AS n, count(*) FILTER (status = 'ok' AND water) AS k, count(*) AS pool FROM c GROUP BY ALL),
        s AS (SELECT sum(pool * k / n) FILTER (lab) AS f, sum(pool * k / n) FILTER (NOT lab) AS m, sum(pool * least(1.0, {_W("k", "n")[0]} + {_W("k", "n")[1]})) FILTER (NOT lab) AS w FROM t WHERE n > 0)
        SELECT round(f, 6) AS found, round(m, 6) AS missed, round(f / (f + m), 6) AS recall, round(w, 6) AS missed_worst, round(f / (f + w), 6) AS recall_worst FROM s""",
    "fisher_bonferroni": f"""WITH {_C}, t AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({k} AND source = 'cited') AS a, count(*) FILTER ({k} AND source <> 'cited') AS b, count(*) FILTER (source = 'cited') AS n1, count(*) FILTER (source <> 'cited') AS n0 FROM c" for k in _FLAGS)
    + """), x AS (SELECT *, a + b AS r, n1 + n0 AS n, unnest(range(greatest(0, a + b - n0), least(a + b, n1) + 1)) AS x FROM t),
        p AS (SELECT flag, a, b, x, lgamma(r + 1) + lgamma(n - r + 1) + lgamma(n1 + 1) + lgamma(n0 + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(n1 - x + 1) - lgamma(n0 - r + x + 1) AS lp FROM x),
        o AS (SELECT flag, lp AS seen FROM p WHERE x = a), s AS (SELECT flag, a, b, least(1.0, sum(exp(lp)) FILTER (lp <= seen + 1e-7)) AS p FROM p JOIN o USING (flag) GROUP BY ALL)
        SELECT flag, a, b, round(p, 6) AS p, round(least(p * 4, 1.0), 6) AS p_adjusted FROM s""",
    "quota_sample": f"""WITH {_C}, r AS (SELECT doc_id, source, domain, md5('7' || doc_id) AS o FROM c WHERE domain IS NOT NULL AND source IN ('cited', 'tag_feed', 'archive')),
        g AS (SELECT *, row_number() OVER (PARTITION BY source, domain ORDER BY o, doc_id) AS g FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS s FROM g WHERE g <= 2)
        SELECT doc_id, source, domain FROM s WHERE s <= CASE source WHEN 'cited' THEN 12 WHEN 'tag_feed' THEN 8 ELSE 5 END""",
    "every_kth": f"WITH {_C}, k AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS k FROM c WHERE ill AND domain IS NOT NULL) SELECT doc_id, domain FROM k WHERE k % 10 = 0",
    "share_unpivot": f"WITH {_C} " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER ({k}) AS n, round(count(*) FILTER ({k}) / count(*), 6) AS share FROM c" for k in _FLAGS),
    "top_domains": f"WITH {_C} SELECT domain, count(*) AS n FROM c GROUP BY domain ORDER BY n DESC, domain NULLS LAST LIMIT 12",
    "venue_matches": rf"""WITH r AS (SELECT venue_raw AS v, min(province) AS a FROM incidents WHERE venue_raw <> '' GROUP BY 1),
        t AS (SELECT v, a, list_filter(string_split(regexp_replace(regexp_replace(lower(v), '[^a-z0-9 ]+', ' ', 'g'), '\b(sd|smp|sma|smk|mi|mts|ma) (?:negeri|n)\b', '\1n', 'g'), ' '), lambda x: x <> '') AS t FROM r),
        k AS (SELECT *, regexp_extract(t[1], '^({"|".join(sorted(M.KINDS, key=lambda k: (-len(k), k)))})[ns]?$', 1) AS kind FROM t),
        n AS (SELECT v, kind, substr(t[1], length(kind) + 1, 1) AS st, array_to_string(list_sort(list_distinct(list_transform(list_filter(t[2:], lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: regexp_replace(x, '^0+(.)', '\1')))), ',') AS nums,
                     list_distinct(list_filter(t[2:], lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains([{", ".join(f"'{f}'" for f in M.FILLER)}], x))) AS w,
                     string_split(regexp_replace(lower(coalesce(a, '')), '[^a-z0-9]+', ' ', 'g'), ' ') AS place FROM k WHERE kind <> ''),
        h AS (SELECT x.v, y.v AS id, CASE WHEN list_has_all(y.w, x.w) THEN 1 WHEN list_has_all(list_concat(y.w, y.place), x.w) THEN 2 END AS tier
              FROM n x JOIN n y ON x.kind = y.kind AND x.nums = y.nums AND (x.st = '' OR x.st = y.st)),
        b AS (SELECT v, tier, string_agg(id, '|' ORDER BY id) AS ids, count(*) AS c, row_number() OVER (PARTITION BY v ORDER BY tier) AS k FROM h WHERE tier IS NOT NULL GROUP BY v, tier)
        SELECT r.v AS venue, CASE WHEN c = 1 THEN 'matched' WHEN c > 1 THEN 'ambiguous' ELSE 'none' END AS result, CASE tier WHEN 1 THEN 'name' WHEN 2 THEN 'address' ELSE '' END AS tier, coalesce(ids, '') AS ids
        FROM r LEFT JOIN b ON b.v = r.v AND b.k = 1""",
    "part_tiers": """WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(regexp_split_to_array(lower(p_name), ' +')) AS w FROM part),
        h AS (SELECT x.p_partkey, count(*) AS n, min(y.p_partkey) AS first_match FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey <> y.p_partkey WHERE list_has_all(y.w, x.w) GROUP BY 1)
        SELECT p_partkey, n, first_match, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS result FROM h""",
    "manifest": " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS n, sum(('0x' || left(md5({k}::VARCHAR), 8))::BIGINT)::BIGINT AS digest FROM {n}"
        for n, k in {"documents": "doc_id", "citations": "citation_id", "fetch_ledger": "entry_id", "incidents": "incident_id", "corpus": "doc_id", "outlets": "domain"}.items()
    ),
}
