from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from kelindan.functions import lexicon as X
from kelindan.functions import text as T
from kelindan.functions.phrases import pattern
from kelindan.operators import corpus as C
from kelindan.operators import evaluation as E
from kelindan.operators import ledger as L
from kelindan.operators import linking as K
from kelindan.operators import matching as M
from kelindan.plans import corpus as P


@pytest.mark.parametrize("size", [1, 2, 100])
def test_ledger(spark, size):
    block = F.format_string("%03d", F.floor(F.col("t") / size))
    log = spark.createDataFrame([("a", 1, "e"), ("a", 2, "e"), ("a", 3, "e"), ("a", 4, "ok"), ("a", 5, "e"), ("b", 1, "ok"), (None, 9, "e")], "h string, t int, s string")
    assert rows(L.last_wins(log, "h", ["t"])) == [("a", 5, "e"), ("b", 1, "ok")]
    assert rows(L.failure_runs(log.where("h is not null"), "h", ["t"], F.col("s") != "ok", 3, block), "h", "length") == [("a", 3)]
    got = L.interleave(log, "h", ["t", "s"], block).orderBy("round", "group_first", "h").select("h", "t").collect()
    assert [r.h for r in got][:3] == ["a", "b", "a"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_as_of(spark, size):
    a = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, k string, t int")
    b = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y"), ("w", 1, "z")], "k string, t int, val string")
    assert rows(L.as_of(a, b, "k", "t", "t", "val", lambda t: F.format_string("%03d", F.floor(t / size))), "id", "val") == [(1, "y"), (2, None), (3, None)]


def test_similar_pairs_are_complete(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)]
        texts.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = "zz" + str(rng.random())
            texts.append(t)
    texts += [[], ["x"], ["x"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    sets = [set(tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))) if t else set() for t in texts]
    norm = [{tuple(w.replace("0.", "0 ").split()[0] for w in s) for s in x} for x in sets]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if norm[i] and norm[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    got = {(r.a, r.b) for r in C.similar_pairs(df, 0.7).collect()}
    assert want <= got
    c = C.clusters(df, C.similar_pairs(df, 0.7))
    assert {r.doc_id: r.cluster_id for r in c.collect()}[len(texts) - 1] == len(texts) - 2


def test_clusters_of_a_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a int, b int")
    nodes = spark.range(n + 1).select(F.col("id").cast("int").alias("doc_id"))
    got = {r.doc_id: r.cluster_id for r in C.clusters(nodes, pairs).collect()}
    assert set(got[i] for i in range(n)) == {0} and got[n] == n


def test_canonical(spark):
    df = spark.createDataFrame([("c", "a", "2025-02-01"), ("c", "b", "2025-01-01"), ("d", "e", None)], "cl string, id string, day string")
    got = rows(C.canonical(df, "cl", "id", [F.coalesce("day", F.lit("9999"))]), "id", "is_canonical", "cluster_size", "duplicate_of")
    assert got == [("a", False, 2, "b"), ("b", True, 2, None), ("e", True, 1, None)]


def test_linking(spark):
    ev = spark.createDataFrame(
        [("e1", "2025-05-01", "2025-05-02", ["SDN 1 Melati Raya", "SD (spesifik)"], "Kota Batu Putih"), ("e2", "2025-05-03", None, [], "Kota Batu Putih"), ("e3", "2025-05", None, [], "Kabupaten Lain"), ("e4", None, None, [], "Kota X")],
        "event_id string, date_start string, date_end string, venues array<string>, place string",
    )
    terms = K.event_terms(ev)
    assert {r.event_id for r in terms.collect()} == {"e1", "e2", "e3"}
    docs = spark.createDataFrame(
        [(1, "di SDN 1 Melati Raya, Batu Putih", "2025-05-10"), (2, "di Batuputih", "2025-05-04"), (3, "di Lain", "2025-06-30"), (4, "di Lain", "2025-07-01"), (5, "Batu Putih", None), (6, "batu putihan", "2025-05-04"), (7, "", "2025-05-04")],
        "doc_id int, text string, d string",
    ).withColumn("day", F.to_date("d"))
    got = rows(K.matches(docs, terms, "doc_id", F.col("text"), "day"), "doc_id", "event_id", "kind")
    assert got == [(1, "e1", "venue"), (2, "e1", "place"), (2, "e2", "place"), (3, "e3", "place")]
    m = K.matches(docs, terms, "doc_id", F.col("text"), "day")
    assert {r.doc_id: r.decision for r in K.decide(docs, m, m.limit(0), "doc_id").collect()} == {1: "linked", 2: "ambiguous", 3: "linked", 4: "none", 5: "none", 6: "none", 7: "none"}


FOUND = [
    "Hasil uji laboratorium menunjukkan adanya bakteri",
    "dari hasil lab ada kandungan bakteri, dan tidak menemukan unsur pidana",
    "Sampel nasi itu positif mengandung Salmonella",
    "Dinas menyebut kejadian itu dipicu kadar nitrit yang tinggi",
    "Bakteri E. coli juga ditemukan pada sampel air",
    "Kandungan histamin di menu ikan melebihi batas",
    "Hasil penelitian BPOM memperlihatkan kuman yang dapat menyebabkan mual",
]
NOT_FOUND = [
    "Belum ada hasil lab yang menyebut bakteri",
    "Dari hasil pemeriksaan ditemukan 40 siswa yang mual",
    "Mual biasanya disebabkan oleh bakteri pada nasi basi",
    "Zat yang dipicu bakteri di dapur bisa menjadi racun",
    "Hasil uji menunjukkan air tidak mengandung bakteri",
    "Kami menunggu hasil lab apakah sampel mengandung nitrit",
]


def test_lexicon(spark):
    df = spark.createDataFrame([(s, s in FOUND) for s in FOUND + NOT_FOUND], "s string, want boolean")
    assert [r.s for r in df.select("s", "want", X.states_finding(F.col("s")).alias("got")).where("got <> want").collect()] == []
    said = [*FOUND[:2], NOT_FOUND[0], "Hasil pemeriksaan sampel negatif", "Hasil pemeriksaan psikologis negatif", "Kami menunggu hasil laboratorium", "Makan siang"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", X.certainty(F.col("s"), T.sentences(F.col("s"))).alias("c"), X.flagged(F.col("s")).alias("f")).orderBy("i")
    assert [(r.c, r.f) for r in df.collect()] == [("contamination", True)] * 2 + [("none", False), ("clean", True), ("none", False), ("awaiting", True), ("none", False)]
    titles = spark.createDataFrame([("Terungkap, nasi mengandung bakteri",), ("Polisi selidiki penyebab mual",), ("Siswa mual",)], "t string")
    assert [r[0] for r in titles.select(X.headline_cause(F.col("t"))).collect()] == [True, False, False]
    assert len(X.version()) == 16


def test_phrases():
    assert re.fullmatch(pattern("<a/b> (c) d*"), "b c dx") and re.fullmatch(pattern("<a/b> (c) d*"), "a  d") and not re.fullmatch(pattern("a b"), "ab")
    assert re.search(pattern("a ~3 b"), "a12b") and not re.search(pattern("a ~3 b"), "a1234b") and not re.search(pattern("a ~3 b"), "a.b")
    assert re.fullmatch(pattern("a ..2 b"), "a x y b") and not re.fullmatch(pattern("a ..2 b"), "a x y z b")
    assert re.fullmatch(pattern("x {l}", {"l": ["p q", "r.s"]}), "x r.s") and not re.fullmatch(pattern("{l}", {"l": ["r.s"]}), "rxs")


def test_teasers(spark):
    df = spark.createDataFrame([("a\nSimak juga video: basi\n\nb",), ("Baca juga: c\na",), ("tidak juga",), (None,)], "t string")
    assert [r[0] for r in df.select(T.drop_teasers(F.col("t"))).collect()] == ["a\n\nb", "a", "tidak juga", None]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert abs(E.kappa(df, "x", "y").collect()[0].kappa - 0.5) < 1e-9
    table = spark.createDataFrame([("a", "flagged", 10, 9, 100), ("b", "unflagged", 20, 1, 200)], "stratum string, role string, n int, k int, pool int")
    r = E.recall(table).collect()[0]
    assert abs(r.recall - 90 / 100) < 1e-9 and r.recall_worst < r.recall
    b = E.bootstrap_recall(table, 200).collect()[0]
    assert b.low <= r.recall <= b.high
    items = spark.createDataFrame([(i, "s" if i % 3 else "t", i % 5) for i in range(60)], "id int, st string, g int")
    q = E.quota_sample(items, "st", "id", "g", {"s": 4, "t": 10}, 2)
    n = {r.st: r["count"] for r in q.groupBy("st").count().collect()}
    assert n["s"] == 4 and n["t"] <= 10 and q.groupBy("st", "g").count().agg(F.max("count")).collect()[0][0] <= 2


def test_places_named(spark):
    codes = spark.createDataFrame([("Kota Batu Putih",), ("Kabupaten Lain",), ("Kabupaten Muara Dua Timur",)], "nama string")
    docs = spark.createDataFrame([(1, "Di Batu Putih", "Makan"), (2, None, "Warga Lain di batuputih"), (3, "Muara Dua", "Lainnya"), (4, "Siswa", "di Muara Dua Timur."), (5, "Lain", None)], "doc_id int, title string, text string")
    assert rows(P.places_named(docs, codes), "doc_id", "places") == [(1, "batu putih"), (2, "batuputih|lain"), (4, "muara dua timur"), (5, "lain")]


def test_all_classes(spark):
    said = {
        "mech_denial": "Bukan karena MBG", "sym_sakit_perut": "Perut melilit", "care_inpatient": "Dilarikan ke rumah sakit", "resp_halted": "SPPG itu dibekukan", "resp_outbreak": "Status KLB", "resp_national_agency": "Badan Gizi Nasional",
        "resp_bpom": "Badan Pengawas Obat", "resp_certificate": "Sertifikat laik higiene", "resp_legislators": "Anggota dewan", "resp_programme_halt": "Setop sementara MBG", "suspect_ayam": "Ayam itu basi", "mech_pathogen": "E. coli",
    }
    df = spark.createDataFrame(list(said.items()), "name string, text string")
    df = df.select("name", *X.coded(F.lit(None).cast("string"), F.col("text"), T.sentences(F.col("text"))))
    assert all(r[r.name] for r in df.collect()) and df.count() == 12 and len(df.columns) == 52


def test_bootstrap_of_many_strata(spark):
    few = spark.createDataFrame([("a", "flagged", 50, 45, 900), ("b", "unflagged", 50, 5, 900)], "stratum string, role string, n int, k int, pool int")
    many = spark.range(10_001).select(F.concat(F.lit("s"), "id").alias("stratum"), F.lit("unflagged").alias("role"), F.lit(4).alias("n"), F.lit(4).alias("k"), F.lit(1).alias("pool"))
    one, all_ = E.bootstrap_recall(few, 300).collect()[0], E.bootstrap_recall(few.unionByName(many), 300).collect()[0]
    assert one.low < 0.9 < one.high and all_.high < 0.1  # each of the 10,001 adds a miss


def test_numbered_in_blocks(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = L.numbered(df, "g", ["id"], F.format_string("%05d", F.floor(F.col("id") / 7)))
    want = df.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert got.select("id", "k").exceptAll(want.select("id", "k")).isEmpty() and got.count() == 1000


def test_breaker(spark):
    said = [200, 403, 403, 403, 404, 403, 403, 0, None, 0, 0, 500, 0, 0, 0, 429, 200]
    df = spark.createDataFrame([("h", i, f"2025-01-01 00:{i:02d}:00", c) for i, c in enumerate(said)] + [("g", 1, "2025-01-01 00:00:00", 403), ("f", 1, "2025-01-01 00:00:00", None)], "host string, id int, at string, code int")
    for size in (1, 5, 60):
        block = F.format_string("%03d", F.floor(F.minute("at") / size))
        got = {(r.host, r.id): (r.trips, r.open) for r in L.breaker(df, "host", "at", "code", ["at", "id"], block).collect()}
        trips = {k: t for k, (t, _) in got.items() if t}
        assert trips == {("h", 6): 1800, ("h", 9): 300, ("h", 14): 300, ("h", 15): 900}
        assert not got["h", 6][1] and got["h", 7][1] and got["h", 14][1] is False and got["h", 15][1] and got["h", 16][1] and not got["f", 1][1]


def test_outcomes(spark):
    cols = "url string, domain string, allowed boolean, origin_status int, origin_chars int, origin_bytes int, archive_status int, archive_chars int, archive_bytes int"
    landed = [
        ("ok", "a.x", True, 200, 900, 1, None, None, None, "ok", "origin"), ("forbidden", "a.x", False, 200, 900, 1, None, None, None, "robots_disallowed", "origin"), ("kept", "a.x", False, None, None, None, 200, 500, 1, "ok", "wayback"),
        ("gone", "a.x", True, 404, 0, 1, 500, 0, 0, "http_error", "origin"), ("reset", "a.x", True, 0, 0, 0, None, None, None, "network_error", "origin"), ("bare", "a.x", True, 200, 0, 0, None, None, None, "no_archive", "origin"),
        ("short", "a.x", True, 200, 50, 1, 200, 40, 1, "short_body", "origin"), ("longer", "a.x", True, 200, 50, 1, 200, 400, 1, "ok", "wayback"), ("wall", "pay.x", True, 200, 50, 1, 200, 400, 1, "paywalled", "origin"),
        ("social", "m.social.x", True, 200, 900, 1, None, None, None, "skipped_domain", ""), ("nothing", None, True, 200, 0, 1, None, None, None, "empty", "origin"),
    ]
    df = spark.createDataFrame([r[:9] for r in landed], cols)
    got = {r.url: (r.status, r.via) for r in L.outcomes(df, skip=("social.x",), paywalled=("pay.x",)).collect()}
    assert got == {r[0]: r[9:] for r in landed}


def test_two_labellers(spark):
    key = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "id int, stratum string")
    a = E.scored(key, spark.createDataFrame([(1, " yes", "YES"), (2, "no", "UNSURE"), (3, "yes", "NO")], "id int, label string, about string"), "id")
    b = E.scored(key, spark.createDataFrame([(1, "YES", "yes"), (2, "YES", "yes"), (9, "NO", "no")], "id int, label string, about string"), "id")
    got = {r.what: (r.n, r.observed) for r in E.agreement_of(a, b, "id", {"label": F.col("label"), "about": F.col("about")}).collect()}
    assert got == {"label": (2, 0.5), "about": (2, 0.5)}
    assert rows(a.select("id", E.positive(F.col("label"), F.col("about"), "NO").alias("s"), E.positive(F.col("label"), F.col("about"), "NO", False).alias("l"))) == [(1, False, False), (2, False, True), (3, False, False)]


def test_holders_count_rows_of_other_keys(spark):
    parts = [(1, "a", 1, "x y"), (2, "a", 1, "y x"), (3, "a", 1, "x"), (4, "a", 2, "x y"), (5, "a", 1, "x y z"), (5, "a", 1, "x y"), (5, "a", 1, "y"), (None, "a", 1, "x"), (6, None, 1, "x"), (7, "a", 1, None), (8, "b", 1, "x"), (8, "b", 1, "x")]
    df = spark.createDataFrame(parts, "k int, brand string, size int, name string").withColumn("w", F.split("name", " "))
    want = {}
    for k, b, s, n in parts:
        for k2, b2, s2, n2 in parts:
            if None not in (k, b, s, n, k2, n2) and (b, s) == (b2, s2) and k != k2 and set(n.split()) <= set(n2.split()):
                want.setdefault(k, []).append(k2)
    got = {r.k: (r.n, r.first) for r in M.holders(df, "k", ["brand", "size"], "w").collect()}
    assert got == {k: (len(v), min(v)) for k, v in want.items()}


def test_holders_pair_sets_not_rows(spark, tmp_path):
    """A small file of many rows of few names: nothing as large as its rows is broadcast, whatever the file's size."""
    spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("brand"), F.array(F.lit("x"), (F.col("id") % 2).cast("string")).alias("w")).write.parquet(str(tmp_path / "parts"))
    got = M.holders(spark.read.parquet(str(tmp_path / "parts")), "k", ["brand"], "w")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.min("n"), F.max("n"), F.max("first"), F.count("*")).first()[:] == (9999, 9999, 3, 20_000)


def test_similar_pairs_of_repeated_ids_and_equal_texts(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [(1, words), (2, words), (3, words[:38] + ["x"]), (4, words[:20]), (4, words[20:]), (5, words[:22]), (6, ["Ab", "c"]), (7, ["ab", "C"]), (8, []), (9, words[:20]), (9, words[:20])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id int, text string")
    sets = {}
    for i, t in texts:
        t = [w.lower() for w in t]
        sets.setdefault(i, set()).update(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4)) if t)
    want = {(a, b): (len(x & y), len(x & y) / len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.7}
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in C.similar_pairs(df).collect()}
    assert got == want and (1, 4) in want and (6, 7) in want
    assert {r.doc_id: r.cluster_id for r in C.similar_clusters(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 5}
