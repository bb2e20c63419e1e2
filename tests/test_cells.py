from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelindan.functions import cells
from kelindan.functions import text as T
from kelindan.functions import urls as U
from kelindan.functions.stats import fisher_two_sided, wilson
from kelindan.operators import incidents as I
from kelindan.operators import matching as M


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r.x for r in df.select(column(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize(
    "raw, kind, total, low, high",
    [
        ("33 Santri", "exact", 33, 33, 33), ("1.333 Siswa", "exact", 1333, 1333, 1333), ("45 Siswa + 3 Guru", "exact", 48, 48, 48), ("± 99 Siswa", "approx", 99, 99, 99),
        ("Lebih dari 5 orang", "lower_bound", 5, 5, None), ("Ratusan Siswa", "vague", None, 100, 999), ("TBA (Tidak disebutkan)", "unreported", None, None, None),
        ("", "unreported", None, None, None), (None, "unreported", None, None, None), ("banyak", "unparsed", None, None, None),
    ],
)
def test_counts(spark, raw, kind, total, low, high):
    (c,) = one(spark, cells.count_cell, raw)
    assert (c.kind, c.total, c.minimum, c.maximum) == (kind, total, low, high)


def test_subjects_and_flags(spark):
    a, b = one(spark, cells.count_cell, "45 Siswa + 3 Guru + 2 Murid", "99 Siswa dan Guru")
    assert a.by_subject == {"student": 47, "teacher": 3} and not a.unnumbered and b.unnumbered


@pytest.mark.parametrize(
    "raw, want",
    [
        ("23 April 2025", ("2025-04-23", "2025-04-23", "day")), ("7 s/d 9 Mei 2025", ("2025-05-07", "2025-05-09", "day")), ("30 April s/d 2 Mei 2025", ("2025-04-30", "2025-05-02", "day")),
        ("Awal Februari 2026", ("2026-02", "2026-02", "month")), ("Senin (22/9/2025)", ("2025-09-22", "2025-09-22", "day")), ("Tidak Disebutkan", None), ("31/2/2025", ("2025-02-31", "2025-02-31", "day")),
        ("40 Mei 2025", ("2025-05", "2025-05", "month")), (None, None),
    ],
)
def test_dates(spark, raw, want):
    (c,) = one(spark, cells.date_cell, raw)
    assert (c and tuple(c)) == want


def test_normalisers(spark):
    assert one(spark, T.norm_words, "Kulón  Progo_1, État!") == ["kulon progo_1 etat"]
    assert one(spark, T.norm_padded, "SDN 1, Béringin", None) == [" sdn 1 beringin ", "  "]
    assert one(spark, T.place_forms, "Kulon Progo", "Batu", "") == [[" kulon progo ", " kulonprogo "], [" batu "], []]
    assert one(spark, T.sentences, "A. Ya, E. coli ada. Benar? \nTidak", None) == [["A. Ya, E. coli ada.", "Benar?", "Tidak"], None]
    assert one(spark, T.place_type, "Kota Administrasi X", "kabupaten", "Y") == ["kota", None, None]
    assert one(spark, T.place_name, "Kota Administrasi X", "Kabupaten Aceh Utara") == ["X", "Aceh Utara"]


def test_shingles(spark):
    words = lambda c: T.shingles(F.filter(F.split(c, " "), lambda w: w != ""), 5)
    assert one(spark, words, "a b c d e f a b c d e", "a b", "") == [["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"], ["a b"], []]


def test_urls(spark):
    u = "http://arsip.example/web/20250101000000/https://www.x.co.example:8080/a"
    assert one(spark, U.original_of, u, "https://y.example/") == ["https://www.x.co.example:8080/a", "https://y.example/"]
    assert one(spark, U.raw_snapshot, u) == ["https://arsip.example/web/20250101000000id_/https://www.x.co.example:8080/a"]
    assert one(spark, U.domain_of, "https://WWW.x.example:81/p", "x", None) == ["x.example:81", "", None]


def test_levels(spark):
    assert one(spark, I.venue_level, "SDN 1", "MTsN 2", "MAN 3", "Pondok X", "Dapur") == ["primary", "junior_secondary", "senior_secondary", "pesantren", None]
    assert one(spark, I.named_venue, " ", "SD (Spesifik tidak disebutkan)", "SDN 1 ") == [None, None, "SDN 1"]


def test_counted_once(spark):
    df = spark.createDataFrame([("e", 2, 33), ("e", 1, 33), ("f", 3, 5)], "cell string, row int, v int")
    got = {(r.row, r.counted) for r in I.counted_once(df, ["cell"], ["row"], "v").collect()}
    assert got == {(1, 33), (2, None), (3, 5)}
    t = I.counted_totals(df, ["cell"], "v").collect()[0]
    assert (t.naive_sum, t.counted_sum) == (71, 38)


def test_lookup(spark):
    ref = spark.createDataFrame([("1.1", "Kota X", "Lama; Baru"), ("1.2", "Kabupaten X", None)], "kode string, nama string, nama_lain string")
    df = spark.createDataFrame([("kota  x",), ("Kota Baru",), ("X",), (None,)], "v string")
    assert [(r.kode, r.how) for r in I.lookup(df, "v", ref).orderBy(F.col("v").asc_nulls_last()).collect()] == [("1.1", "alias"), ("", "none"), ("1.1", "exact"), ("", "none")]


def test_stats(spark):
    k, n = F.lit(8), F.lit(10)
    lo, hi = spark.range(1).select(*wilson(k, n)).collect()[0]
    assert abs(lo - 0.4902) < 1e-3 and abs(hi - 0.9433) < 1e-3
    assert spark.range(1).select(*wilson(F.lit(0), F.lit(0))).collect()[0][0] in (None, 0.0)
    assert abs(fisher_two_sided(8, 2, 1, 5) - 0.03497) < 1e-4


def test_tiers(spark):
    reg = spark.createDataFrame([(1, "SD Negeri 01 Melati", "Desa Sari"), (2, "SDN 1 Mawar", "Melur"), (3, "SMPN 1 Melati", ""), (4, "SDN 2 Kenanga Indah", ""), (5, "SDN 2 Kenanga Baru", "")], "id int, school string, addr string")
    names = spark.createDataFrame([("SDN 1 Melati",), ("SDN 1 Melur",), ("SD 2 Kenanga",), ("Dapur",)], "venue string")
    got = {r.venue: (r.result, r.tier, r.ids) for r in M.tiered(names, reg, "venue", "venue", "id", "school", "addr").collect()}
    assert got == {"SDN 1 Melati": ("matched", "name", "1"), "SDN 1 Melur": ("matched", "address", "2"), "SD 2 Kenanga": ("ambiguous", "name", "4|5"), "Dapur": ("none", "", "")}
    near = spark.createDataFrame([("SDN 1 Melatti",)], "venue string")
    assert [r.ids for r in M.spelling_tier(near, reg, "venue", "venue", "id", "school").collect()] == ["1"]


def test_all_dates(spark):
    assert one(spark, cells.find_dates, "Pada 16 Juli 2013 dan 3/4/2026, lalu bulan Mei 2025, bukan 40 Mei 2025 atau 3/13/2025", "") == [["2013-07-16", "2026-04-03", "2025-05", "2025-05"], []]


def test_labels(spark):
    from kelindan.operators.evaluation import label_problems, repeat_agreement

    df = spark.createDataFrame([(1, " yes ", None), (2, None, 1), (3, "MAYBE", 1), (4, "YES", 1)], "id int, about string, rep int")
    assert sorted((r.id, r.problem) for r in label_problems(df, "id", {"about": ["YES", "NO"]}).collect()) == [(2, "missing"), (3, "invalid")]
    r = repeat_agreement(df.withColumn("l", F.upper(F.trim("about"))), "id", "rep", "l").collect()[0]
    assert (r.n, r.same) == (3, 1)


def test_people_in_prose(spark):
    said = "Dari total 517 siswa, 12 orang siswa dan 3 guru sakit; 1.200 siswa yang terdaftar, 90 penerima manfaat"
    assert one(spark, cells.prose_counts, said, "") == [[3, 12, 90], []]


@pytest.mark.parametrize("seed", range(2))
def test_spellings_against_all_pairs(spark, seed):
    import difflib
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    edit = lambda w: "".join(c for c in w if rng.random() > 0.08) + (rng.choice("abcde") if rng.random() < 0.2 else "")
    school = [(i, [word() for _ in range(rng.randint(1, 3))]) for i in range(60)]
    names = [[edit(w) for w in ws] for _, ws in school]
    reg = spark.createDataFrame([(i, "SDN 1 " + " ".join(ws)) for i, ws in school], "id int, school string")
    ven = spark.createDataFrame([(k, "SDN 1 " + " ".join(n)) for k, n in enumerate(names)], "k int, venue string")
    clean = lambda ws: [w for w in dict.fromkeys(ws) if w and w not in M.FILLER]
    want = {}
    for k, n in enumerate(names):
        w = clean(n)
        hits = [str(i) for i, ws in school if w and all(x in clean(ws) or difflib.get_close_matches(x, clean(ws), n=1, cutoff=0.86) for x in w)]
        if hits:
            want[k] = "|".join(sorted(hits))
    assert {r.k: r.ids for r in M.spelling_tier(ven, reg, "k", "venue", "id", "school").collect()} == want
