from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from conftest import rows
from kelindan.sources import files, listings, schemas, wikitext
from kelindan.sources.feed import LandedFeed
from kelindan.streaming import feeds

PAGE = """== Daftar ==
=== Tabel kejadian ===
{| class="wikitable"
! Tanggal
! Tempat
! Korban
|-
| rowspan="2" | 1 Mei 2025<ref name="a">{{cite web |url=https://x.example/1 |judul=Satu [[b|c]] |tanggal=2 Mei 2025}}{{cite news|url=https://x.example/2}}</ref>
| [[SDN 1 Batu|SDN 1]]
| rowspan=2 | 33 Santri
|-
| SDN 2<br>Baru<ref>[https://y.example/z Judul lepas]</ref><ref name="a" />
|-
| colspan="2" | TOTAL
| 33
|}
"""


def test_grid():
    got = list(wikitext.table_rows(PAGE, "Tabel", ["Tanggal", "Tempat", "Korban"]))
    assert [g[1] for g in got] == [["1 Mei 2025", "SDN 1", "33 Santri"], ["1 Mei 2025", "SDN 2 Baru", "33 Santri"], ["TOTAL", "TOTAL", "33"]]
    assert got[1][3] == ["0,0", "1,1", "0,2"] and got[0][2][1] == "SDN 1 Batu"
    assert got[0][4] == ["a"] and got[1][4][0] == "a" and got[1][4][1].startswith("auto:")
    assert got[2][3] == ["2,0", "2,1", "2,2"]


@pytest.mark.parametrize("text, section, header", [("kosong", "", None), (PAGE, "Lain", None), (PAGE, "Tabel", ["A", "B", "C"]), (PAGE.replace("| 33\n", "| 33\n| 34\n"), "", None), (PAGE.replace("| 33\n", "| 33 || 34\n"), "", None)])
def test_refusals(text, section, header):
    with pytest.raises(wikitext.MarkupError):
        list(wikitext.table_rows(text, section, header))


def test_citations():
    a, b, c = wikitext.citations(PAGE)
    assert (a["ref_id"], a["title"], a["date"], b["ref_id"], b["url"]) == ("a", "Satu [[b|c]]", "2 Mei 2025", "a.1", "https://x.example/2")
    assert c["template"] == "bare_link" and c["title"] == "Judul lepas"


def test_table_functions(spark):
    wikitext.register(spark)
    spark.createDataFrame([("p", PAGE), ("q", None)], "page string, wikitext string").createOrReplaceTempView("pages_")
    got = spark.sql("SELECT page, t.table_row, t.cells[2] AS n FROM pages_, LATERAL wiki_table(wikitext, 'Tabel') t")
    assert rows(got) == [("p", 0, "33 Santri"), ("p", 1, "33 Santri"), ("p", 2, "33")]
    assert spark.sql("SELECT c.ref_id FROM pages_, LATERAL wiki_citations(wikitext) c").count() == 3


LISTS = [
    ("detik", '<article><a href="https://d.example/1?a=1&amp;b=2"><img alt="Satu"></a><span>Senin, 3 Mei 2025 10:00</span></article><article>x</article>'),
    ("antara", '<div class="card__post card__post-list"><h2 class="h5"><a href="https://a.example/berita/1">Dua</a></h2><span>4 Agustus 2025</span></div><div class="card__post card__post-list"><h2 class="h5"><a href="https://a.example/video/1">V</a></h2></div>'),
    ("kompas", '<div class="articleItem"><a class="article-link" href="https://k.example/1"></a><h2 class="articleTitle">Tiga</h2><div class="articlePost-date">5 Des 2025</div></div>'),
    ("cnn", '<article><a href="https://c.example/nasional/20250607080910-20-1/x"><h2 class="t">Empat</h2></a><span>2 minggu lalu</span></article>'),
    ("liputan6", '<article class="articles--iridescent-list--text-item" data-title="Lima &amp; enam"><a href="https://l.example/news/read/55/x"></a><time datetime="2025-07-08T01:00"></time></article>'),
    ("baru", '<article><a href="https://n.example/1"><img alt="Tujuh"></a></article>'),
    ("detik", None),
]


def test_listings(spark):
    df = spark.createDataFrame([(o, "p", h) for o, h in LISTS], "outlet string, origin string, html string")
    got = {r.title: (r.outlet, r.url, r.listed_date) for r in listings.parse_listings(df).collect()}
    assert got == {
        "Satu": ("detik", "https://d.example/1?a=1&b=2", "2025-05-03"),
        "Dua": ("antara", "https://a.example/berita/1", "2025-08-04"),
        "Tiga": ("kompas", "https://k.example/1", "2025-12-05"),
        "Empat": ("cnn", "https://c.example/nasional/20250607080910-20-1/x", "2025-06-07"),
        "Lima & enam": ("liputan6", "https://l.example/news/read/55/x", "2025-07-08"),
        "Tujuh": ("baru", "https://n.example/1", None),
    }


def test_feed_ends(spark):
    items = [("o", p, f"{'racun' if p < 3 or i == 9 else 'bola'} {p} {i}", f"2025-0{9 - p}-01") for p in range(1, 5) for i in range(10)]
    df = spark.createDataFrame(items, "outlet string, page int, title string, listed_date string")
    assert {r.page for r in listings.cut_feed(df, "racun").collect()} == {1, 2}
    assert {r.page for r in listings.cut_feed(df, "racun|bola", since="2025-08-15").collect()} == {1}


def test_feed_stream(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / "in/detik").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/detik/page={n}.html").write_text(f'<article><a href="https://d.example/{n % 2}"><img alt="T{n}"></a></article>')
    spark.dataSource.register(LandedFeed)
    pages = spark.readStream.format("landed_feed").options(path=str(tmp_path / "in"), outlet="detik", pages_per_batch="2").load()
    for _ in range(2):  # a restart goes on after the last page
        feeds.split_sinks(pages, F.col("page") < 3, str(tmp_path / "on"), str(tmp_path / "off"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "on")).count() == 2 and spark.read.parquet(str(tmp_path / "off")).count() == 1
    assert listings.parse_listings(spark.read.parquet(str(tmp_path / "on"))).dropDuplicates(["url"]).count() == 2


def test_files(spark, tmp_path):
    schema = PT.StructType.fromDDL("id int, s string, xs array<string>, m map<string,int>")
    df = spark.createDataFrame([(1, 'a "q", b', ["x", "y"], {"k": 1}), (2, "", [], {}), (3, None, None, None)], schema)
    files.write_nested_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_nested_csv(spark, str(tmp_path / "csv"), schema)) == rows(df)
    df.write.json(str(tmp_path / "jsonl"))
    assert files.read_jsonl(spark, str(tmp_path / "jsonl"), schema).count() == 3
    assert files.write_run({"t": df}, str(tmp_path / "runs"), "20250101T000000Z") == {"t": 3}
    files.write_run({"t": df.limit(1)}, str(tmp_path / "runs"), "20250102T000000Z")
    assert files.latest_run(spark, str(tmp_path / "runs"), "t").count() == 1
    with pytest.raises(Exception):
        files.write_run({"t": df}, str(tmp_path / "runs"), "20250101T000000Z")
    assert files.file_digests(spark, str(tmp_path / "jsonl")).where("length(sha256) = 64").count() >= 1
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt/abc.txt").write_text("isi")
    led = spark.createDataFrame([("u", "cache/ab/abc.html.gz"), ("v", "cache/x/none.html.gz")], "url string, cache_path string")
    assert rows(files.attach_cached(led, files.read_whole(spark, str(tmp_path / "txt"))), "url", "text") == [("u", "isi")]
    (tmp_path / "d.sql").write_text("INSERT INTO w VALUES ('11','Aceh',4.1,96.2),('11.01','Kabupaten O''X',NULL,2.5),('11.01.01','Z',1,2);")
    assert rows(files.read_region_dump(spark, str(tmp_path / "d.sql"))) == [("11.01", "11", "Aceh", "Kabupaten O'X", None, 2.5)]
    assert schemas.LEDGER["ref_ids"].dataType == PT.ArrayType(PT.StringType())


def test_tables_of_pages(spark):
    html = '<table><tr><th>No</th><th>Nama</th></tr><tr><td>1</td><td><a href="/w/11">Kab. <b>A</b></a></td></tr><tr><td>2</td><td>B</td></tr></table><tr></tr>'
    df = spark.createDataFrame([("p", "atas", html), ("q", "atas", None)], "page string, parent string, html string")
    assert [r.cells for r in listings.html_tables(df, "page").orderBy("row").collect()] == [["No", "Nama"], ["1", "Kab. A"], ["2", "B"]]
    assert rows(listings.register(df, "page", "parent"), "parent", "name", "link") == [("atas", "Kab. A", "/w/11")]


def test_incidents_from_markup(spark):
    from kelindan.operators import wiki as W

    head = "\n".join(f"! {c}" for c in W.COLUMNS)
    text = f"""== Lain ==
{{|
! x
|}}
== Daftar Indonesia ==
{{|
|-
{head}
|-
|
| Kosong
|
|
|
|
|
|-
| 2 Mei 2025
| JAWA
| [[Kota Batu|Batu]]
| SDN 1
| rowspan="2" | 45 Siswa dan Guru
|
| <ref name="a"/>
|-
| Mei 2025
| Entah
| Batu
| SD (spesifik tidak disebutkan)
| 1 orang
| <ref name="a"/><ref name="b"/>
|-
| Belum jelas
| Jawa
| [[Kota Jauh]]
| Pondok X
| Ratusan Siswa
|
|
|-
| colspan="4" | TOTAL
| 45
|
|
|}}"""
    pages = spark.createDataFrame([("p", text)], "page string, wikitext string")
    seen = W.read_pages(pages, "page", "wikitext", "Indonesia")
    assert [tuple(r) for r in W.page_report(seen, "page").collect()] == [("p", 5, 3, 1, "45")]
    cites = spark.createDataFrame([("a", 1, "http://u1", None), ("a.1", 2, "http://u2", "http://w/u2")], "ref_id string, citation_id long, url string, archive_url string")
    codes = spark.createDataFrame([("1.1", "Kota Batu", None, "Timur")], "kode string, nama string, nama_lain string, provinsi string")
    codes = codes.union(spark.createDataFrame([("2.1", "Kota Y", None, "Jawa")], codes.schema))
    i = W.normalise(seen, "page", cites, codes)
    got = {r.table_row: r for r in i.collect()}
    assert {k: r.flags for k, r in got.items()} == {
        1: ["kabkota_province_mismatch", "unnumbered_subject"],
        2: ["month_precision_only", "unknown_province", "kabkota_unlinked", "kabkota_no_kode", "no_venue", "unnumbered_subject", "count_shared_across_rows"],
        3: ["no_date", "kabkota_no_kode", "count_vague", "no_source_url"],
    }
    assert got[1].source_urls == ["http://u1", "http://w/u2"] and got[1].symptomatic_counted == 45 and got[2].symptomatic_counted is None
    e = {r.event_id: r for r in W.collapse(i).collect()}
    one = e["p#e0001"]
    assert (one.date_start, one.n_rows, one.deaths, one.venues, one.incident_ids) == ("2025-05", 2, 1, ["SDN 1"], ["p#r0001", "p#r0002"]) and len(e) == 2
    facts = {r.name: r.value for r in W.quality(i).collect()}
    assert facts["rows"] == "3" and facts["counted"] == "45" and facts["naive"] == "90" and facts["flag count_vague"] == "1"
    assert W.normalise(seen.limit(0), "page", cites, codes).count() == 0


def test_outside_a_local_session_the_shared_folder_must_be_named():
    from kelindan.session import shared_dir

    class Context:
        master = "spark://x:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, other):
            return other

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_writers(spark, tmp_path):
    from kelindan.functions import lexicon
    from kelindan.sources import files as W

    df = spark.createDataFrame([(2, None, ["a"]), (1, "2025", [])], "doc_id int, publish_date string, refs array<string>")
    assert W.write_jsonl(df, f"{tmp_path}/j") == 2 and W.write_nested_csv(df, f"{tmp_path}/c") == 2 and W.write_corpus(df, f"{tmp_path}/o") == 2
    assert W.write_nested_csv(df.limit(0), f"{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
    assert [r.doc_id for r in spark.read.json(f"{tmp_path}/o").collect()] == [2, 1]
    for run in ("20250101T000000Z", "20250202T000000Z"):
        assert W.write_run({"t": df}, f"{tmp_path}/runs", run) == {"t": 2}
    W.point_to(spark, f"{tmp_path}/runs", "20250101T000000Z")
    assert W.pointed_run(spark, f"{tmp_path}/runs", "t").count() == 2
    W.point_to(spark, f"{tmp_path}/runs", "20250202T000000Z")
    assert W.read_report(spark, f"{tmp_path}/runs/_latest") == {"run_id": "20250202T000000Z"}
    made = json.loads(W.lexicon_manifest(lexicon.version(), {"t": 2}, W.file_digests(spark, f"{tmp_path}/j")))
    assert len(made["rules"]) == 16 and made["rows"] == {"t": 2} and made["inputs"]
