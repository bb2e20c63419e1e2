"""Training-data operators against brute force, on small cases: nulls, empties, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA, rows
from kelindan.llm import boilerplate, boilerplate_training, components, hashing, houselines, neardup, packing, refmatch, spans, survivors, tokens
from test_oracles import compare


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n[0] == "p" and n[1].isdigit()])
def test_oracle(spark, duck, name):
    compare(spark, duck, name)


# --- survivors ---------------------------------------------------------------------------------------------------------

CORPUS = "cluster_id string, doc_id string, publish_date string, n_chars int, title string, author string, via string, fetched_at timestamp, kept string"


def test_survivors(spark):
    t = lambda d: datetime(2025, 1, d)
    data = [
        ("c", "b", "2025-02-30", 9, "T", " - ", "origin", t(1), "x"), ("c", "a", "2025-01-02T10:00", None, "U", "A", "wayback", t(2), "x"), ("c", "d", "2025-01-02", 5, " ", "B", None, t(3), "x"),
        ("c", "d", "2025-01-02", 5, " ", "B", None, t(3), "x"), ("c", "e", None, 5, None, "C", "origin", None, "x"), ("one", "f", "2025-01-01", 1, "T", "A", "origin", t(1), "x"), ("one", "f", "2025-01-01", 1, "T", "A", "origin", t(1), "x"),
        (None, "g", None, 1, "T", "A", "origin", t(1), "x"), ("  ", "h", None, 1, "T", "A", "origin", t(1), "x"), ("  ", "i", None, 1, "T", "A", "origin", t(1), "x"), ("n", "j", None, None, None, "-", None, None, "x"), ("n", "k", "kemarin", 0, "", "", None, None, "x"),
    ]
    df = spark.createDataFrame(data, CORPUS)
    assert rows(survivors.best_records(df)) == [("c", "d", "b", "d"), ("n", "j", "", "")]
    assert survivors.best_records(df.limit(0)).count() == 0


def test_fusion_discounts_copies(spark):
    data = []
    for g in range(36):
        # Where six speak against them the copies are outvoted, and seen to share false values; that decides where only three do.
        for k in range(6 if g < 30 else 3):
            data.append((f"g{g}", f"i{k}-{g}", f"i{k}", f"true{g}"))
        for s in ("bad", "copy1", "copy2", "copy3"):
            data.append((f"g{g}", f"{s}-{g}", s, f"false{g}" if g % 2 or g >= 30 else f"true{g}"))
    df = spark.createDataFrame(data, "g string, id string, s string, v string")
    out = survivors.fuse_fields(df, "g", "id", "s", ["v"])
    assert all(r.value.startswith("true") for r in out.collect()) and out.count() == 36
    empty = survivors.fuse_fields(df.limit(0), "g", "id", "s", ["v"])
    assert empty.count() == 0


def test_fusion_counts_values_of_many_sources(spark):
    data = []
    for g in range(33):
        # Ten copies share each false value. They outvote the six that speak against them in the last three groups.
        for k in range(18) if g < 30 else range(6 * (g - 30), 6 * (g - 29)):
            data.append((f"g{g}", f"i{k}-{g}", f"i{k}", f"true{g}"))
        for k in range(10):
            data.append((f"g{g}", f"c{k}-{g}", f"c{k}", f"false{g}" if g % 2 or g >= 30 else f"true{g}"))
    df = spark.createDataFrame(data, "g string, id string, s string, v string")
    out = survivors.fuse_fields(df, "g", "id", "s", ["v"])
    assert all(r.value.startswith("true") for r in out.collect()) and out.count() == 33


def test_fusion_keeps_votes_of_independent_sources(spark):
    rng = random.Random(3)
    data, plain = [], set()
    for g in range(120):
        # Sources that err on their own: where three of the four lesser ones are right, the best one alone does not outvote them.
        said = {s: rng.random() < a for s, a in (("best", 0.9), ("i1", 0.75), ("i2", 0.75), ("i3", 0.75), ("i4", 0.75))}
        data += [(f"g{g}", f"{s}-{g}", s, "true" if right else f"false{rng.randrange(20)}") for s, right in said.items()]
        if sum(said.values()) - said["best"] >= 3:
            plain.add(f"g{g}")
    assert any(r[2] == "best" and r[3] != "true" for r in data if r[0] in plain)
    df = spark.createDataFrame(data, "g string, id string, s string, v string")
    out = {r.g: r.value for r in survivors.fuse_fields(df, "g", "id", "s", ["v"]).collect()}
    assert all(out[g] == "true" for g in plain)


# --- components --------------------------------------------------------------------------------------------------------


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bound", [7, 40, 10**6])
@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, bound, shape):
    rng = random.Random(bound)
    names = [f"{rng.getrandbits(40):x}" for _ in range(150)]
    if shape == "random":
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(110)]
    elif shape == "chain":
        edges = list(zip(names, names[1:])) + [("solo", "solo")]
    else:
        edges = [(names[0], n) for n in names[1:]] * 2
    edges += [(None, "x"), ("y", None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a string, b string, id int")
    got = rows(components.connected_components(df, edges_per_task=bound))
    assert got == sorted(brute_components(edges).items())


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def edited(seed: int, n: int = 25) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 250))]
        out.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 2)] = [word()] * rng.randint(0, 2)
            out.append(t)
    texts = [" ".join(t) for t in out] + ["", None, " .,- ", "satu", "Satu!", "É tât", "e tat"]
    return [(i, t, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_near_duplicates(spark, threshold):
    data = edited(3)
    h = hashing.WordHashes()
    sets = {i: set(neardup.shingle_set(t, 5, h).tolist()) for i, t, _ in data if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(k for k, s in sets.items() if s), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    df = spark.createDataFrame(data + data[:2], "doc_id long, text string, n string")
    pairs, members = neardup.near_duplicates(df, threshold=threshold)
    got = rows(neardup.all_pairs(pairs, members))
    assert len(got) == len(set(got)) and set(got) == want
    assert members.count() == sum(1 for s in sets.values() if s)


def test_near_duplicates_empty(spark):
    pairs, members = neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert pairs.count() == 0 == members.count() == neardup.all_pairs(pairs, members).count()


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.7, 0.9):
        err = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            k = int(600 * 2 * share / (1 + share))
            y = np.r_[x[:k], rng.integers(0, 1 << 63, 600 - k, dtype=np.uint64)]
            err.append(neardup.estimate(neardup.sketch(x)[None], neardup.sketch(y)[None], np.array([600]), np.array([600]))[0] - share)
        assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.06


# --- reference lists ---------------------------------------------------------------------------------------------------


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=6), max_size=12), st.text("abcd", max_size=7), st.integers(0, 3))
def test_trie(names, word, most):
    found = dict((e, d) for d, e in refmatch.Trie([(n, k) for k, n in enumerate(names)]).search(word, most))
    assert found == {k: d for k, n in enumerate(names) if (d := distance(n, word)) <= most}


def test_reference(spark):
    ref = spark.createDataFrame(
        [("1.1", "Kota Melati", "Lama; Baru", "Utara Raya"), ("1.2", "Kabupaten Melati", None, "Utara Raya"), ("1.3", "Kabupaten Bukit Barat", "", "Selatan"), ("1.4", "Kabupaten Bukit Timur", "", "Selatan"), ("1.5", "Kabupaten Kepulauan Sari", None, None), (None, "Kota X", None, None)],
        "code string, name string, other_names string, province string",
    )
    typed = {
        "Kota Melati": "1.1", "KAB. MELATI, Utara Raya": "1.2", "Mélatti (Kt.)": "1.1", "Kodya Mleati": "1.1", "Kab Mleati": "1.2", "Kota Mxyzti": "none", "Bukit Brt.": "1.3", "Bukit-Tmr": "1.4", "bukit  timurr, Provinsi Selatan": "1.4",
        "Kab.KepulauanSari": "1.5", "kep. sari": "1.5", "Kota Bukit Barat": "none", "luar negeri": "none", "Lamaa": "1.1", "Melati": "1.1", "?": "none",
    }
    df = spark.createDataFrame([(k, "Utara Raya", 1) for k in typed] * 2 + [(None, None, 1), ("  ", None, 1)], "v string, p string, code int")
    got = {r.value: r.code for r in refmatch.match_reference(df, "v", ref, "p").collect()}
    assert got == typed
    assert {r.code for r in refmatch.match_reference(df, "v", ref.limit(0)).collect()} == {"none"}
    with pytest.raises(ValueError):
        refmatch.match_reference(df, "v", ref, most_entries=2)


def test_entries_within(spark):
    ref = spark.createDataFrame([("1", "Kota Melati", "Melatu", "X"), ("2", "Kota Melita", None, "X"), ("3", "Kota Mawar", None, "X")], "code string, name string, other_names string, province string")
    df = spark.createDataFrame([("melati",), ("melati",), ("Kota Melatia",), (None,)], "v string")
    assert rows(refmatch.entries_within(df, "v", ref)) == [("Kota Melatia", "1", 1), ("Kota Melatia", "2", 2), ("melati", "1", 0), ("melati", "2", 2)]
    by_length = lambda name: 1 if len(name) < 7 else 2
    assert rows(refmatch.entries_within(df, "v", ref, by_length)) == [("Kota Melatia", "1", 1), ("Kota Melatia", "2", 2), ("melati", "1", 0)]


# --- house lines -------------------------------------------------------------------------------------------------------


def test_house_lines(spark, monkeypatch):
    docs = [(i, f"Isi {i}\n  HAK  Cipta \n\nIsi {i}\nhak cipta", "a", 1) for i in range(5)] + [(9, "Hak cipta", "b", 1), (10, "hak cipta", None, 1), (11, None, "a", 1), (12, "", "a", 1)]
    df = spark.createDataFrame([(*d[:3], "x") for d in docs + docs[:1]], "doc_id long, text string, domain string, line string")
    found = houselines.repeated_lines(df)
    assert rows(found) == sorted([(i, n) for i in range(5) for n in (1, 4)], key=repr)
    kept = {r.doc_id: r.text for r in houselines.drop_lines(df.dropDuplicates(["doc_id"]), found).collect()}
    assert kept[0] == "Isi 0\n\nIsi 0" and kept[9] == "Hak cipta" and kept[11] is None and kept[12] == ""
    assert houselines.repeated_lines(df.limit(0)).count() == 0 and houselines.remove_house_lines(df.limit(0)).columns == df.columns
    want = rows(houselines.drop_lines(df, found))
    assert rows(houselines.remove_house_lines(df), *df.columns) == rows(houselines.drop_lines(df, found), *df.columns) and want
    monkeypatch.setattr(houselines, "MOST_BROADCAST", 0)  # sets beyond the bound are joined
    assert rows(houselines.repeated_lines(df)) == rows(found) and rows(houselines.remove_house_lines(df), *df.columns) == rows(houselines.drop_lines(df, found), *df.columns)


# --- tokens and containers ---------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab \n'sé12., 　😀\t")), max_size=120), st.integers(0, 120), st.integers(1, 40))
def test_join_of_encodings(text, cut, window):
    enc = tokens.encoder()
    whole = tokens.join(tokens.encode_piece(text[:cut], enc), tokens.encode_piece(text[cut:], enc), enc, window)
    assert whole.ids.tolist() == enc.encode_ordinary(text) and whole.text == text


def test_token_ids(spark):
    texts = ["", None, "Halo <|endoftext|> dunia", "kata " * 700, "x" * 3000, "a\n\n b" * 500, "é😀" * 400, " " * 2500]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "", "x"), (3, texts[3], "x")], "doc_id long, text string, ids string")
    enc = tokens.encoder()
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_texts(df, leaf=200).collect())
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(texts)] + [(0, []), (3, enc.encode_ordinary(texts[3]))])
    assert all(enc.decode(ids) == (texts[i] or "") for i, ids in got)
    assert tokens.encode_texts(df.limit(0)).count() == 0


def check_packing(out, sizes, capacity):
    by, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        by[r.container].append((r.offset, r.length))
        pieces[r.item].append((r.start, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = defaultdict(int)
    for item, n in sizes:
        total[item] += n or 0
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: n for k, n in total.items() if n}
    return len(by)


@pytest.mark.parametrize("per_run", [50, 10_000])
def test_packing(spark, per_run):
    rng = random.Random(per_run)
    sizes = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 40), 0])) for i in range(600)] + [(1000, 350), (1001, None), (1002, 100), (1003, 200)]
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "item int, n int, container string")
    out = packing.pack(df, "item", "n", 100, items_per_run=per_run).collect()
    used = check_packing(out, sizes, 100)
    assert sum(n or 0 for _, n in sizes) / 100 / used > 0.9
    assert [r.start for r in sorted(out, key=lambda r: r.start) if r.item == 1000] == [0, 100, 200, 300]
    assert packing.pack(df.limit(0), "item", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, -1)], "item int, n int"), "item", "n", 100)


def test_packing_in_many_runs(spark):
    rng = random.Random(9)
    sizes = [(i, rng.choice([rng.randint(1, 2000), rng.randint(20, 600)])) for i in range(16_000)]
    out = packing.pack(spark.createDataFrame(sizes, "item int, n int"), "item", "n", 2048, items_per_run=2_000).collect()  # 8 runs, then those of what they leave open
    assert sum(n for _, n in sizes) / 2048 / check_packing(out, sizes, 2048) > 0.98


def test_filter(spark):
    rng = np.random.default_rng(2)
    keys, others = rng.integers(0, 1 << 64, 3000, dtype=np.uint64), rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long")
    for bits in (16, 20):
        cells = np.frombuffer(hashing.bounded_filter(df, "k", bits), dtype=np.uint8)
        assert hashing.in_filter(cells, keys, bits).all() and hashing.in_filter(cells, others, bits).mean() < {16: 0.01, 20: 0.0005}[bits]


# --- shared spans ------------------------------------------------------------------------------------------------------


def brute_spans(data, span):
    where, words = defaultdict(set), {}
    for i, t in data:
        if i is None or t is None:
            continue
        words[i] = spans.span_words(t)
        for k in range(len(words[i]) - span + 1):
            where[tuple(words[i][k : k + span])].add(i)
    out = set()
    for i, w in words.items():
        mask = np.array([len(where[tuple(w[k : k + span])]) > 1 for k in range(max(0, len(w) - span + 1))], dtype=bool)
        starts = np.nonzero(mask)[0]
        if len(starts):
            new = np.r_[True, np.diff(starts) > span]
            out |= {(i, int(s), int(e) + span) for s, e in zip(starts[new], starts[np.r_[new[1:], True]])}
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shards, cuts, bits", [(100_000, 1 << 20, 26), (5, 400, 17), (100_000, 400, 20)])
def test_shared_spans(spark, seed, shards, cuts, bits):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    pool = [[word() for _ in range(rng.randint(8, 40))] for _ in range(12)]
    data = []
    for i in range(40):
        t = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            t += [word() for _ in range(rng.randint(0, 9))] + p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
        data.append((i, rng.choice([" ", "\n", "  \t"]).join(t)))
    data += [(90, None), (91, ""), (None, data[0][1]), (92, " ".join(["la"] * 50)), (93, " ".join(["ya"] * 30 + ["la"] * 20))]
    df = spark.createDataFrame([(i, t, 0) for i, t in data] + [(*data[1], 0)], "doc_id long, text string, at int")
    got = rows(spans.shared_spans(df, span=12, phrase=5, phrases_per_shard=shards, bytes_per_task=cuts, bits=bits))
    assert len(got) == len(set(got)) and set(got) == brute_spans(data, 12)


def test_shared_spans_of_one_long_text(spark):
    rng = random.Random(4)
    long = [f"w{rng.randint(0, 5_000)}" for _ in range(50_000)]
    docs = [(1, " ".join(long)), (2, "x y " + " ".join(long[:-3])), (3, " ".join(long[::-1][:900]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for shards in (100_000, 100):
        assert rows(spans.shared_spans(df, phrases_per_shard=shards)) == [(1, 0, 49_997), (2, 2, 49_999)]


def test_shared_spans_empty(spark):
    assert spans.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- main content ------------------------------------------------------------------------------------------------------


def test_field_learns_and_decodes():
    sample = boilerplate_training.sample(DATA, 60)
    for kind in ("page", "doc"):
        made = sample[kind]
        if len(made) < 4:
            continue
        p, r = boilerplate_training.score(boilerplate.load()[kind], made)
        assert p > 0.97 and r > 0.97
    learned = boilerplate.train([f for f, _ in sample["page"]], [y for _, y in sample["page"]], least=2, epochs=8)
    p, r = boilerplate_training.score(learned, sample["page"])
    assert p > 0.9 and r > 0.9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    chain = boilerplate.Chain({f"f{k}": k for k in range(6)}, rng.normal(size=(6, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4))
    for n in (0, 1, 2, 5):
        s = [[f"f{rng.integers(6)}", f"f{rng.integers(6)}"] for _ in range(n)]
        e = chain.scores(s, n)
        value = lambda p: chain.first[p[0]] + chain.last[p[-1]] + sum(e[i, y] for i, y in enumerate(p)) + sum(chain.steps[a, b] for a, b in zip(p, p[1:]))
        got = chain.decode([e, chain.scores([["f1"]], 1)])[0].tolist()
        assert len(got) == n and (not n or abs(value(got) - max(map(value, itertools.product(range(4), repeat=n)))) < 1e-9)


def test_decoding_side_by_side(monkeypatch):
    rng = np.random.default_rng(8)
    chain = boilerplate.Chain({}, np.zeros((0, 4)), rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4))
    scores = [rng.normal(size=(int(n), 4)) for n in (0, 3, 900, 1, 40, 41, 0)]
    alone = [chain.decode([e])[0].tolist() for e in scores]
    for most in (1, 100, 1 << 18):
        monkeypatch.setattr(boilerplate, "MOST_STEPS", most)
        assert [p.tolist() for p in chain.decode(scores)] == alone


def test_gradient():
    rng = np.random.default_rng(1)
    n, rows_, y = 3, [[np.array([0]), np.array([1, 2]), np.array([2])]], [np.array([0, 1, 3])]
    theta = rng.normal(size=n * 4 + 16 + 8)

    def loss(t):
        w, steps, first, last = boilerplate._unpack(t, n)
        e = np.array([w[r].sum(axis=0) for r in rows_[0]])
        value = lambda p: first[p[0]] + last[p[-1]] + sum(e[i, v] for i, v in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:]))
        return np.log(sum(np.exp(value(p)) for p in itertools.product(range(4), repeat=3))) - value(y[0].tolist())

    g = boilerplate._gradient(theta, rows_, y, n)
    for k in range(0, len(theta), 5):
        d = np.zeros_like(theta)
        d[k] = 1e-5
        assert abs((loss(theta + d) - loss(theta - d)) / 2e-5 - g[k]) < 1e-5


def test_body_lines(spark):
    html = "<html><head><title>Judul berita</title><script>var x='Kalimat di skrip.';</script></head><body>\n<nav><a href=/a>Beranda</a></nav>\n<h1>Judul berita</h1>\n<p>Kepala sekolah mengatakan siswa pulang pada hari Senin siang.\n<p>Menurut dokter, mereka dirawat selama dua hari di puskesmas.\n</body>"
    df = spark.createDataFrame([(1, html, "s.example", 0), (1, html, "s.example", 0), (2, None, None, 0), (3, "", "x", 0), (None, html, "x", 0), (4, "<<<a href='", None, 0)], "page_id long, html string, domain string, line_no int")
    got = rows(boilerplate.body_lines(df, "page_id", "html", "domain", None, "page"))
    assert len(got) == len(set(got)) and {1} >= {r[0] for r in got} and all(r[1] >= 3 for r in got)
    assert boilerplate.body_lines(df.limit(0), "page_id", "html", "domain", None, "page").count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p6_found", "p8_ids", "p9_packed", "p5_found", "p10_found", "p1_fused"])
def test_queries(spark, name):
    columns = {"p3_found": ["origin", "rec_id", "line_no"], "p6_found": ["incident_id", "kabkota_kode"], "p8_ids": ["doc_id", "ids"], "p5_found": ["doc_a", "doc_b"], "p10_found": ["doc_id", "start_word", "end_word"]}
    df = entry.queries()[name](spark, DATA)
    assert df.count() > 0 and df.columns == columns.get(name, df.columns)
