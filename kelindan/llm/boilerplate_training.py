"""Fits the weights of ``kelindan.llm.boilerplate``: python -m kelindan.llm.boilerplate_training DATA_DIR [MOST_PAGES].

No table holds labels, so pages of the sample are labelled by the rules below, written from reading pages: they know the landmarks of this corpus
(byline, list of tags, prompts), which the field itself does not get to see as such; it learns from ancestors, text and neighbours. The sample is bounded
by ``MOST_PAGES`` (pages and plain texts each, the first by hash of their id); one in five is held out and scored.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow.dataset as ds

from kelindan.llm.boilerplate import BODY, Chain, features, page_units, save, text_units, train

#: How lines that are not the body begin, or what they hold.
RELATED = re.compile(r"^(?:baca juga|artikel terkait|simak juga|lihat juga|baca selengkapnya|berita terkait)\b", re.I)
PROMPT = re.compile(
    r"kuki|privasi anda|berkas kecil di peramban|buletin mingguan|hanya di galeri|dukung jurnalisme|bagikan artikel|video pilihan redaksi|kanal pesan|"
    r"unduh aplikasi|^advertisement|scroll to resume|rights reserved|tentang kami|^kantor \S+: jalan|seluruh isi|hak cipta pada|berita ini telah tayang|^tag: ",
    re.I,
)
BYLINE = re.compile(r"^(?:penyunting|pewarta|editor|penulis|reporter|oleh|wartawan)\b ?:|^laporan [^.,;]*\d{4}, \d\d[.:]\d\d", re.I)
CAPTION = re.compile(r"^(?:foto|gambar|ilustrasi)\b\.?:", re.I)
SENTENCE = re.compile(r"[.!?][\"”')]*(?: \([0-9a-z]+/[0-9a-z]+\))?$")


def _four(body: list[bool]) -> np.ndarray:
    at = np.nonzero(body)[0]
    out = np.zeros(len(body), dtype=np.int64)
    if len(at):
        out[at[0] : at[-1]] = 2
        out[at[-1] :] = 3
        out[at] = BODY
    return out


def label_page(units: list) -> np.ndarray:
    """The body is what stands between byline and list of tags and is neither caption nor prompt nor link to another article."""
    begin = next((k for k, u in enumerate(units) if BYLINE.search(u[1])), len(units))
    end = next((k for k in range(len(units) - 1, -1, -1) if units[k][1].startswith("Tag:")), len(units))
    return _four([begin < k < end and not RELATED.search(u[1]) and not PROMPT.search(u[1]) and all(t != "figcaption" for t, _ in u[3]) for k, u in enumerate(units)])


def label_text(units: list) -> np.ndarray:
    """The body is every line that ends as a sentence and is no caption, prompt, byline or link to another article."""
    return _four([bool(SENTENCE.search(u[1])) and not any(p.search(u[1]) for p in (RELATED, PROMPT, BYLINE, CAPTION)) for u in units])


def sample(data: str, most: int) -> dict[str, list[tuple[list, np.ndarray]]]:
    pages = ds.dataset(f"{data}/page_cache.parquet").to_table(columns=["page_id", "domain", "html"]).to_pylist()
    docs = ds.dataset(f"{data}/documents.parquet").to_table(columns=["doc_id", "domain", "title", "text", "status"], filter=ds.field("status") == "raw_text").to_pylist()
    spread = lambda i: i * 2654435761 % (1 << 32)
    out: dict[str, list] = {"page": [], "doc": []}
    for p in sorted((p for p in pages if p["html"]), key=lambda p: spread(p["page_id"]))[:most]:
        title, units = page_units(p["html"])
        out["page"].append((list(features(units, title, p["domain"])), label_page(units)))
    for d in sorted((d for d in docs if d["text"]), key=lambda d: spread(d["doc_id"]))[:most]:
        units = text_units(d["text"])
        out["doc"].append((list(features(units, d["title"] or "", d["domain"])), label_text(units)))
    return out


def score(model: Chain, rows: list[tuple[list, np.ndarray]]) -> tuple[float, float]:
    """Precision and recall of body lines."""
    paths = model.decode([model.scores(f, len(f)) for f, _ in rows])
    found = sum(int((p == BODY).sum()) for p in paths)
    true = sum(int((y == BODY).sum()) for _, y in rows)
    both = sum(int(((p == BODY) & (y == BODY)).sum()) for p, (_, y) in zip(paths, rows))
    return both / max(1, found), both / max(1, true)


def fit(data: str, most: int = 500) -> tuple[dict[str, Chain], dict[str, tuple[float, float]]]:
    models, held = {}, {}
    for kind, rows in sample(data, most).items():
        test, learn = rows[::5], [r for k, r in enumerate(rows) if k % 5]
        models[kind] = train([f for f, _ in learn], [y for _, y in learn])
        held[kind] = score(models[kind], test)
    return models, held


if __name__ == "__main__":
    fitted, held_out = fit(sys.argv[1], *map(int, sys.argv[2:3]))
    save(fitted)
    print({k: f"precision {p:.4f}, recall {r:.4f}" for k, (p, r) in held_out.items()})
