"""Tables and citations of wiki markup, as Python table functions: merged cells are carried down and across, and keep the cell they were written in."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import functions as F

# Fields of a citation with the parameter names that mean them, first one present first.
ALIASES = {
    "url": ("url", "URL", "tautan"),
    "title": ("title", "judul"),
    "work": ("work", "website", "situsweb", "situs web", "newspaper", "surat kabar", "magazine", "majalah", "publisher", "penerbit"),
    "date": ("date", "tanggal"),
    "access_date": ("access-date", "accessdate", "tanggal-akses", "tanggal akses", "diakses tanggal", "diakses-tanggal"),
    "archive_url": ("archive-url", "archiveurl", "arsip-url", "url-arsip"),
    "archive_date": ("archive-date", "archivedate", "arsip-tanggal", "tanggal-arsip"),
    "author": ("author", "penulis", "last", "nama-akhir"),
    "language": ("language", "bahasa"),
}
# Templates that are citations.
CITE = frozenset("cite web|cite news|cite journal|cite book|citation|cite press release|cite report".split("|"))


class MarkupError(ValueError):
    """The page does not have the table that was asked for, or one that cannot be read without guessing."""


def section_lines(text: str, section: str) -> list[str]:
    """Lines of the first table below a heading whose path of titles holds ``section`` ('' for any)."""
    path: dict[int, str] = {}
    table: list[str] = []
    for line in text.split("\n"):
        if heading := re.match(r"^(={2,6})\s*(.*?)\s*\1\s*$", line):
            level = len(heading[1])
            path = {k: v for k, v in path.items() if k < level} | {level: heading[2]}
        if table or (line.startswith("{|") and (not section or any(section in t for t in path.values()))):
            table.append(line)
            if line.startswith("|}"):
                return table
    raise MarkupError("no table found" if not table else "the table does not end")


def cells_of(lines: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(text, rowspan, colspan, header) of every written cell, by row. Several cells on one line are refused rather than guessed at."""
    rows: list[list[list]] = [[]]
    for line in lines:
        if line[:2] in ("{|", "|}", "|+"):
            continue
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in ("|", "!"):
            if "||" in line or "!!" in line:
                raise MarkupError(f"several cells on one line: {line[:80]!r}")
            body, spans = line[1:], {}
            head, bar, rest = body.partition("|")
            if bar and re.fullmatch(r"""\s*(?:[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'|]+)\s*)+""", head, re.I) and not rest.startswith("|"):
                body, spans = rest, {k.lower(): int(v) for k, v in re.findall(r"""(rowspan|colspan)\s*=\s*["']?(\d+)""", head, re.I)}
            rows[-1].append([body.strip(), max(1, spans.get("rowspan", 1)), max(1, spans.get("colspan", 1)), line[0] == "!"])
        elif rows[-1]:
            rows[-1][-1][0] += "\n" + line.strip()
    return [[tuple(c) for c in r] for r in rows if r]


def resolve(rows: list[list[tuple[str, int, int, bool]]], width: int) -> list[list[tuple[str, int, int, bool]]]:
    """(text, origin row, origin column, is origin) of every displayed cell. A row must fill the width exactly."""
    below: dict[tuple[int, int], tuple[str, int, int]] = {}
    grid = []
    for r, written in enumerate(rows):
        shown: list[tuple[str, int, int, bool]] = []
        queue = list(written)
        while len(shown) < width and ((r, len(shown)) in below or queue):
            if carried := below.pop((r, len(shown)), None):
                shown.append((*carried, False))
                continue
            text, down, across, _ = queue.pop(0)
            for k in range(across):
                at = len(shown)
                shown.append((text, r, at, k == 0))
                below |= {(r + d, at): (text, r, at) for d in range(1, down)}
        if len(shown) != width or queue:
            raise MarkupError(f"row {r} has not {width} cells")
        grid.append(shown)
    return grid


def reference_ids(fragment: str) -> list[str]:
    """Keys of the references in a fragment, each once, in order: the name, else a hash of the contents."""
    out = []
    for attrs, body in re.findall(r"<ref\b([^>]*?)(?:/>|>(.*?)</ref>)", fragment, re.S | re.I):
        if (key := _reference_key(attrs, body)) and key not in out:
            out.append(key)
    return out


def _reference_key(attrs: str, body: str) -> str | None:
    name = re.search(r"""name\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/>]+))""", attrs, re.I)
    if name and (given := next(g for g in name.groups() if g is not None).strip()):
        return given
    collapsed = " ".join(body.split())
    return "auto:" + hashlib.md5(collapsed.encode()).hexdigest()[:10] if collapsed else None


def plain_text(fragment: str) -> str:
    """A cell's text: references, comments and markup set aside, links by what they show."""
    t = re.sub(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref>|<!--.*?-->", "", fragment, flags=re.S | re.I)
    t = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", re.sub(r"<br\s*/?>", " ", t, flags=re.I))
    t = re.sub(r"\[https?://\S+\s+([^\]]*)\]", r"\1", t)
    return " ".join(re.sub(r"<[^>]+>|'{2,}", "", t).replace("&nbsp;", " ").replace("\xa0", " ").split())


def table_rows(text: str, section: str, header: list[str] | None) -> Iterator[tuple[int, list[str], list[str], list[str], list[str]]]:
    """(grid row, texts, link targets, origins, reference ids) of the rows of the body; the header must have the given labels, if any are given."""
    rows = cells_of(section_lines(text, section))
    heads = next((k for k, r in enumerate(rows) if not all(c[3] for c in r)), len(rows))
    width = sum(c[2] for c in rows[0]) if rows else 0
    top = resolve(rows[:heads], width)
    if header is not None and [plain_text(c[0]) for c in (top[-1] if top else [])] != list(header):
        raise MarkupError("the header is not the expected one")
    for k, cells in enumerate(resolve(rows[heads:], width)):
        links = [(re.search(r"\[\[([^\]|]+)", c[0]) or ["", ""])[1].strip() for c in cells]
        yield k, [plain_text(c[0]) for c in cells], links, [f"{c[1]},{c[2]}" for c in cells], reference_ids("\n".join(c[0] for c in cells))


def citations(text: str) -> Iterator[dict[str, str]]:
    """One record per reference that has contents: its templates (second and later ones with a number added to the key), else its bare link."""
    for attrs, body in re.findall(r"<ref\b([^>/]*)>(.*?)</ref>", text, re.S | re.I):
        key = _reference_key(attrs, body)
        if not key or not body.strip():
            continue
        found = [t for t in _templates(body) if t[0] in CITE]
        for k, (name, params) in enumerate(found):
            fields = {f: next((params[a] for a in aliases if a in params), "") for f, aliases in ALIASES.items()}
            yield {"ref_id": key if k == 0 else f"{key}.{k}", "template": name, **fields}
        if not found and (bare := re.search(r"\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]", body)):
            yield {"ref_id": key, "template": "bare_link", **{f: "" for f in ALIASES}, "url": bare[1], "title": (bare[2] or "").strip()}


def _templates(body: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Name and parameters of the outer templates; bars inside links and inner templates do not separate."""
    depth, start = 0, 0
    for m in re.finditer(r"\{\{|\}\}", body):
        if m[0] == "{{":
            if depth == 0:
                start = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                parts = re.split(r"\|(?![^\[]*\]\])(?![^{]*\}\})", body[start : m.start()])
                yield " ".join(parts[0].split()).lower(), {k.strip(): v.strip() for k, eq, v in (p.partition("=") for p in parts[1:]) if eq}


@F.udtf(returnType="table_row int, cells array<string>, links array<string>, origins array<string>, ref_ids array<string>")
class WikiTable:
    """Lateral: ``SELECT * FROM pages, LATERAL wiki_table(wikitext, section)``; one row per displayed row of the body."""

    def eval(self, text: str, section: str):
        if text is not None:
            yield from table_rows(text, section or "", None)


@F.udtf(returnType=", ".join(f"{c} string" for c in ("ref_id", "template", *ALIASES)))
class WikiCitations:
    """Lateral: one row per citation of a page."""

    def eval(self, text: str):
        for c in citations(text or ""):
            yield tuple(c[k] for k in ("ref_id", "template", *ALIASES))


def register(spark) -> None:
    """Makes both functions callable from SQL."""
    spark.udtf.register("wiki_table", WikiTable)
    spark.udtf.register("wiki_citations", WikiCitations)
