"""Main content of pages: a linear-chain conditional random field over the lines of a page.

A DOM leaf block that spans several lines is one unit per line, as results are lines. Each unit has features of its ancestors (tags, class names without
their digits), of its text (length, links, punctuation, first words, the site's name, the page's title) and of its neighbours, and one of four
labels: before the body, body, between parts of the body, after it. The most likely labelling is decoded by Viterbi. Plain texts are the
same without ancestors, with weights of their own. The weights are fitted by ``train`` on labelled pages and stored beside this module.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("before", "body", "between", "after")
BODY = 1
MODEL = Path(__file__).with_name("boilerplate_model.json")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style head title noscript template".split())
_INLINE = frozenset("a abbr b cite code em font i mark s small span strong sub sup time u".split())
#: Opening one of these ends an open one of its kind, as markup is not always closed.
_ENDS = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dd": "dd", "dt": "dd", "option": "option"}
_BLOCKS = frozenset("p div li ul ol section article aside main header footer nav h1 h2 h3 h4 h5 h6 blockquote table figure form center".split())


class _Lines(HTMLParser):
    """Visible text of every line, with the ancestors of its first character and how much of it is in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.lines: dict[int, list] = {}
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            if tag == "br" and (line := self.lines.get(self.getpos()[0] - 1)):
                line[3] += 1
            return
        if tag in _BLOCKS and any(t == "p" for t, _ in self.stack[-4:]):
            self._close("p")
        if tag in _ENDS and self.stack and self.stack[-1][0] == _ENDS[tag]:
            self.stack.pop()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        self.stack.append((tag, re.sub(r"\d+", "#", names)))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        tags = {t for t, _ in self.stack}
        if tags & _UNSEEN:
            if "title" in tags:
                self.title += data
            return
        first = self.getpos()[0] - 1
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                line = self.lines.setdefault(first + k, ["", 0, list(self.stack), 0])
                line[0] += part
                line[1] += len(part.strip()) if "a" in tags else 0


def page_units(html: str) -> tuple[str, list[tuple[int, str, float, list[tuple[str, str]], int]]]:
    """Title, and (line_no, text, share in links, ancestors, line breaks) of every line with visible text."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    units = []
    for no, (text, linked, stack, breaks) in sorted(parser.lines.items()):
        text = " ".join(text.split())
        units.append((no, text, min(1.0, linked / max(1, len(text))), stack, breaks))
    return parser.title, units


def text_units(text: str) -> list[tuple[int, str, float, list[tuple[str, str]], int]]:
    """(line_no, text, ...) of every line of a plain text that is not blank."""
    return [(no, " ".join(line.split()), 0.0, [], 0) for no, line in enumerate(text.split("\n")) if line.strip()]


_END = re.compile(r"""[.!?][\"”')\]]*(?: ?\([0-9a-z]+/[0-9a-z]+\))?$""")
_STOP = re.compile(r"[.!?][\"”']? ")
_USER = re.compile(r"^@?[a-z]+[._]?\d+ ?: ")
_SITE = re.compile(r"[a-z]+")


def _bucket(x: float, bounds: tuple) -> int:
    return sum(x > b for b in bounds)


def features(units: list, title: str, domain: str | None) -> Iterator[list[str]]:
    """Names of the features of every unit, in reading order, one unit at a time: only five units' are held at once."""
    site = max(_SITE.findall((domain or "").split(".")[0].lower()), key=len, default="")
    head = " ".join(title.split()).lower()
    groups: dict[str, int] = {}
    keys = []
    for _, text, _, stack, _ in units:
        blocks = [t for t in stack if t[0] not in _INLINE]
        key = ".".join(blocks[-1]) if blocks else ""
        keys.append(key)
        if _END.search(text):
            groups[key] = groups.get(key, 0) + len(text)
    total = sum(groups.values()) or 1

    def of(k: int) -> list[str]:
        (_, text, linked, stack, breaks), key = units[k], keys[k]
        low = text.lower()
        f = [
            f"len{_bucket(len(text), (8, 20, 40, 80, 160, 320, 640))}",
            f"link{_bucket(linked, (0.0, 0.1, 0.3, 0.7, 0.95))}",
            f"end{int(bool(_END.search(text)))}",
            f"stops{min(4, len(_STOP.findall(text)))}",
            f"low{int(text[0].islower())}",
            f"bars{min(3, text.count('|') + text.count('»') + text.count(' / ') + text.count(' > '))}",
        ]
        if site and site in low.replace(" ", ""):
            f.append("site")
        if head and (low in head or head in low or (len(low) > 30 and low[:40] in head)):
            f.append("title")
        if _USER.match(low):
            f.append("user")
        words = re.findall(r"\w+", low)
        f += [f"w={w}" for w in words[:1]] + [f"ww={' '.join(words[:2])}"] * (len(words) > 1)
        if len(words) < 25:
            f += [f"s={w}" for w in words]
        if ":" in text[:25]:
            f.append("colon=" + low[: low.index(":")].strip())
        if stack:
            f += [f"tag={t}" for t in {t for t, _ in stack}] + [f"class={c}" for c in {c for _, c in stack if c}]
            f += [f"leaf={key}", f"share{_bucket(groups.get(key, 0) / total, (0.0, 0.1, 0.3, 0.6))}", f"br{min(2, breaks)}"]
            f += [f"inline={stack[-1][0]}"] * (stack[-1][0] in _INLINE)
        return f

    own = {k: of(k) for k in range(min(2, len(units)))}
    for k in range(len(units)):
        if k + 2 < len(units):
            own[k + 2] = of(k + 2)
        own.pop(k - 3, None)
        near = ["bias"]
        for d in (-2, -1, 1, 2):
            if 0 <= k + d < len(units):
                near += [f"{d}:{x}" for x in own[k + d][:5]] + [f"{d}:{x}" for x in own[k + d][6:8] if x in ("site", "title", "user")]
                if keys[k + d] == keys[k]:
                    near.append(f"{d}:same")
            else:
                near.append(f"{d}:edge")
        yield own[k] + near


#: Steps of sequences that are decoded side by side, padded ones counted.
MOST_STEPS = 1 << 18


class Chain:
    """A linear-chain CRF: feature weights per label, transition, first and last weights."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.names, self.weights, self.steps, self.first, self.last = names, weights, steps, first, last

    def scores(self, rows: Iterable[list[str]], n: int) -> np.ndarray:
        """What each label scores at each of ``n`` units by its own features."""
        get, w, out = self.names.get, self.weights, np.zeros((n, len(LABELS)))
        for k, row in enumerate(rows):
            out[k] = w[[i for f in row if (i := get(f)) is not None]].sum(axis=0)
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all sequences, those of about one length side by side: what is held grows with the units there are, however long one sequence is."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(scores)
        order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
        while order:
            longest, many = len(scores[order[-1]]), 1
            while many < len(order) and (many + 1) * longest <= MOST_STEPS:
                many += 1
            batch, order = order[-many:], order[:-many]
            for k, path in zip(batch, self._decode([scores[k] for k in batch])):
                out[k] = path
        return out

    def _decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(s) for s in scores])
        n, t = len(scores), int(lengths.max())
        e = np.zeros((n, t, len(LABELS)))
        for k, s in enumerate(scores):
            e[k, : len(s)] = s
            e[k, len(s) - 1] += self.last
        best, back = e[:, 0] + self.first, np.zeros((n, t, len(LABELS)), dtype=np.int8)
        ends = best.copy()
        for i in range(1, t):
            way = best[:, :, None] + self.steps[None]
            back[:, i] = way.argmax(axis=1)
            best = way.max(axis=1) + e[:, i]
            ends = np.where((lengths > i)[:, None], best, ends)
        out = []
        for k, length in enumerate(lengths):
            path = np.zeros(length, dtype=np.int8)
            path[-1] = ends[k].argmax()
            for i in range(length - 1, 0, -1):
                path[i - 1] = back[k, i, path[i]]
            out.append(path)
        return out


def train(sequences: list[list[list[str]]], labels: list[np.ndarray], least: int = 4, epochs: int = 60, rate: float = 0.08, decay: float = 1e-4, seed: int = 5) -> Chain:
    """Maximum likelihood by Adam over batches of sequences; features seen fewer than ``least`` times are left out."""
    seen: dict[str, int] = {}
    for s in sequences:
        for row in s:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    names = {f: k for k, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    k, rng = len(LABELS), np.random.default_rng(seed)
    size = len(names) * k + k * k + 2 * k
    theta, m, v, step = np.zeros(size), np.zeros(size), np.zeros(size), 0
    rows = [[np.array([names[f] for f in row if f in names], dtype=np.int64) for row in s] for s in sequences]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 32):
            batch = [i for i in order[start : start + 32] if len(rows[i])]
            if not batch:
                continue
            grad, step = _gradient(theta, [rows[i] for i in batch], [labels[i] for i in batch], len(names)), step + 1
            grad += decay * theta * len(batch)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, steps, first, last = _unpack(theta, len(names))
    return Chain(names, w, steps, first, last)


def _unpack(theta: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    k = len(LABELS)
    return theta[: n * k].reshape(n, k), theta[n * k : n * k + k * k].reshape(k, k), theta[n * k + k * k : n * k + k * k + k], theta[n * k + k * k + k :]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _gradient(theta: np.ndarray, rows: list, labels: list, n: int) -> np.ndarray:
    """Of the negative log likelihood: expected less observed counts, by forward-backward over each sequence."""
    w, steps, first, last = _unpack(theta, n)
    grad = np.zeros_like(theta)
    gw, gs, gf, gl = _unpack(grad, n)
    for row, y in zip(rows, labels):
        flat, bounds = np.concatenate(row), np.cumsum([0, *map(len, row)])
        e = np.add.reduceat(w[flat], bounds[:-1], axis=0)
        t = len(row)
        alpha, beta = np.zeros((t, len(LABELS))), np.zeros((t, len(LABELS)))
        alpha[0] = first + e[0]
        for i in range(1, t):
            alpha[i] = _logsumexp(alpha[i - 1][:, None] + steps, 0) + e[i]
        beta[-1] = last
        for i in range(t - 2, -1, -1):
            beta[i] = _logsumexp(steps + e[i + 1] + beta[i + 1], 1)
        z = _logsumexp(alpha[-1] + last, 0)
        p = np.exp(alpha + beta - z)
        p[np.arange(t), y] -= 1
        np.add.at(gw, flat, np.repeat(p, np.diff(bounds), axis=0))
        gf += p[0]
        gl += p[-1]
        if t > 1:
            gs += np.exp(alpha[:-1, :, None] + steps + e[1:, None] + beta[1:, None] - z).sum(axis=0)
            np.add.at(gs, (y[:-1], y[1:]), -1)
    return grad


def save(models: dict[str, Chain], path: Path = MODEL) -> None:
    """Weights as JSON, rounded; features that hardly matter are left out."""
    out = {}
    for name, c in models.items():
        strong = [f for f, i in c.names.items() if np.abs(c.weights[i]).max() >= 0.1]
        out[name] = {"features": {f: [round(x, 2) for x in c.weights[c.names[f]].tolist()] for f in strong}}
        out[name] |= {k: np.round(getattr(c, k), 2).tolist() for k in ("steps", "first", "last")}
    path.write_text(json.dumps(out, ensure_ascii=False, separators=(",", ":")).replace("],", "],\n"))


@lru_cache(maxsize=2)
def load(path: Path = MODEL) -> dict[str, Chain]:
    models = {}
    for name, m in json.loads(path.read_text()).items():
        names = {f: k for k, f in enumerate(m["features"])}
        models[name] = Chain(names, np.array(list(m["features"].values())).reshape(-1, len(LABELS)), *(np.array(m[k]) for k in ("steps", "first", "last")))
    return models


def body_lines(rows: DataFrame, rec: str, content: str, domain: str, title: str | None, kind: str) -> DataFrame:
    """(rec, line_no) of every line of the body, lines split at newlines and numbered from 0. ``kind``: ``page`` for HTML, ``doc`` for plain text.

    Null and empty contents give no rows, nor do pages without a body; a null domain or title only leaves out its features. Repeated rows give the same
    lines again, removed here; markup need not be closed; further columns are ignored.
    """
    id_type = rows.schema[rec].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()[kind]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                scores, numbers = [], []
                for text, site, name in zip(*(part.column(c).to_pylist() for c in (1, 2, 3))):
                    head, units = page_units(text) if kind == "page" else (name or "", text_units(text))
                    scores.append(model.scores(features(units, head, site), len(units)))
                    numbers.append(np.array([u[0] for u in units], dtype=np.int32))
                lines = [no[path == BODY] for no, path in zip(numbers, model.decode(scores))]
                of = np.repeat(np.arange(part.num_rows), [len(x) for x in lines])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(np.concatenate(lines) if lines else np.zeros(0, np.int32))], ["r", "line_no"])

    chosen = rows.where(F.col(content).isNotNull() & F.col(rec).isNotNull()).select(
        F.col(rec).alias("r"), F.col(content).alias("c"), F.col(domain).alias("d"), (F.col(title) if title else F.lit(None).cast("string")).alias("t")
    )
    return chosen.mapInArrow(run, f"r {id_type}, line_no int").distinct().withColumnRenamed("r", rec)
