"""Mapping freely typed values to a reference list.

The entries, other names included, form one trie; a typed value is looked up by running its Levenshtein automaton down the trie, so that all entries within the
distance come out without comparing the value to each. The automaton is compiled to one bit mask a letter; its state is one set of positions, as bits of a
number, for each count of edits, so a step is a few operations on numbers, whatever the length. Values are searched once per distinct spelling, however many rows carry it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelindan.session import keep

# Type words with their short forms, and short forms of compass and similar words.
TYPE_WORDS = {
    "kabupaten": "kabupaten", "kab": "kabupaten", "kabup": "kabupaten", "kbp": "kabupaten", "kabu": "kabupaten", "regency": "kabupaten",
    "kota": "kota", "kt": "kota", "kotamadya": "kota", "kodya": "kota", "kotip": "kota", "city": "kota",
}
SHORT_FORMS = {
    "ut": "utara", "utr": "utara", "u": "utara", "sel": "selatan", "slt": "selatan", "s": "selatan", "tim": "timur", "tmr": "timur", "t": "timur",
    "bar": "barat", "brt": "barat", "b": "barat", "teng": "tengah", "tgh": "tengah", "tng": "tengah", "kep": "kepulauan", "kepul": "kepulauan",
    "adm": "", "administrasi": "",
}
PROVINCE_WORDS = ("provinsi", "propinsi", "prov", "prop", "province")


def plain(text: str) -> str:
    """Lower case without accents; every other character than a letter or digit stays to mark where words end."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain(text))


@dataclass(frozen=True)
class Typed:
    kind: str
    name: str


def _type_apart(token: list[str]) -> tuple[str, list[str]]:
    kind, rest = "", []
    for w in token:
        if w in TYPE_WORDS and (not kind or TYPE_WORDS[w] == kind):
            kind = kind or TYPE_WORDS[w]
        else:
            rest.append(w)
    return kind, rest


def read_typed(text: str, provinces: set[str]) -> Typed:
    """The type word (or '') and the bare name of a typed value: provinces at the end, type words and short forms set aside. A part after
    a separator is a province if it starts with a word for one or is the name of one."""
    parts = [w for w in (words(p) for p in re.split(r"[,;()\[\]/|]|\s[-–—]\s", text)) if w]
    kept = []
    for k, part in enumerate(parts):
        if k and (part[0] in PROVINCE_WORDS or " ".join(part) in provinces):
            continue
        for i, w in enumerate(part):
            if i and w in PROVINCE_WORDS:
                part = part[:i]
                break
        kept += part
    kind, rest = _type_apart(kept)
    return Typed(kind, "".join(SHORT_FORMS.get(w, w) if len(rest) > 1 else w for w in rest))


class Trie:
    """A trie of names; ``search`` returns (distance, entry) of every name within ``most`` edits, the least distance of each entry."""

    def __init__(self, names: list[tuple[str, int]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.entries: list[list[int]] = [[]]
        for name, entry in names:
            node = 0
            for c in name:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.entries.append([])
                node = self.next[node][c]
            self.entries[node].append(entry)
        self.steps = [list(n.items()) for n in self.next]

    def search(self, word: str, most: int) -> list[tuple[int, int]]:
        accept = 1 << len(word)
        inside = 2 * accept - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        letter, steps, entries = masks.get, self.steps, self.entries
        found: dict[int, int] = {}
        # Bit i of the e-th set: the first i letters of the word are read with e edits at most.
        stack = [(0, [(2 << e) - 1 & inside for e in range(most + 1)])]
        while stack:
            node, state = stack.pop()
            if entries[node] and state[most] & accept:
                d = next(e for e in range(most + 1) if state[e] & accept)
                for e in entries[node]:
                    found[e] = min(found.get(e, d), d)
            for c, child in steps[node]:
                m = letter(c, 0)
                now = (state[0] & m) << 1
                new = [now]
                for e in range(1, most + 1):
                    fewer = state[e - 1]
                    now = ((state[e] & m) << 1 | fewer | (fewer | now) << 1) & inside
                    new.append(now)
                if now:
                    stack.append((child, new))
        return sorted((d, e) for e, d in found.items())


def nearest(trie: Trie, word: str, most: int) -> list[tuple[int, int]]:
    """What ``search`` finds at the least distance that finds anything: the automaton runs with a growing bound, as a small one cuts off early."""
    for bound in range(most + 1):
        if hits := trie.search(word, bound):
            return hits
    return []


def two_edits(name: str) -> int:
    """The distance allowed for a name of any length, as TESTDATA.md has it."""
    return 2


@dataclass
class Lookup:
    """A reference list ready to be searched: what each entry is, and a trie of names for each type word and for none."""

    entries: list[tuple[str, str, str, str]]
    provinces: set[str]
    places: list[str]
    tries: dict[str, Trie]

    @classmethod
    def of(cls, entries: list[tuple[str, str, str, str]]) -> "Lookup":
        places = [" ".join(words(p)) for *_, p in entries]
        kinds, names = [], []
        for k, (_, name, others, _) in enumerate(entries):
            own = read_typed(name, set())
            kinds.append(own.kind)
            names += [(n, k) for n in {own.name, *(read_typed(o, set()).name for o in others.split(";"))} if n]
        return cls(entries, set(places) - {""}, places, {kind: Trie([(n, k) for n, k in names if not kind or kinds[k] == kind]) for kind in {"", *kinds}})

    def within(self, typed: str, allowed: Callable[[str], int], every: bool) -> list[tuple[int, int]]:
        """(distance, entry) of the entries meant: ``every`` one within the distance allowed, or the nearest."""
        t = read_typed(typed, self.provinces)
        if not t.name or t.kind not in self.tries:
            return []
        return self.tries[t.kind].search(t.name, allowed(t.name)) if every else nearest(self.tries[t.kind], t.name, allowed(t.name))


def _listed(reference: DataFrame, most_entries: int) -> list[tuple[str, str, str, str]]:
    listed = reference.select("code", "name", "other_names", "province").limit(most_entries + 1).collect()
    if len(listed) > most_entries:
        raise ValueError(f"the reference list has more than {most_entries} entries")
    return sorted({(r.code, r.name, r.other_names or "", r.province or "") for r in listed if r.code and r.name})


def _typed(rows: DataFrame, value: str, region: Column, values_per_task: int) -> DataFrame:
    """Distinct non-blank values and regions, the regions of a value side by side in one task. A spelling is few bytes but much work: tasks are cut by number of spellings."""
    typed = rows.where(F.col(value).rlike(r"[^\s\x85   -     　﻿]")).select(F.col(value).alias("value"), region.alias("region")).distinct()
    typed = keep(typed, "typed")
    return typed.repartition(max(1, -(-typed.count() // values_per_task)), "value").sortWithinPartitions("value")


def entries_within(rows: DataFrame, value: str, reference: DataFrame, allowed: Callable[[str], int] = two_edits, most_entries: int = 200_000, values_per_task: int = 2_000) -> DataFrame:
    """(value, code, distance): every entry within the distance allowed of every distinct non-blank value, the type words agreeing; as ``match_reference`` otherwise."""
    shared = rows.sparkSession.sparkContext.broadcast(_listed(reference, most_entries))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = Lookup.of(shared.value)
        for pdf in batches:
            out = [(v, lookup.entries[e][0], d) for v in pdf["value"] for d, e in lookup.within(v, allowed, True)]
            yield pd.DataFrame(out, columns=["value", "code", "distance"])

    return _typed(rows, value, F.lit(None).cast("string"), values_per_task).mapInPandas(search, "value string, code string, distance int")


def match_reference(
    rows: DataFrame,
    value: str,
    reference: DataFrame,
    region: str | None = None,
    allowed: Callable[[str], int] = two_edits,
    most_entries: int = 200_000,
    values_per_task: int = 2_000,
) -> DataFrame:
    """(value, region, code): every distinct non-blank ``value`` (and ``region``, a column that names a province) with the code meant, or ``none``.

    ``reference`` has code, name (type word first), other_names (split at ``;``) and province. The type of an entry must agree with the typed one,
    if any. The nearest entry wins; of equally near ones, that of the row's province, then the smallest code. ``allowed`` gives the distance
    for the length of a bare name. The list goes to every task, so it must have at most ``most_entries`` rows, else a ``ValueError`` says so:
    a longer one is no list of places or brands. Null entries are skipped; an empty list maps everything to ``none``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_listed(reference, most_entries))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, last, hits = Lookup.of(shared.value), None, []
        for pdf in batches:
            out = []
            for typed, where in zip(pdf["value"], pdf["region"]):
                if typed != last:
                    last, hits = typed, lookup.within(typed, allowed, False)
                here = " ".join(words(where or "")) if len(hits) > 1 else ""
                best = min(((d, lookup.places[e] != here, lookup.entries[e][0]) for d, e in hits), default=None)
                out.append(best[2] if best else "none")
            yield pdf.assign(code=out)

    place = F.col(region).cast("string") if region else F.lit(None).cast("string")
    return _typed(rows, value, place, values_per_task).mapInPandas(match, "value string, region string, code string")
