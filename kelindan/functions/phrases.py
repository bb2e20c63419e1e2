"""A small language of phrases, and its translation to patterns that Java and RE2 share.

A phrase is words between blanks; any white space may stand where a blank does. ``a/b`` is either word, ``(a)`` a word that may be missing, ``a*`` a word that may go
on, ``<a`` and ``a>`` a word that must begin or end there, ``~40`` up to 40 characters within a sentence, ``..3`` up to three words, ``_`` white space only, and ``{name}`` any
phrase of the list ``name``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

Lists = Mapping[str, Iterable[str]]


def _word(token: str, lists: Lists) -> str:
    left, right, bare = token.startswith("<"), token.endswith(">"), token.strip("<>")
    each = []
    for w in bare.split("/"):
        if m := re.fullmatch(r"\{(\w+)\}", w):
            each.append(either(lists[m[1]], lists))
        else:
            each.append(re.sub(r"([.+?])", r"\\\1", w.rstrip("*")) + (r"\w*" if w.endswith("*") else ""))
    group = each[0] if len(each) == 1 and not (left or right) else f"(?:{'|'.join(each)})"
    return (r"\b" if left else "") + group + (r"\b" if right else "")


def pattern(phrase: str, lists: Lists | None = None) -> str:
    """The pattern of one phrase."""
    lists = lists or {}
    out, glued = "", True
    for token in phrase.split():
        if m := re.fullmatch(r"~(\d+)", token):
            out, glued = out + rf"[^.\n]{{0,{m[1]}}}?", True
        elif m := re.fullmatch(r"\.\.(\d+)", token):
            out, glued = out + ("" if glued else r"\s+") + rf"(?:\w+\s+){{0,{m[1]}}}?", True
        elif token == "_":
            out, glued = out + r"\s+", True
        elif token.startswith("(") and token.endswith(")"):
            # What may be missing brings the white space after it, so the next word needs none of its own.
            out, glued = out + ("" if glued else r"\s+") + rf"(?:{_word(token[1:-1], lists)}\s+)?", True
        else:
            out, glued = out + ("" if glued else r"\s+") + _word(token, lists), False
    return out


def either(phrases: Iterable[str], lists: Lists | None = None) -> str:
    """The pattern of any of the phrases, earlier ones first."""
    return f"(?:{'|'.join(pattern(p, lists) for p in phrases)})"


def whole(phrases: Iterable[str], lists: Lists | None = None) -> str:
    """As ``either``, as whole words."""
    return rf"\b{either(phrases, lists)}\b"


def listed(text: str) -> list[str]:
    """Phrases written one after another with commas or line ends between them."""
    return [p for p in (" ".join(part.split()) for part in re.split(r"[,\n]", text)) if p]
