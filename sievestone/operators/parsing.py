"""The search mini-language: words, "phrases" and prefixes*, compiled to phrases of terms."""

from __future__ import annotations

from dataclasses import dataclass

import regex

from ..functions.stemming import stem
from ..functions.text import py_fold, strip_latin

_PLAIN = regex.compile(r"[\p{L}\p{Nd}]+\*?|\*")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


@dataclass(frozen=True)
class Phrase:
    """Terms that must stand side by side in one column; a prefix has one term, which stands for its beginnings."""

    terms: tuple[str, ...]
    prefix: bool = False


def _analysed(word: str, stemmed: bool) -> str:
    return strip_latin(stem(word)) if stemmed else word


def parse_query(text: str, stemmed: bool = True) -> list[Phrase]:
    """All phrases of a query; each must match. Quotes that aren't closed are spaces; punctuation alone gives nothing."""
    parts, out = py_fold(text).split('"'), []
    for i, part in enumerate(parts):
        if i % 2 and i < len(parts) - 1:  # within a closed pair
            terms = tuple(_analysed(w, stemmed) for w in _WORD.findall(part))
            out += [Phrase(terms)] if terms else []
            continue
        for w in _PLAIN.findall(part):
            if w.endswith("*"):
                out += [Phrase((w[:-1],), True)] if w != "*" else []
            else:
                out.append(Phrase((_analysed(w, stemmed),)))
    return out


def to_match(phrases: list[Phrase]) -> str:
    """The phrases as a full-text expression: "a" "b c" "d"*."""
    return " ".join('"' + " ".join(p.terms) + '"' + "*" * p.prefix for p in phrases)
