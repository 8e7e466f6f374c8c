"""Search terms of mixed text: ideograph pairs, code identifiers with their parts, and words."""

from __future__ import annotations

import re
import unicodedata

#: Fixed ranges of characters that are indexed as overlapping pairs.
PAIRED = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
_RUN = re.compile(rf"(?P<pairs>[{PAIRED}]+)|(?P<name>[A-Za-z0-9_]+)|(?P<word>(?:(?![{PAIRED}_])[^\W\d])+)")
#: Parts of a name: a number, an acronym that isn't the start of a capitalised word, or a word.
_PART = re.compile(r"[0-9]+|[A-Z]{2,}(?![a-z])|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]")


def _runs(text: str):
    for m in _RUN.finditer(text):
        yield m.lastgroup, m.group()


def pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)]


def terms(text: str | None) -> list[str]:
    """The terms of a text in order: pairs of ideographs, whole names and their parts, other words; two characters at least."""
    out = []
    for kind, run in _runs(text or ""):
        if kind == "pairs":
            out += pairs(run)
        elif kind == "name":
            whole = run.lower()
            out += [t for t in (whole, *(p for p in map(str.lower, _PART.findall(run)) if p != whole)) if len(t) >= 2]
        elif len(run.lower()) >= 2:
            out.append(run.lower())
    return out


def folded(term: str) -> str:
    """A term as the index compares it: without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c))


def search_query(query: str) -> list[list[str]]:
    """The phrases that an item must all hold; ValueError if there is none.

    A run of ideographs is one phrase of its pairs; names and words are phrases of one term and aren't split into parts.
    """
    out: list[list[str]] = []
    for kind, run in _runs(query):
        phrase = pairs(run) if kind == "pairs" else [run.lower()] if len(run.lower()) >= 2 else []
        if phrase and phrase not in out:
            out.append(phrase)
    if not out:
        raise ValueError("a search needs a word, name or pair of ideographs of two characters at least; use trigrams for other literals")
    return out
