"""Scalar text functions as native columns: sizes, bounds, token estimates, trigrams, terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8_bytes(text: Column) -> Column:
    """Length of the UTF-8 encoding."""
    return F.octet_length(text).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and one for each other character."""
    others = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.ceil((F.length(text) - others) / F.lit(4.0)) + others).cast("long")


def bounded_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most `most` bytes.

    A prefix of bytes is cut at its last character start: the trailing bytes of an unfinished character are found by their
    high bits in hexadecimal, so the text is encoded once and no character is decoded twice.
    """
    head = F.substring(F.encode(text, "UTF-8"), 1, most)
    tail = F.hex(F.substring(F.encode(text, "UTF-8"), most + 1, 1))
    unfinished = F.regexp_extract(F.hex(head), r"((?:C|D|E|F)[0-9A-F](?:[89AB][0-9A-F]){0,3})$", 1)
    cut = F.when(tail.rlike("^[89AB]"), F.length(unfinished) / 2).otherwise(F.lit(0))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(head, F.lit(1), (F.lit(most) - cut).cast("int")), "UTF-8"))


def is_complete(text: Column, most: int) -> Column:
    return F.octet_length(text) <= most


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    gram = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    # an array of one element binds the characters, so that the text is split once
    grams = F.get(F.transform(F.array(F.split(F.lower(text), "")), lambda chars: F.array_distinct(gram(chars))), F.lit(0))
    return F.when(F.length(text) >= 3, grams).otherwise(F.array().cast("array<string>"))


def contains_all(text: Column, literals: list[str]) -> Column:
    """True if the lower-cased text holds every trigram."""
    found = F.lit(True)
    for x in literals:
        found &= F.contains(F.lower(text), F.lit(x))
    return found


def trigram_query(literal: str) -> list[str]:
    """The case-folded trigrams of a literal, in order; ValueError below three characters."""
    if len(literal) < 3:
        raise ValueError("a trigram query needs three characters at least; search for terms instead")
    folded = literal.lower()
    return [folded[i : i + 3] for i in range(len(folded) - 2)]


def words(text: Column) -> Column:
    """Lower-cased ASCII words of two characters at least, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))


def tagged_value(text: Column, tag: str) -> Column:
    """The text between the first <tag> and the next </tag>, trimmed; null without one."""
    value = F.regexp_extract(text, f"(?s)<{re.escape(tag)}>(.*?)</{re.escape(tag)}>", 1)
    return F.when(text.rlike(f"(?s)<{re.escape(tag)}>.*?</{re.escape(tag)}>"), F.trim(value))


def path_of_uri(uri: Column) -> Column:
    """The path of a local `file:` URI with its percent codes decoded; null for anything else."""
    path = F.regexp_extract(uri, r"^file:(?://(?:localhost)?)?(/.*)$", 1)
    return F.when(path != "", F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def complete_or_null(text: Column, most: int) -> Column:
    """Arguments are kept whole as a VARIANT, or left out: too long or invalid JSON gives null."""
    return F.when(F.octet_length(text) <= most, F.try_parse_json(text))
