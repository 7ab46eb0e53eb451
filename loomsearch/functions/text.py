"""Tokens: runs of ASCII letters and digits and of any non-ASCII characters; only ASCII letters are lower-cased."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null for a null text."""
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda x: x != "")


def tokenize(text: str) -> list[str]:
    """The same for a Python string, as for a query."""
    out, word = [], []
    for c in text:
        if ord(c) >= 0x80 or c in string.ascii_letters or c in string.digits:
            word.append(c.lower() if ord(c) < 0x80 else c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out
