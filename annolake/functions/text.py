"""Column builders for text. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for regular expressions of the JVM.
BLANK = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """c without white space of any kind at its ends (trim() removes ASCII spaces only)."""
    return F.regexp_replace(c, BLANK, "")


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


@cache
def accent_pairs() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, from the Unicode decompositions."""
    source, target = [], []
    for span in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for cp in span:
            letter = chr(cp)
            base = unicodedata.normalize("NFD", letter)[0]
            if letter == letter.lower() and base != letter and base.isascii():
                source.append(letter)
                target.append(base)
    return "".join(source) + "đ", "".join(target) + "d"


def fold(c: Column) -> Column:
    """c in lower case and without accents, composed or not."""
    source, target = accent_pairs()
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), source, target)


def spaced_words(c: Column) -> Column:
    """The words (runs of letters and digits) of the folded text, in order, with blanks between."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def words(c: Column) -> Column:
    """The words of the folded text, in order."""
    return F.filter(F.split(spaced_words(c), " "), lambda w: w != "")


def slug(c: Column) -> Column:
    """Lower case, spaces as underscores, and nothing but a-z, 0-9 and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), " ", "_"), "[^a-z0-9_]", "")


def level(row: str, k: int) -> Column:
    """Level k of the label struct `row`, null as empty text."""
    return F.coalesce(F.col(f"{row}.level_{k}"), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of white-space-separated words; null counts as none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
