"""Column builders for label triples."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.text import strip

PATH = "::"


def path(*levels: Column) -> Column:
    """The levels as one label, null as empty."""
    return F.concat_ws(PATH, *(F.coalesce(c, F.lit("")) for c in levels))


def levels_of(label: Column) -> list[Column]:
    """The three levels of a label; missing ones are empty."""
    parts = F.split(label, PATH, 3)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(3)]


def first_of(c: Column) -> Column:
    """A level that may be written as a JSON list: its first entry, or ''."""
    listed = F.coalesce(F.get(F.from_json(c, "array<string>"), F.lit(0)), F.lit(""))
    return F.when(c.startswith("["), listed).otherwise(F.coalesce(c, F.lit("")))


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Text with letters and accents composed; the JVM has no function for it."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def normal_label(c: Column) -> Column:
    """A label's form for comparisons: composed, trimmed, single blanks, lower case."""
    return F.lower(F.regexp_replace(strip(composed(c)), r"(?U)\s+", " "))


def gold_or_machine(gold: list[Column], machine: list[Column]) -> list[Column]:
    """The gold levels where the first of them is given, else the machine's."""
    given = F.coalesce(gold[0], F.lit("")) != ""
    return [F.coalesce(F.when(given, g).otherwise(m), F.lit("")) for g, m in zip(gold, machine)]


def prefer(first: list[Column], second: list[Column]) -> list[Column]:
    """Per level the first label, or the second where that is blank."""
    return [F.coalesce(F.nullif(a, F.lit("")), b, F.lit("")) for a, b in zip(first, second)]


def annotated(now: Column, before: Column) -> list[Column]:
    """The levels of an annotation: levels 1 and 2 from before where they are blank, level 3 only where the annotation has none at all; null is empty."""
    pick = lambda k: F.coalesce(F.nullif(now.getField(k), F.lit("")), before.getField(k), F.lit(""))
    return [pick("level_1"), pick("level_2"), F.coalesce(now.getField("level_3"), before.getField("level_3"), F.lit(""))]


def prediction(intent: Column, confidence: Column, reasoning: Column) -> Column:
    """A labelled row as a prediction: struct(L1, L2, L3, confidence, reasoning, is_new_label)."""
    levels = [F.coalesce(intent.getField(f"level_{k}"), F.lit("")).alias(f"L{k}") for k in (1, 2, 3)]
    return F.struct(*levels, F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(reasoning, F.lit("")).alias("reasoning"), F.lit(False).alias("is_new_label"))
