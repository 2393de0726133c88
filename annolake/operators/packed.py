"""Several values packed in one field (problem 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.text import strip

#: Marks within the work: between values, for a quote that belongs to a value, and before the letter that stands for a mark which the text itself holds.
CUT, INNER, ESCAPE = "\ue010", "\ue011", "\ue012"
#: What parts values wherever it stands outside quotes; a slash only between blanks.
ALWAYS = r"\|+|[;；、•\n\t]|(?<=\s)/(?=\s)"
NUMBER = r"\(?\d{1,2}[.)](?=\s)"
BULLET = rf"(?U)^(?:(?:[-*+•·–]|{NUMBER})\s+)+|^[-*+•·–]$"


def _escaped(c: Column) -> Column:
    """c without the marks, each as two characters."""
    own = F.replace(F.replace(F.replace(c, F.lit(ESCAPE), F.lit(f"{ESCAPE}c")), F.lit(CUT), F.lit(f"{ESCAPE}a")), F.lit(INNER), F.lit(f"{ESCAPE}b"))
    return F.when(c.rlike(f"[{CUT}-{ESCAPE}]"), own).otherwise(c)


def _restored(v: Column) -> Column:
    own = F.replace(F.replace(F.replace(v, F.lit(f"{ESCAPE}a"), F.lit(CUT)), F.lit(f"{ESCAPE}b"), F.lit(INNER)), F.lit(f"{ESCAPE}c"), F.lit(ESCAPE))
    return F.when(F.contains(v, F.lit(ESCAPE)), own).otherwise(v)


def _outside(piece: Column, comma: bool, numbered: Column) -> Column:
    """A piece between quotes, with CUT for each delimiter. A comma on its own between two quoted values always parts them."""
    cut = F.regexp_replace(piece, rf"(?U){ALWAYS}" + ("|," if comma else ""), CUT)
    cut = F.regexp_replace(cut, r"(?U)^\s*,\s*$|^\s+$", CUT)
    cut = F.regexp_replace(cut, rf"(?U)(?:,\s*)?({CUT})(?:\s*,)?", CUT)
    return F.when(numbered, F.regexp_replace(cut, rf"(?U)\s+(?={NUMBER})", CUT)).otherwise(cut)

def split_packed(c: Column, comma: bool) -> Column:
    r"""The values packed in c, in order, as an array of trimmed text without bullets, numbers or outer quotes.

    The text is split at its quote characters. Pieces at odd places stand inside quotes and are taken as they are; pieces
    at even places are split at delimiters, and a fold over the pieces puts the values together again. Two quotes in a row inside
    a quoted value, and \", are one quote of the value. comma: whether a bare comma parts values (short values), or only one
    between quoted values (whole sentences, which hold commas).
    A quote that is never closed stays in its value. Null and blank text give an empty array; blank pieces do not count, repeated values stay.
    """
    plain = _escaped(strip(F.regexp_replace(c, "\r\n?", "\n")))
    return F.coalesce(_let(plain, lambda text: _let(_unwrapped(text), lambda t: _values(t, comma))), F.array().cast("array<string>"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _unwrapped(text: Column) -> Column:
    """struct(text without list brackets, its quote, whether its values are numbered, its pieces)."""
    listed = text.rlike(r"(?sU)^\[\s*(?:[\"'“].*)?\]$|^\[[^\[\]]*\]$")
    single = listed & text.rlike(r"^\[\s*'")
    inside = F.when(listed, F.regexp_replace(F.regexp_replace(text, r"^\[\s*|\s*\]$", ""), r"\\([\"'])", INNER)).otherwise(text)
    # A JSON list with escapes is written anew with its characters; quotes within are doubled.
    spelled = F.when(text.rlike(r'(?s)^\[\s*".*\\'), F.array_join(F.transform(F.from_json(text, "array<string>"), lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ", "))
    inside = F.when(single, inside).otherwise(F.translate(F.regexp_replace(F.coalesce(spelled, inside), r"”\s*“", '", "'), "“”", '""'))
    quote = F.when(single, F.lit("'")).otherwise(F.lit('"'))
    return _let(inside, lambda t: F.struct(quote.alias("quote"), t.rlike(rf"(?U)^{NUMBER}").alias("numbered"), F.split(t, quote).alias("pieces")))


def _values(t: Column, comma: bool) -> Column:
    """The values of the pieces of t."""
    pieces, quote, numbered = t.pieces, t.quote, t.numbered
    last = F.size(pieces) - 1
    before = rf"(?U)(?:^|[|;；、•,\n\t\[]|\s/|^[-*+]|{NUMBER})\s*$"
    after = r"(?U)^\s*(?:$|[|;；、•,\n\t\]]|/\s)"

    def mapped(piece: Column, i: Column) -> Column:
        earlier, later = F.get(pieces, i - 1), F.get(pieces, i + 1)
        inner = ((i == 1) | (earlier != "")) & ~earlier.rlike(before) | ((i == last - 1) | (later != "")) & ~later.rlike(after)
        mark = F.when(inner, INNER).otherwise("")
        literal = F.when(i == last, F.concat(F.lit(INNER), piece)).otherwise(F.concat(mark, piece, mark))
        doubled = (piece == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, literal).when(doubled, F.lit(INNER)).otherwise(_outside(piece, comma, numbered))

    whole = F.aggregate(F.transform(pieces, mapped), F.lit(""), lambda done, piece: F.concat(done, piece))
    values = F.transform(F.split(whole, CUT), lambda v: strip(F.regexp_replace(strip(v), BULLET, "")))
    return F.filter(F.transform(values, lambda v: _restored(F.replace(v, F.lit(INNER), quote))), lambda v: v != "")


def explode_packed(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """One row (key, field_name, pos, val) per value of each field; pos is the value's place in its field, from 1.

    fields: field -> whether a bare comma parts its values. Rows with null or blank fields, and empty tables, give no rows for them;
    a null key is kept, repeated rows give repeated values, and other columns of df are ignored.
    One pass over df: no shuffle.
    """
    packed = F.array(*(F.struct(F.lit(f).alias("field_name"), split_packed(F.col(f), comma).alias("vals")) for f, comma in fields.items()))
    return (
        df.select(F.col(key), F.explode_outer(packed).alias("p"))  # explode() would have the array worked out once more, to see that it isn't empty
        .select(key, "p.field_name", F.posexplode("p.vals").alias("at", "val"))
        .select(key, "field_name", (F.col("at") + 1).cast("bigint").alias("pos"), "val")
    )
