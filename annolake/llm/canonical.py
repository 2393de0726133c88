"""Visually identical text with different characters (problem 4): one form for all text.

A transducer with one pass over the text. At each place it takes the longest match of a trie that is built once from Unicode's own data and lists of look-alikes. Its keys are
characters and grapheme clusters (a base, or what stands for it, with its marks); emoji with their joiners are taken whole. Which rules hold depends on the word: there is a trie for
each kind of word. All rules of a trie are checked: a key with two forms, or a form that is itself replaced, is an error.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like a Latin letter, and Latin ones that look like the Vietnamese D with stroke.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "ԍ": "g",
    "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ς": "s", "σ": "o", "ϲ": "c", "ϳ": "j", "ϱ": "p",
}
ARMENIAN = {"ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ա": "w", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B"}
LISU = {"ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U"}
LOOKS = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LISU
# Letters of phonetic script that look like plain ones; capitals like the D with stroke, which no other language has at the beginning of a word; and letters that are ordinary in Turkish, Icelandic or Ewe.
PHONETIC = {"ɑ": "a", "ɡ": "g", "ʋ": "v", "ȷ": "j"}
INITIAL = {"Ð": "Đ", "Ɖ": "Đ"}
FOREIGN = {"ð": "đ", "ɖ": "đ", "ı": "i", "ɩ": "i"}
# Marks that look like an ASCII one. Typographic quotes, dashes and dots are ordinary and not among them.
MARKS = {"ǃ": "!", "‐": "-", "‑": "-", "‒": "-", "−": "-", "⁄": "/", "∕": "/", "⧸": "/", "∶": ":", "ː": ":", "։": ":", "׃": ":", "‚": ",", "٫": ",", "․": ".", "‥": "..", "⁎": "*", "∗": "*", "∣": "|", "ǀ": "|", "⟨": "<", "⟩": ">", "‹": "<", "›": ">", "ʼ": "'", "ʹ": "'", "′": "'", "ˈ": "'", "`": "`", "﹘": "-", ";": ";", "·": "·"}
QUOTES = {"‹", "›", "‚", "·", "`", "‥", "′"}  # ordinary after all

#: Invisible characters: format characters and the like, and marks that show nothing. Tabs and line breaks are ordinary.
JOINERS = "‍︎️⃣"
EMOJI = "©®‼⁉™ℹ←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
#: The letters of U+2100 to U+214F that are styled forms of plain letters.
STYLED = [*range(0x2100, 0x2150), *range(0x1D400, 0x1D800), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180), *range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7)]


class Trie:
    """A transducer: of the keys that a text goes on with, the longest is replaced."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.root: dict = {}
        for key, form in rules.items():
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node[None] = form

    def run(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, at, form, end = self.root, i, text[i], i + 1
            while at < len(text) and (node := node.get(text[at])) is not None:
                at += 1
                if None in node:
                    form, end = node[None], at
            out.append(form)
            i = end
        return "".join(out)


class Rules(dict):
    """Key -> form. A key with two forms is an error."""

    def add(self, key: str, form: str) -> None:
        if self.setdefault(key, form) != form:
            raise ValueError(f"{key!r} stands for both {self[key]!r} and {form!r}")

    def checked(self) -> Rules:
        """These rules, if none gives out what another one replaces."""
        trie = Trie(self)
        if clash := {key for key, form in self.items() if trie.run(form) != form}:
            raise ValueError(f"forms that are themselves replaced: {clash}")
        return self


@cache
def table() -> Rules:
    """What one character stands for, of the rules that hold in any place."""
    made = Rules()
    for cp in STYLED:
        form = unicodedata.normalize("NFKC", chr(cp))
        if form != chr(cp) and all(c.isascii() or c in "₩¢£¬¦¥¯" for c in form) and unicodedata.decomposition(chr(cp)).split(" ")[0] in ("<font>", "<wide>", "<compat>", "<narrow>") and chr(cp) not in "№℀℁℅℆℡™℠℻":
            made.add(chr(cp), form)
    for cp in range(0x80, sys.maxunicode + 1):
        char = chr(cp)
        kind = unicodedata.category(char)
        own = unicodedata.decomposition(char)
        if kind == "Zs":
            made.add(char, " ")
        elif kind == "Cf" and not 0xE0000 <= cp <= 0xE0FFF and cp not in range(0x600, 0x606):
            made.add(char, "")
        elif own and " " not in own and kind != "Mn":  # another sign for one and the same character, as of Kelvin and Ohm
            form = unicodedata.normalize("NFC", char)
            made.add(char, form if form in QUOTES else MARKS.get(form, form))
    for char in "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10))) + "".join(map(chr, range(0xE0000, 0xE0080))):
        made.add(char, "")
    made.add("⠀", " ")
    for char in "\x7f" + "".join(map(chr, [*range(9), 0x0B, 0x0C, *range(14, 32), *range(0x80, 0x85), *range(0x86, 0xA0)])):
        made.add(char, "")
    for char, form in MARKS.items():
        if char not in QUOTES and char != form:
            made.add(char, made.get(form, form))
    return made.checked()


@cache
def compositions() -> Rules:
    """Letters of the Latin script written as a base, or a letter that has a mark already, with marks, in any order that means the same."""
    made = Rules()
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(cp)
        if unicodedata.normalize("NFC", letter) != letter:
            continue
        base, *marks = unicodedata.normalize("NFD", letter)
        for order in permutations(marks):
            for k in range(len(order) + 1):  # the first k marks are in the letter already
                start = unicodedata.normalize("NFC", base + "".join(order[:k]))
                key = start + "".join(order[k:])
                if len(start) == 1 and len(key) > 1 and unicodedata.normalize("NFC", key) == letter:
                    made.add(key, letter)
    return made.checked()


@cache
def _words() -> dict[str, Trie]:
    """Transducers for words: "any" for words wholly of one other script, "latin" where look-alikes are Latin too, and further ones with what only some words allow."""
    tries = {}
    for name, more in (("any", {}), ("latin", LOOKS), ("plain", LOOKS | PHONETIC), ("syllable", LOOKS | PHONETIC | FOREIGN)):
        rules, more_ = Rules(), more | (INITIAL if name in ("plain", "syllable") else {})
        for key, form in table().items():
            rules.add(key, more_.get(form, form))
        for key, form in more_.items():
            rules.add(key, form)
        for key, form in compositions().items():
            rules.add(key, form)
            for base, plain in [*more.items(), *((c, f) for c, f in table().items() if len(f) == 1 and f.isalpha())]:  # the same letter with a base that stands for its own
                if plain == key[0]:
                    rules.add(base + key[1:], form)
        tries[name] = Trie(rules.checked())
    return tries


@cache
def _runs(chars) -> list[list[int]]:
    """The code points of chars as runs from first to last."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return runs


def _class(chars) -> str:
    """The characters as a class for a regular expression."""
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if b > a else re.escape(chr(a)) for a, b in _runs(frozenset(chars)))


MARK = "̀-͎͐-ͯ"


WORDLY = LOOKS | PHONETIC | INITIAL | FOREIGN


@cache
def _machine():
    """What the transducer looks for at each place: sequences of emoji, words that hold something to look at, syllables of Hangul letters, and characters that any place may hold."""
    plain = table()
    hidden = _class(c for c in plain if unicodedata.category(c) == "Cf" or c == chr(0x34F))
    seen = _class(WORDLY)
    # A word is looked at from its beginning only, and never given back, so that a run of letters of any length is read once.
    begin = rf"(?<![^\W\d_])(?<![{MARK}{_class(c for c in plain if unicodedata.category(c) == 'Cf' and c < chr(0xE0000))}])"
    ordinary, any_ = rf"(?:[^\W\d_{seen}]|[{hidden}])*+", rf"(?:[^\W\d_]|[{MARK}{hidden}])*+"
    alternatives = {
        "emoji": rf"[{EMOJI}#*0-9](?:[︎️⃣\U0001f3fb-\U0001f3ff]|‍(?=[{EMOJI}]))+(?:[{EMOJI}](?:[︎️\U0001f3fb-\U0001f3ff]|‍(?=[{EMOJI}]))*)*(?:[\U000e0020-\U000e007f]+)?",
        "word": rf"{begin}{ordinary}[{seen}{MARK}]{any_}",
        "jamo": "[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?",
        "plain": f"[{_class(plain)}]",
    }
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in alternatives.items())), plain


@cache
def _script(char: str) -> str:
    if "Ѐ" <= char <= "ԯ":
        return "cyrillic"
    return "latin" if unicodedata.name(char, "").startswith(("LATIN", "FULLWIDTH LATIN", "MATHEMATICAL")) else "other"


#: A syllable of Vietnamese, without accents: a beginning, vowels, an end.
SYLLABLE = re.compile(r"(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdđghklmnprstvx])?[aeiouy]{1,3}(?:ch|ng|nh|[cmnpt])?")


def _bare(text: str) -> str:
    """Letters in lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@lru_cache(1 << 16)
def _word(word: str) -> str:
    """A word that holds a look-alike or a mark, in its one form: the longest-match transducer of the kind of word that it is.

    A look-alike turns into the Latin letter where it stands in a word with Latin letters; words wholly in another script, and a letter of
    Greek on its own, stay. A word of Cyrillic look-alikes only, with a Latin mark on it, is Latin too. Letters of phonetic script count among plain and Vietnamese letters
    only, capitals like the D with stroke at the beginning of such a word or after a small letter, and letters of Turkish, Icelandic and Ewe where the word is a Vietnamese syllable with them.
    Marks that are in no letter are put in Unicode's order.
    """
    tries = _words()
    bare = tries["any"].run(word)
    letters = [c for c in bare if c.isalpha()]
    scripts = {_script(c) for c in letters if c not in PHONETIC and c not in FOREIGN and c not in INITIAL}
    marked = any(unicodedata.combining(c) for c in unicodedata.normalize("NFD", bare) if c not in "̆̈́")
    rest = _bare("".join(LOOKS.get(c, c) for c in letters if c not in WORDLY or c in LOOKS))
    viet = rest.replace("đ", "d").isascii()
    kind = "any"
    if "latin" in scripts or (scripts == {"cyrillic"} and marked and all(c in LOOKS for c in letters)):
        kind = "latin"
    if (kind == "latin" or not scripts) and viet and not any(b in INITIAL and not a.islower() for a, b in zip(letters, letters[1:])):
        shape = _bare("".join(WORDLY.get(c, c) for c in letters))
        kind = "syllable" if SYLLABLE.fullmatch(shape) else "plain" if kind == "latin" and not any(c in FOREIGN for c in letters) else kind
    return unicodedata.normalize("NFC", tries[kind].run(word))


def canonical(text: str) -> str:
    """text in its one form. A form of text that is in its one form is that text."""
    machine, plain = _machine()

    def out(m: re.Match) -> str:
        kind, found = m.lastgroup, m.group()
        if kind == "emoji":
            return found
        if kind == "word":
            return _word(found)
        return unicodedata.normalize("NFC", found) if kind == "jamo" else plain[found]

    return machine.sub(out, text)


@cache
def suspects() -> str:
    """A class of the JVM's regular expressions for all characters that any rule may touch."""
    touched = {*table(), *WORDLY, *map(chr, range(0x300, 0x370)), *map(chr, range(0x1100, 0x1200))}
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _runs(frozenset(touched))) + "]"


@cache
def strangers() -> str:
    """A short class for all but the most ordinary characters, which tells most texts apart at once."""
    ordinary = [chr(cp) for span in (range(0x20, 0x7F), range(0xC0, 0x180), range(0x1A0, 0x1B1), range(0x1E00, 0x1F00)) for cp in span]
    return "[^\\t\\n\\r" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _runs(frozenset({*ordinary, *"₫“”‘’–—…«»•"} - {*table(), *WORDLY}))) + "]"


def suspect(c: Column) -> Column:
    """Whether c holds a character that any rule may touch; null does not."""
    return F.coalesce(c.rlike(strangers()) & c.rlike(suspects()), F.lit(False))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("val").to_pylist()
        forms = pa.array([t if t is None else canonical(t) for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names), forms], [*b.schema.names, "form"])


def canonical_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, field_name, val, form) for the fields whose text is not in its one form; form is the text in that form.

    Null and empty fields, and empty tables, give no rows; repeated keys are kept; texts are read whole. Only texts that hold a
    suspect character leave the JVM. No shuffle.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.when(suspect(F.col(f)), F.col(f)).alias("val")) for f in fields))
    # explode() would have the cells worked out once more, to see that there are any.
    rows = df.select(F.col(key).alias("key"), F.explode_outer(cells).alias("x")).select("key", "x.*").filter(F.col("val").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    formed = rows.mapInArrow(_forms, f"key {kind}, field_name string, val string, form string")
    return formed.filter(F.col("form") != F.col("val")).withColumnRenamed("key", key)
