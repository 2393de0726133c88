"""Rules over one text: too vague a sentence, questions, product names, ids in links, JSON in prose. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolake.functions.text import strip

# Words that say nothing, and question words that a whole sentence may consist of.
EMPTY_WORDS = ("có", "thế", "này", "kia", "được", "như")
BARE = r"^(?:(?:có ?)?(?:không ?)?gì|sao|nào|đâu)[ ?]*$"
# Vietnamese question phrases. The two with a blank need a word after them.
QUESTIONS = ("bao giờ", "bao lâu", "bao nhiêu", "khi nào", "ở đâu", "tại sao", "vì sao", "như thế nào", "thế nào", "làm sao", "sao lại", "gì ", "cái gì", "là gì", "loại nào", "màu nào", "size nào", "cỡ nào", "mấy giờ", "mấy ngày", "ai ", "của ai", "cho ai", "từ đâu", "ntn")


def vague(c: Column, letters: int = 6, words: int = 1) -> Column:
    """Why a sentence is too vague, or '': empty, fewer than `letters` characters, fewer than `words` words that say something, or question words only."""
    text = strip(F.coalesce(c, F.lit("")))
    n = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    low = F.lower(text)
    meant = F.size(F.filter(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: (F.length(w) >= 2) & ~w.isin(*EMPTY_WORDS)))
    return (
        F.when(text == "", "empty_sentence")
        .when(n < letters, F.concat(F.lit("too_short_chars_"), n.cast("string")))
        .when(meant < words, F.concat(F.lit("too_few_meaningful_words_"), meant.cast("string")))
        .when(F.regexp_replace(low, r"(?U)\s+", " ").rlike(BARE), "question_word_only")
        .otherwise("")
    )


def asks(c: Column) -> Column:
    """Whether a text holds a question phrase; null does not."""
    return F.coalesce(strip(c).rlike(r"(?iU)\b(?:" + "|".join(QUESTIONS) + r")\b"), F.lit(False))


# What stands before and behind a raw product name, in the order it is taken off; what follows a size; where a link holds a product's id.
AROUND_NAME = (r"^-?\d+\s*%", r"^\d[\d.,]*\s*₫", r"^\d[\d.,]*\s*₫", r"^Tặng:.*?₫", r"\d+\.\d+\(\d+\)\d*$", r"\d+$")
BEHIND_SIZE = r"(\d+(?:ml|g|L))[A-Z][a-z].*$"
LINK_ID = r"/san-pham/([^/?#]+?)(?:\.html)?(?:[?#]|$)"


def bare_name(c: Column) -> Column:
    """The first line of a raw name, without discount, prices, gift, rating, and counts behind it."""
    name = strip(F.substring_index(c, "\n", 1))
    for pattern in AROUND_NAME:
        name = strip(F.regexp_replace(name, pattern, ""))
    return name


def product_name(c: Column) -> Column:
    """A raw name without what stands around it, and what follows its size."""
    return F.regexp_replace(bare_name(c), BEHIND_SIZE, "$1")


def joined_capitals(name: Column) -> Column:
    """A name's beginning of two or more capitalised parts written together, or ''; it is taken for a brand where none is known."""
    return F.regexp_extract(name, r"^((?:[A-Z][a-z]+){2,})", 1)


def link_id(c: Column) -> Column:
    """The product id in a link: what follows /san-pham/, else its last part, without .html."""
    named = F.regexp_extract(c, LINK_ID, 1)
    last = F.regexp_replace(F.regexp_extract(c, r"([^/]*)/?$", 1), r"\.html", "")
    return F.when(named != "", named).otherwise(last)


def links(html: Column) -> Column:
    """The targets of a page's links, each once, in their order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), 1))


def json_in(c: Column, schema: str) -> Column:
    """The JSON object in a text with code fences or words around it; null where there is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def confidence(c: Column) -> Column:
    """Notes of confidence in one form: blank is Cao; a number is Cao from 0.7 on, else Trung binh; others stay."""
    text = strip(F.coalesce(c, F.lit("")))
    number = F.when(text.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    return F.when(text == "", "Cao").when(number >= 0.7, "Cao").when(number < 0.7, "Trung binh").otherwise(text)


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z][a-z0-9_]+\z"), F.lit(False))


def titled(slug: Column) -> Column:
    """A slug as a title: each letter that no letter stands before is a capital."""
    words = F.split(F.lower(F.replace(slug, F.lit("_"), F.lit(" "))), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def picked_name(name: Column, l2: Column, l3: Column) -> Column:
    """The name, unless it is blank or one of the labels; else the title of l3; else the name as it is, or Intent."""
    own, label = strip(F.coalesce(name, F.lit(""))), strip(F.coalesce(l3, F.lit("")))
    free = (own != "") & (own != F.coalesce(l3, F.lit(""))) & (own != F.coalesce(l2, F.lit("")))
    return F.when(free, own).when(label != "", titled(label)).when(own != "", own).otherwise("Intent")


# Spellings of level 1.
LEVEL_1 = {"truoc_ban": "truoc_mua_hang", "truoc_mua_hang": "truoc_mua_hang", "trước_bán": "truoc_mua_hang", "sau_ban": "sau_mua_hang", "sau_mua_hang": "sau_mua_hang"}


def level_one(c: Column) -> Column:
    """A label of level 1 in its known spelling; others trimmed."""
    own = strip(F.coalesce(c, F.lit("")))
    low = F.replace(F.lower(own), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LEVEL_1.items() for x in kv)), low), own)


def page_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags, with single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def blocks(html: Column, tag: str, kind: str) -> Column:
    """The texts of a page's elements of a tag whose class has the word `kind`, without those that hold the same tag again."""
    whole = F.regexp_extract_all(html, F.lit(rf"""(?is)<{tag}\b[^>]*?\bclass\s*=\s*["'][^"']*\b{kind}\b[^"']*["'][^>]*>((?:(?!<{tag}\b).)*?)</{tag}\s*>"""), 1)
    return F.filter(F.transform(whole, page_text), lambda t: t != "")


def asked_questions(html: Column, tag: str, kind: str, least: int = 3) -> Column:
    """Questions that a page's blocks hold: texts of `least` letters or more, each once."""
    return F.array_distinct(F.filter(blocks(html, tag, kind), lambda t: F.length(t) >= least))


#: Texts of a page's product that count: a description of more than 20 characters, cut at 1000; ten images; 20 questions of 11 to 999 characters.
DESCRIPTION, IMAGES, ASKED = (20, 1000), 10, (11, 999, 20)


def first_block(html: Column, kind: str, digits: bool = False) -> Column:
    """The text of a page's first element whose class has `kind` in it, and which holds a digit if that is asked for; '' where there is none."""
    whole = F.regexp_extract_all(html, F.lit(rf"""(?is)<(\w+)\b[^>]*?\bclass\s*=\s*["'][^"']*{kind}[^"']*["'][^>]*>(.*?)</\1\s*>"""), 2)
    texts = F.filter(F.transform(whole, page_text), lambda t: t.rlike(r"\d") if digits else t != "")
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def product_page(html: Column) -> Column:
    """struct(price, brand, description, images, questions) of a product's page."""
    least, most = DESCRIPTION
    told = first_block(html, "description")
    images = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)"""), 1))
    short, long, many = ASKED
    questions = F.filter(blocks(html, "div", "question"), lambda t: F.length(t).between(short, long))
    return F.struct(
        first_block(html, "price", True).alias("price"), first_block(html, "brand").alias("brand"), F.when(F.length(told) > least, F.substring(told, 1, most)).otherwise("").alias("description"),
        F.slice(images, 1, IMAGES).alias("images"), F.slice(questions, 1, many).alias("questions"),
    )


def asked_by(html: Column, shop: str) -> Column:
    """Questions on a page, as structs (user, question, date): of each block of class qa the text of class user, of class text, if that is longer than two letters, and of class date. Blocks of the shop itself, and without a user, do not count."""
    whole = F.regexp_extract_all(html, F.lit(r"""(?is)<section\b[^>]*?\bclass\s*=\s*["'][^"']*\bqa\b[^"']*["'][^>]*>(.*?)</section\s*>"""), 1)
    rows = F.transform(whole, lambda x: F.struct(first_block(x, "user").alias("user"), first_block(x, "text").alias("question"), first_block(x, "date").alias("date")))
    return F.filter(rows, lambda r: (F.length(r.question) > 2) & (r.user != "") & (r.user != shop))
