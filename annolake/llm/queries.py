"""Queries of the problems of this subpackage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.canonical import canonical_fields
from annolake.functions.text import blank, strip
from annolake.llm.copies import copies
from annolake.llm.leaks import leaks, near_leaks
from annolake.llm.mapping import map_values
from annolake.llm.overlap import classes, keyed, members, near_same, same_classes
from annolake.llm.packing import counter, pack
from annolake.llm.residue import residue
from annolake.llm.sampling import proportional_sample
from annolake.operators.skew import spread_join
from annolake.sources.tables import spread, table


#: Words by which two sentences may differ and still be the same; and the share of a sentence that must stay, as pairs that share a clause only are no cases.
MOST_WORDS, STAYS = 6, 0.5


def _rows(spark: SparkSession, d: str) -> list[DataFrame]:
    """The rows (id, text, key, part) of both sides: key is the sample id for comparisons, part the split or source."""
    key = F.nullif(F.regexp_replace(F.lower(strip(F.col("sample_id"))), r"_q0+(?=\d)", "_q"), F.lit(""))
    sides = (("d3_human_gold", "gold_id", "split"), ("d1_annotator_train", "train_id", "label_source"))
    return [spread(table(spark, d, t).select(F.col(i).alias("id"), F.col("sentence").alias("text"), key.alias("key"), F.col(part).alias("part"))) for t, i, part in sides]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    gold, train = _rows(spark, d)
    named = [df.select("key", F.col("id").alias(i)).filter("key is not null") for df, i in ((gold, "gold_id"), (train, "train_id"))]
    by_id = spread_join(*named, ["key"], "train_id", merge=True).select("gold_id", "train_id")
    by_text = near_same(gold.select("id", "text"), train.select("id", "text"), MOST_WORDS, STAYS).select(F.col("id").alias("gold_id"), F.col("other_id").alias("train_id"))
    return by_id.unionByName(by_text).distinct()


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by sentence between classes of rows with one wording: the classes' least ids, their rows, and the links of the gold class."""
    gold, train = (classes(keyed(df.select("id", "text"))) for df in _rows(spark, d))
    pairs = same_classes(gold, train, MOST_WORDS, STAYS)
    sized = pairs.join(gold.select("class", F.col("n").alias("gold_rows")).hint("merge"), "class").join(train.select(F.col("class").alias("other"), F.col("n").alias("train_rows")).hint("merge"), "other")
    links = pairs.groupBy("class").agg(F.count("*").alias("links"))
    return sized.join(links.hint("merge"), "class").select(F.col("class").alias("gold_class"), F.col("other").alias("train_class"), "gold_rows", "train_rows", "links")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps and overlapping rows per split of the gold rows and source of the training rows.

    Rows of one wording, key and part are alike, and are one group: pairs are counted between groups, and not made.
    """
    sides = []
    for df in _rows(spark, d):
        rows = keyed(df.select("id", "text"))
        each = classes(rows)
        alike = df.select("id", "key", "part").join(members(rows, each).hint("merge"), "id", "left").groupBy("key", "part", "class").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        sides.append((each, alike))
    (gold, left), (train, right) = sides
    right = right.select("key", F.col("part").alias("label_source"), F.col("class").alias("other"), F.col("id").alias("train_group"), F.col("n").alias("m"))
    left = left.select("key", F.col("part").alias("split"), "class", F.col("id").alias("gold_group"), "n")
    shown = ("gold_group", "n", "split", "train_group", "m", "label_source")
    by_id = spread_join(left.filter("key is not null"), right.filter("key is not null"), ["key"], "train_group", merge=True).select(*shown)
    linked = spread_join(same_classes(gold, train, MOST_WORDS, STAYS), left.drop("key"), ["class"], "gold_group", merge=True)
    by_text = spread_join(linked, right.drop("key"), ["other"], "train_group", merge=True).select(*shown)
    pairs = by_id.unionByName(by_text).distinct()
    part = ["split", "label_source"]
    rows = [pairs.select(*part, F.struct(F.lit(g).alias("side"), F.col(g).alias("id")).alias("g"), F.col(c).alias("rows"), F.col("n") * F.col("m") * (1 if g == "gold_group" else 0)) for g, c in (("gold_group", "n"), ("train_group", "m"))]
    one = rows[0].toDF(*part, "g", "rows", "pairs").unionByName(rows[1].toDF(*part, "g", "rows", "pairs")).groupBy(*part, "g").agg(F.max("rows").alias("rows"), F.sum("pairs").alias("pairs"))
    of = lambda side: F.sum(F.when(F.col("g.side") == side, F.col("rows")))
    return one.groupBy(*part).agg(F.sum("pairs").alias("pairs"), of("gold_group").alias("gold_rows"), of("train_group").alias("train_rows"))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    parts = (("crawl_hasaki", ["question", "product_name_raw"]), ("hasaki_labelled_full", ["sentence"]))
    return reduce(DataFrame.unionByName, (canonical_fields(spread(table(spark, d, t).select("row_id", *fields)), "row_id", fields).withColumn("src", F.lit(t)) for t, fields in parts))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("src", "row_id", "field_name")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The affected fields with their text in one form."""
    return _forms(spark, d).select("src", "row_id", "field_name", "form")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Affected fields that hold full-width characters, odd blanks, and letters whose parts are apart; a field may count under each."""
    kinds = {"width": F.col("val").rlike(r"[\x{FF01}-\x{FF5E}]"), "blank": F.col("val").rlike(r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"), "apart": F.col("val").rlike(r"[a-zA-Z\x{C0}-\x{1EF9}][\x{300}\x{301}\x{303}\x{309}\x{323}]")}
    counted = _forms(spark, d).groupBy("src", "field_name").agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))
    return counted.select("src", "field_name", *kinds)


RAW = ("product_id", "product_name", "user", "question", "date")


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "crawl_raw")
    parsed = F.from_json("payload", ", ".join(f"{f} string" for f in RAW))
    whole = F.when(parsed.isNull() | F.forall(F.array(*(parsed[f] for f in RAW)), lambda x: x.isNull()), F.array("payload")).otherwise(F.array(*(parsed[f] for f in RAW)))
    tables = (
        ("crawl_hasaki", table(spark, d, "crawl_hasaki"), "row_id", F.array("product_id", "question")),
        ("hasaki_labelled_full", table(spark, d, "hasaki_labelled_full"), "row_id", F.array("category", "sentence")),
        ("crawl_raw", raw, "rec_id", whole),
    )
    return reduce(DataFrame.unionByName, (spread(df.select(F.lit(t).alias("src"), F.col(key).alias("id"), fields.alias("fields"))) for t, df, key, fields in tables))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(_records(spark, d))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each record that recurs, the number of its copies with itself."""
    return p6_found(spark, d).groupBy("src", "first_id").agg((F.count("*") + 1).alias("copies"))


#: Least Jaccard similarity of letters and letter pairs; two slips in a name of seven letters still reach it.
LEAST = 0.45
#: A brand name has up to three words, and a slip may part one of them.
BRAND_WORDS = 4


def _lists(spark: SparkSession, d: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Values (row_id, list, val) and canonical lists (list, id, text), a list for each field."""
    nodes, full = table(spark, d, "intent_nodes"), table(spark, d, "hasaki_labelled_full")
    name = lambda k: F.lit(k).alias("list")
    label = F.expr("substring(node_id, instr(node_id, ':') + 1)")
    entries = [nodes.filter(F.col("node_level") == f"l{k}").select(name(f"level_{k}"), F.col("node_id").alias("id"), label.alias("text")) for k in (1, 2, 3)]
    entries.append(table(spark, d, "brand_list").select(name("product_name_raw"), F.col("brand_id").alias("id"), F.col("brand_name").alias("text")))
    values = [full.select("row_id", name(f"level_{k}"), F.col(f"intent_3_level.level_{k}").alias("val")) for k in (1, 2, 3)]
    values.append(spread(table(spark, d, "crawl_hasaki").select("row_id", name("product_name_raw"), F.col("product_name_raw").alias("val"))))
    return [v.filter(~blank(F.col("val"))) for v in values], entries


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """All lists at once."""
    values, entries = (reduce(DataFrame.unionByName, x) for x in _lists(spark, d))
    found = map_values(values, entries, LEAST, {"product_name_raw": BRAND_WORDS})
    src = F.when(F.col("list") == "product_name_raw", "crawl_hasaki").otherwise("hasaki_labelled_full").alias("src")
    return found.select(src, "row_id", F.col("list").alias("field_name"), "val", "canonical_id", "similarity")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("src", "row_id", "field_name", "canonical_id")


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """The different labels that are typed freely, with the entry that each is mapped to."""
    values, entries = (reduce(DataFrame.unionByName, x[:3]) for x in _lists(spark, d))
    return map_values(values.select("list", "val").distinct(), entries, LEAST).select(F.col("list").alias("field_name"), "val", "canonical_id")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The typed values that match no entry, with the number of their rows."""
    return _mapped(spark, d).filter("canonical_id = ''").groupBy("src", "field_name", "val").agg(F.count("*").alias("n"))


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return docs, table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(*_corpus(spark, d), 12)


def p9_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with up to three other words between runs of five words or more."""
    return near_leaks(*_corpus(spark, d), 12, 5, 3)


def p9_leaked(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, with the number of documents that hold them."""
    items = table(spark, d, "eval_items").select("item_id", "split")
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


def _residue(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#]+)", 1), F.col("source"))
    return residue(spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", host.alias("host"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select(F.col("id").alias("doc_id")).distinct()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents and lines per kind of evidence; a line counts under each kind that it holds."""
    return _residue(spark, d).groupBy("kind").agg(F.countDistinct("id").alias("documents"), F.count("*").alias("lines"))


#: Rows of the sample, the least of a category, and the seed of its order.
SAMPLE, FLOOR, SEED = 1000, 2, 7


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "hasaki_labelled_full").select("row_id", F.col("intent_3_level.level_3").alias("level_3"))
    targets = table(spark, d, "intent_distribution").select(F.col("l3").alias("category"), F.col("count").alias("weight"))
    return proportional_sample(rows, "row_id", strip(F.col("level_3")), targets, SAMPLE, FLOOR, SEED)


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0].select("row_id", F.col("drawn_as").alias("category"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per category: rows available, target weight and share, rows wanted and drawn, their share, and whether the target was met."""
    return _sampled(spark, d)[1]


#: The public tokenizer; its file stays where it is.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    sizes = docs.mapInArrow(counter(str(tokenizers.path(VOCABULARY)), tokenizers.PATTERN), "id bigint, tokens bigint")
    capacities = [r.capacity for r in table(spark, d, "pack_sizes").select("capacity").distinct().toLocalIterator() if r.capacity]
    return pack(sizes, capacities)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, and the share of their room that is used."""
    used = _packed(spark, d).filter("container > 0").groupBy("capacity").agg(F.max("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return used.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_report": p2_report, "p4_found": p4_found, "p4_forms": p4_forms, "p4_kinds": p4_kinds, "p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p5_sample": p5_sample, "p5_report": p5_report, "p7_labels": p7_labels, "p7_unmatched": p7_unmatched, "p8_packed": p8_packed, "p8_usage": p8_usage, "p9_found": p9_found, "p9_proximity": p9_proximity, "p9_leaked": p9_leaked, "p10_found": p10_found, "p10_report": p10_report}
