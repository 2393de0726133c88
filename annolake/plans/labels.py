"""Audits, curation, splits, samples and metrics over the labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import labels as L
from annolake.functions import rules
from annolake.functions.text import blank, fold, level, slug, strip, word_count
from annolake.operators import audit, curate, metrics, splits
from annolake.operators.skew import hot_join
from annolake.sources.tables import table

SEED = 42


def _labelled(spark: SparkSession, d: str, name: str = "hasaki_labelled_full") -> DataFrame:
    return table(spark, d, name).withColumns({f"l{k}": level("intent_3_level", k) for k in (1, 2, 3)})


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intent_nodes").filter("node_level = 'l3'").select("l3")


def audit_distribution(spark, d):
    return audit.label_distribution(_labelled(spark, d).select("l1", "l2", "l3"), _known(spark, d)).orderBy("l1", "l2", F.desc("count"), "l3")


def audit_longtail(spark, d):
    return audit.long_tail(audit_distribution(spark, d)).withColumn("imbalance", F.round("imbalance", 6))


def taxonomy_setops(spark, d):
    """Slugs of the data against those of the taxonomy."""
    data = _labelled(spark, d).select(slug(F.col("l3")).alias("slug")).filter("slug <> ''").distinct().withColumn("data", F.lit(True))
    known = _known(spark, d).select(slug(F.col("l3")).alias("slug")).distinct().withColumn("known", F.lit(True))
    side = F.when(F.col("data") & F.col("known"), "both").when(F.col("data"), "only_data").otherwise("only_taxonomy")
    return data.join(known, "slug", "full").groupBy(side.alias("side")).agg(F.count("*").alias("slugs"))


def dup_stats(spark, d):
    return audit.duplicates(_labelled(spark, d), {"exact": F.col("sentence"), "trimmed_lower": F.lower(strip(F.col("sentence")))})


def text_lengths(spark, d):
    return audit.describe(table(spark, d, "documents"), {"words": word_count(F.col("text")), "chars": F.length("text")})


def length_histogram(spark, d):
    return audit.histogram(table(spark, d, "documents"), F.length("text"), 30).select("bin", "n")


def confidence_histogram(spark, d):
    return audit.histogram(_labelled(spark, d), F.round("confidence", 6), 20).select("bin", "n")


def status_shares(spark, d):
    return audit.shares(_labelled(spark, d), F.col("qa_status"), "qa_status")


def dominant_labels(spark, d):
    """Labels of level 2 that hold more than 3 % of the rows."""
    return audit.shares(_labelled(spark, d), F.col("l2"), "l2").filter("percent > 3 and l2 <> ''")


def issue_table(spark, d):
    rows = _labelled(spark, d).join(_known(spark, d).distinct().withColumn("known", F.lit(True)), "l3", "left")
    status = F.coalesce("qa_status", F.lit(""))
    issues = {
        "invalid_slug": (F.col("l3") != "") & ~rules.is_slug(F.col("l3")), "skipped_ambiguous": status == "skipped_ambiguous", "needs_review": status.rlike("needs_review|pending"),
        "not_in_taxonomy": (F.col("l3") != "") & F.col("known").isNull(), "under_five_words": word_count(F.col("sentence")) < 5, "no_label": F.col("l3") == "", "has_error": F.col("error").isNotNull(),
    }
    counted = rows.agg(*(F.count_if(c).alias(k) for k, c in issues.items()))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in issues))))


def dataset_summary(spark, d):
    rows = _labelled(spark, d)
    mean = lambda c: F.round(F.avg(c), 2)
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("qa_status").startswith("approved")).alias("approved"), F.count_if(F.coalesce("needs_human_review", F.lit(False))).alias("to_review"), F.count_if(F.col("l3") == "").alias("unlabelled"),
        *(F.countDistinct(f"l{k}").alias(f"l{k}_labels") for k in (1, 2, 3)), F.countDistinct("product_id").alias("products"), mean(word_count(F.col("sentence"))).alias("mean_words"), mean(F.length("sentence")).alias("mean_chars"), mean("confidence").alias("mean_confidence"),
    )


def level_counts(spark, d):
    parts = [_labelled(spark, d, t).agg(F.lit(t).alias("dataset"), F.count("*").alias("n"), *(F.countDistinct(f"l{k}").alias(f"l{k}") for k in (1, 2, 3))) for t in ("d1_annotator_train", "hasaki_labelled_clean", "hasaki_labelled_full_verified")]
    return reduce(DataFrame.unionByName, parts)


def verifier_summary(spark, d):
    done = F.col("verifier_decision")
    return _labelled(spark, d).agg(
        F.count("*").alias("total"), F.count(done).alias("verified"), F.count_if(done == "RETAIN").alias("retained"), F.count_if(done == "REVISE").alias("revised"), F.count("error").alias("failed"),
        F.round(F.count(done) / F.count("*"), 6).alias("coverage"), F.round(F.try_divide(F.count_if(done == "RETAIN"), F.count(done)), 6).alias("retain_rate"),
    )


def first_wins(spark, d):
    return curate.one_per_key(table(spark, d, "crawl_hasaki").select("product_id", "row_id", "product_name_raw"), ["product_id"], F.col("row_id"))


def last_wins(spark, d):
    return curate.one_per_key(table(spark, d, "hasaki_labelled_full").select("sample_id", "row_id", "qa_status"), ["sample_id"], F.col("row_id"), last=True)


def prelabel_join(spark, d):
    """Questions with the last record of their product, a running number per product and the sample id made of it, and what the question is like."""
    crawl = table(spark, d, "crawl_hasaki")
    last = F.max_by(F.struct("product_name", "brand", "image_url"), F.col("row_id")).alias("p")
    products = crawl.groupBy("product_id").agg(last, F.count("*").alias("n")).select("product_id", "n", F.col("p.product_name").alias("name"), F.coalesce("p.brand", F.lit("")).alias("brand"), "p.image_url")
    asked = curate.numbered(crawl.select("row_id", "product_id", "question", "product_name"), "product_id", "row_id", "nth")
    text = strip(F.coalesce("question", F.lit("")))
    image = F.when(F.coalesce("image_url", F.lit("")) != "", F.struct(F.array("image_url").alias("image_urls")))
    return hot_join(asked, products, ["product_id"], "n", "row_id", "left").select(
        "row_id", F.concat("product_id", F.lit("_q"), F.format_string("%02d", "nth")).alias("sample_id"), F.coalesce("product_name", "name").alias("product_name"), "brand", text.alias("sentence"), image.isNotNull().alias("has_image"), rules.asks(F.col("question")).alias("is_question"),
    )


def batch_numbers(spark, d):
    rows = table(spark, d, "unified_intents")
    return curate.batches(rows.select((F.col("row_id") - 1).alias("ord")), "ord", 4, "batch").groupBy("batch").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def _approved(df: DataFrame) -> DataFrame:
    return df.filter((F.col("qa_status") == "approved") & (F.coalesce("sample_id", F.lit("")) != ""))


def verified_partial(spark, d):
    """Approved clean rows that were not verified again, and approved ones of those that were."""
    clean, again = table(spark, d, "hasaki_labelled_clean"), table(spark, d, "hasaki_labelled_full_verified")
    columns = ("row_id", "sample_id", "sentence")
    kept = curate.without(_approved(clean), again, "sample_id").select(*columns, F.lit("clean").alias("from_set"))
    return kept.unionByName(_approved(again).select(*columns, F.lit("verified").alias("from_set")))


def verified_full(spark, d):
    return _approved(table(spark, d, "hasaki_labelled_full_verified")).select("row_id", "sample_id")


def matched_train(spark, d):
    """Ids approved in verification and not in the gold set, with the last training row of each, if there is one."""
    again, gold, train = table(spark, d, "hasaki_labelled_full_verified"), table(spark, d, "d3_human_gold"), table(spark, d, "hasaki_labelled_full")
    ids = curate.without(_approved(again).select("sample_id").distinct(), gold, "sample_id")
    last = curate.one_per_key(train.select("sample_id", "row_id"), ["sample_id"], F.col("row_id"), last=True)
    return ids.join(last, "sample_id", "left").select("sample_id", "row_id", F.col("row_id").isNull().alias("missing"))


def leakage(spark, d):
    return curate.overlap(table(spark, d, "d3_human_gold"), table(spark, d, "d1_annotator_train"), "sample_id")


def gold_levels(spark, d):
    gold = table(spark, d, "d3_human_gold")
    chosen = L.gold_or_machine([F.col(f"gold_level_{k}") for k in (1, 2, 3)], [F.col(f"machine_level_{k}") for k in (1, 2, 3)])
    named = gold.select("gold_id", *(c.alias(f"l{k}") for k, c in enumerate(chosen, 1)))
    return named.filter("l1 <> '' and l2 <> '' and l3 <> ''").select("gold_id", "l1", "l2", "l3", L.path(*map(F.col, ("l1", "l2", "l3"))).alias("label"))


def template_rows(spark, d):
    """Rows for annotators: the machine's levels, and blank ones to fill in."""
    rows = _labelled(spark, d, "hasaki_labelled_clean")
    return rows.select("row_id", "sample_id", *(F.col(f"l{k}").alias(f"machine_level_{k}") for k in (1, 2, 3)), *(F.lit("").alias(f"gold_level_{k}") for k in (1, 2, 3)), F.lit("").alias("human_notes"))


def bulk_update_dry(spark, d):
    """How many rows a renaming of level 1 would change: labels that are known but for case, marks and accents."""
    known = table(spark, d, "intent_nodes").filter("node_level = 'l1'").select(F.col("l1").alias("new"), F.regexp_replace("l1", "_", "").alias("key")).distinct()
    rows = _labelled(spark, d).select("l1", F.regexp_replace(fold(F.col("l1")), "[^a-z0-9]", "").alias("key"))
    return rows.join(known, "key").filter("l1 <> new").groupBy("new").agg(F.count("*").alias("matched"), F.countDistinct("l1").alias("spellings"))


def _strata(spark, d) -> DataFrame:
    return _labelled(spark, d).select("row_id", "l1", "l2", "l3", "qa_status").filter("qa_status = 'approved'")


def split_assign(spark, d):
    return splits.split(_strata(spark, d), "row_id", 0.7, 0.15, 3, SEED).select("row_id", "stratum", "split")


def split_sizes(spark, d):
    return splits.split_sizes(splits.with_stratum(_strata(spark, d), 3).groupBy("stratum").agg(F.count("*").alias("n")), 0.7, 0.15)


def gold_sample(spark, d):
    rows = _labelled(spark, d).select("row_id", "l1", "l2", "l3").filter("l1 <> '' and l2 <> '' and l3 <> ''")
    return splits.coverage_sample(rows, "row_id", 300, SEED).select("row_id", "phase")


def _judged(spark, d) -> DataFrame:
    gold = table(spark, d, "d3_human_gold").filter(" and ".join(f"coalesce(gold_level_{k}, '') <> ''" for k in (1, 2, 3)))
    rows = gold.select("gold_id", *(F.coalesce(f"{s}_level_{k}", F.lit("")).alias(f"{s[0]}{k}") for s in ("gold", "machine") for k in (1, 2, 3)))
    return rows.withColumns({"g": L.path(F.col("g1"), F.col("g2"), F.col("g3")), "m": L.path(F.col("m1"), F.col("m2"), F.col("m3"))})


def metrics_hier(spark, d):
    return metrics.hierarchical(_judged(spark, d), {"l1": ("g1", "m1"), "l2": ("g2", "m2"), "l3": ("g3", "m3"), "path": ("g", "m")})


def confusion_topn(spark, d):
    return metrics.confusion(_judged(spark, d), "g2", "m2", 12)


def label_index(spark, d):
    """A dense number for each label of either side, in the order of their names."""
    rows = _judged(spark, d)
    names = rows.select(F.col("g").alias("label")).union(rows.select("m")).distinct()
    from pyspark.sql import Window

    return names.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("number"))


def review_funnel(spark, d):
    rows = _labelled(spark, d)
    steps = {"all": F.lit(True), "labelled": F.col("l3") != "", "without_error": (F.col("l3") != "") & F.col("error").isNull(), "no_review_needed": (F.col("l3") != "") & F.col("error").isNull() & ~F.coalesce("needs_human_review", F.lit(False))}
    counted = rows.agg(*(F.count_if(c).alias(k) for k, c in steps.items()))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.col(k).alias("n"), F.round(F.try_divide(F.col(k), F.col("all")), 6).alias("share")) for k in steps))))


def ambiguity_filter(spark, d):
    rows = table(spark, d, "crawl_hasaki").select(rules.vague(F.col("question")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def questions_asked(spark, d):
    return table(spark, d, "crawl_hasaki").filter(rules.asks(F.col("question"))).select("row_id")


def product_names(spark, d):
    return table(spark, d, "crawl_hasaki").select("row_id", rules.product_name(F.col("product_name_raw")).alias("name"))


def link_ids(spark, d):
    return table(spark, d, "documents").filter("url is not null").select("doc_id", rules.link_id(F.col("url")).alias("link_id"))


def confidence_notes(spark, d):
    return table(spark, d, "unified_intents").groupBy(rules.confidence(F.col("confidence_level")).alias("confidence")).agg(F.count("*").alias("n"))


def blank_fields(spark, d):
    rows = table(spark, d, "unified_intents")
    names = ("description", "detection_signals", "examples", "domain", "logic_category")
    counted = rows.agg(*(F.count_if(blank(F.col(n))).alias(n) for n in names))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("blanks")) for n in names))))


NAMES = "audit_distribution audit_longtail taxonomy_setops dup_stats text_lengths length_histogram confidence_histogram status_shares dominant_labels issue_table dataset_summary level_counts verifier_summary first_wins last_wins prelabel_join batch_numbers verified_partial verified_full matched_train leakage gold_levels template_rows bulk_update_dry split_assign split_sizes gold_sample metrics_hier confusion_topn label_index review_funnel ambiguity_filter questions_asked product_names link_ids confidence_notes blank_fields".split()
QUERIES = {name: globals()[name] for name in NAMES}
