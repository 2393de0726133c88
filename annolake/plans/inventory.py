"""Further queries of the inventory: joins of gold and predictions, brands, summaries, node texts, pages, files, models as plug-ins, and the SQL of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolake.config import from_environment
from annolake.functions import labels as L
from annolake.functions import rules
from annolake.functions.text import level, strip, word_count
from annolake.operators import annotate, audit, curate, metrics, retrieval, taxonomy
from annolake.plans import labels_sql as sql
from annolake.session import work_folder
from annolake.sources import files
from annolake.sources.tables import table

LABELLED = "hasaki_labelled_full"
#: Who answers on the pages; the shop's own blocks are no questions.
SHOP = "SHOP"


def gold_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Gold rows with the last prediction of their sample, as far as there is one: agreement per level."""
    gold = table(spark, d, "d3_human_gold").filter(" and ".join(f"coalesce(gold_level_{k}, '') <> ''" for k in (1, 2, 3)))
    last = curate.one_per_key(table(spark, d, "d1_annotator_train").select("sample_id", "train_id", "intent_3_level"), ["sample_id"], F.col("train_id"), last=True)
    rows = gold.select("sample_id", *(F.col(f"gold_level_{k}").alias(f"g{k}") for k in (1, 2, 3))).join(last.select("sample_id", *(level("intent_3_level", k).alias(f"m{k}") for k in (1, 2, 3))), "sample_id")
    rows = rows.withColumns({"g": L.path(*map(F.col, ("g1", "g2", "g3"))), "m": L.path(*map(F.col, ("m1", "m2", "m3")))})
    return metrics.hierarchical(rows, {"l1": ("g1", "m1"), "l2": ("g2", "m2"), "l3": ("g3", "m3"), "path": ("g", "m")}).filter("n > 0")


def ablation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the machine's accuracy over three parts of each split, by configuration (the split) and method."""
    gold = table(spark, d, "d3_human_gold").filter("coalesce(gold_level_1, '') <> ''")
    hit = lambda k: F.avg((F.col(f"gold_level_{k}") == F.coalesce(f"machine_level_{k}", F.lit(""))).cast("double"))
    runs = gold.groupBy(F.col("split").alias("configuration"), F.lit("machine").alias("method"), (F.col("gold_id") % 3).alias("seed")).agg(hit(1).alias("l1"), hit(2).alias("l2"))
    return metrics.by_configuration(runs, ["configuration", "method"], ["l1", "l2"])


def product_brands(spark: SparkSession, d: str) -> DataFrame:
    """Product names without what stands around them, parted into brand and name: the longest brand of the list that the name begins with, else capitalised parts written together."""
    rows = table(spark, d, "crawl_hasaki").select("row_id", rules.bare_name(F.col("product_name_raw")).alias("bare"))
    brands = table(spark, d, "brand_list").filter("brand_name <> ''").select("brand_name", F.substring("brand_name", 1, 1).alias("letter"))
    met = rows.withColumn("letter", F.substring("bare", 1, 1)).join(brands, "letter").filter(F.startswith("bare", "brand_name"))
    best = met.groupBy("row_id").agg(F.max(F.struct(F.length("brand_name").alias("n"), "brand_name")).alias("b")).select("row_id", F.col("b.brand_name").alias("known"))
    brand = F.coalesce("known", rules.joined_capitals(F.col("bare")), F.lit(""))
    named = rows.join(best, "row_id", "left").withColumn("brand", brand)
    name = F.when(F.col("brand") == "", F.col("bare")).otherwise(strip(F.expr("substring(bare, length(brand) + 1)")))
    return named.select("row_id", "brand", F.regexp_replace(name, rules.BEHIND_SIZE, "$1").alias("product_name"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LABELLED).withColumns({f"l{k}": level("intent_3_level", k) for k in (1, 2, 3)})


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intent_nodes").filter("node_level = 'l3'").select("l3").distinct().withColumn("known", F.lit(True))


def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    """Rows per issue, and their total without the last one, which overlaps the others."""
    rows = _labelled(spark, d).join(_known(spark, d), "l3", "left")
    status = F.coalesce("qa_status", F.lit(""))
    issues = {
        "invalid_slug": status == "pending_new_label_invalid_slug", "skipped_ambiguous": status == "skipped_ambiguous", "needs_review": status.rlike("needs_review|pending"),
        "not_in_taxonomy": (F.col("l3") != "") & F.col("known").isNull(), "under_five_words": word_count(F.col("sentence")) < 5, "no_label": F.col("l3") == "",
    }
    counted = rows.agg(*(F.count_if(c).alias(k) for k, c in issues.items())).select(F.inline(F.array(*(F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in issues))))
    twice = audit.duplicates(_labelled(spark, d), {"duplicates": F.col("sentence")}).select(F.col("kind").alias("issue"), F.col("members").alias("n"))
    each = counted.unionByName(twice)
    return each.unionByName(each.filter("issue <> 'no_label'").agg(F.lit("total").alias("issue"), F.sum("n").alias("n")))


def summary_scalars(spark: SparkSession, d: str) -> DataFrame:
    """A labelled table in 21 numbers."""
    rows = _labelled(spark, d)
    status = F.coalesce("qa_status", F.lit(""))
    usable = from_environment({}).usable_qa_statuses
    mean = lambda c: F.round(F.avg(c), 2)
    one = rows.agg(
        F.count("*").alias("total_samples"), F.count_if(status.isin(*sorted(usable))).alias("usable_approved"), F.count_if(status.rlike("needs_review|pending")).alias("needs_human_review"), F.count_if(status == "skipped_ambiguous").alias("skipped_ambiguous"),
        F.count_if(status == "pending_new_label_invalid_slug").alias("invalid_slug"), F.countDistinct("l1").alias("unique_l1"), F.countDistinct("l2").alias("unique_l2"),
        mean(word_count(F.col("sentence"))).alias("avg_word_count"), mean(F.length("sentence")).alias("avg_char_count"), F.count_if(F.col("l1") == "truoc_mua_hang").alias("l1_before_sale"), F.count_if(F.col("l1") == "sau_mua_hang").alias("l1_after_sale"),
    )
    classes = rows.filter("l3 <> ''").groupBy("l3").agg(F.count("*").alias("n")).join(_known(spark, d), "l3", "full")
    n, seen = F.col("n"), F.col("n").isNotNull()
    two = classes.agg(
        F.count_if(seen).alias("unique_l3_in_data"), F.count("known").alias("unique_l3_in_taxonomy"), F.count_if(seen & F.col("known").isNotNull()).alias("l3_covered"), F.count_if(~seen).alias("l3_missing_coverage"), F.count_if(F.col("known").isNull()).alias("l3_oov_in_data"),
        F.count_if(n >= audit.LOW).alias("intents_sufficient"), F.count_if(n < audit.LOW).alias("intents_need_augment"), F.sum(F.greatest(F.lit(0), audit.LOW - n)).alias("total_gap_to_fill"), F.round(F.max(n) / F.min(n), 2).alias("imbalance_ratio"),
    )
    three = audit.duplicates(rows, {"exact": F.col("sentence")}).select(F.col("members").alias("exact_duplicates"))
    named = [df.select(F.lit(1).alias("one"), "*") for df in (one, two, three)]
    return reduce(lambda a, b: a.join(b, "one"), named).drop("one")


def large_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of any level that hold more than 8 % of the rows."""
    parts = [audit.shares(_labelled(spark, d), F.col(f"l{k}"), "label").filter("percent > 8 and label <> ''").select(F.lit(f"l{k}").alias("level"), "label", "n", "percent") for k in (1, 2, 3)]
    return reduce(DataFrame.unionByName, parts)


def approved_only(spark: SparkSession, d: str) -> DataFrame:
    """Rows that were approved, of tables in which any row has a status; all rows of the others."""
    clean = table(spark, d, "hasaki_labelled_clean").select("row_id", "qa_status")
    bare = clean.withColumn("qa_status", F.lit("  ").substr(1, 0))
    return curate.only_approved(clean, "qa_status", "approved").select(F.lit("clean").alias("from_set"), "row_id").unionByName(curate.only_approved(bare, "qa_status", "approved").select(F.lit("bare").alias("from_set"), "row_id"))


def status_queues(spark: SparkSession, d: str) -> DataFrame:
    """Rows for people to review, and usable ones, by the statuses of the configuration."""
    config, status = from_environment({}), F.coalesce("qa_status", F.lit(""))
    counted = table(spark, d, LABELLED).agg(F.count_if(status.isin(*sorted(config.human_review_qa_statuses))).alias("review"), F.count_if(status.isin(*sorted(config.usable_qa_statuses))).alias("usable"))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(k).alias("queue"), F.col(k).alias("n")) for k in ("review", "usable")))))


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows from the twentieth on."""
    rows = table(spark, d, "unified_intents").select("row_id", "ma_intent", (F.col("row_id") - 1).alias("ord"))
    return curate.offset_rows(rows, "ord", 20, 10).select("row_id", "ma_intent")


def annotated_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of verified rows, with those from before where the rules for annotations say so, taken apart again from one label."""
    rows = table(spark, d, "hasaki_labelled_full_verified")
    label = L.path(*L.annotated(F.col("intent_3_level"), F.col("intent_3_level_before_reverify")))
    return rows.select("row_id", *(c.alias(f"l{k}") for k, c in enumerate(L.levels_of(label), 1)))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LABELLED).select("row_id", L.prediction(F.col("intent_3_level"), F.col("confidence"), F.col("reasoning")).alias("p")).select("row_id", "p.*")


def slim_train(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each sample as a training row, with its source."""
    last = curate.one_per_key(table(spark, d, LABELLED).filter("coalesce(sample_id, '') <> ''").select("sample_id", "row_id", "sentence", "category", "intent_3_level", "confidence", "qa_status"), ["sample_id"], F.col("row_id"), last=True)
    return last.select("sample_id", F.coalesce("sentence", F.lit("")).alias("sentence"), F.coalesce("category", F.lit("")).alias("category"), L.path(*(level("intent_3_level", k) for k in (1, 2, 3))).alias("label"), "confidence", "qa_status", F.lit("annotator").alias("label_source"))


def prelabel_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested records for annotators; what they hold, field by field."""
    crawl = table(spark, d, "crawl_hasaki")
    text = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    image = F.when(text("image_url") != "", F.struct(F.array("image_url").alias("image_urls"), none.alias("local_paths")))
    intent = F.struct(F.lit("").alias("level_1"), F.lit("").alias("level_2"), none.alias("level_3"))
    record = F.struct(
        text("product_id").alias("product_id"), text("brand").alias("brand"), strip(text("question")).alias("sentence"), image.alias("image"), none.alias("spans"), rules.asks(F.col("question")).alias("isWhQuestion"), intent.alias("intent"),
        F.lit("text").alias("modality"), F.lit(False).alias("cross_modal_ref"), F.lit(None).cast("string").alias("difficulty"), F.lit("crawl").alias("source"),
    )
    rows = crawl.select("row_id", record.alias("r"))
    return rows.select("row_id", "r.product_id", "r.sentence", F.col("r.image.image_urls")[0].alias("image_url"), F.size("r.spans").alias("spans"), F.concat("r.intent.level_1", F.array_join("r.intent.level_3", ",")).alias("intent"), "r.modality", "r.cross_modal_ref", "r.difficulty", "r.source")


def bulk_update(spark: SparkSession, d: str) -> DataFrame:
    """Labels of level 1 in their known spelling, of rows where that changes them."""
    rows = table(spark, d, "unified_intents").select("row_id", F.coalesce("l1_category", F.lit("")).alias("l1"))
    changes = {"l1": rules.level_one(F.col("l1"))}
    done = curate.updated(rows.withColumn("old", F.col("l1")), changes["l1"] != F.col("l1"), changes)
    return done.select("row_id", "old", "l1", (F.col("old") != F.col("l1")).alias("changed"))


def picked_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unified_intents").select("row_id", rules.picked_name(F.col("intent_name"), F.col("l2_intent"), F.col("l3_specific_intent")).alias("name"))


def set_on_insert(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, with the type of the first one."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return curate.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "user_id", "event_id", ("event_type",))


def graph_texts(spark: SparkSession, d: str) -> DataFrame:
    """The six-line text of each intent: its path, parent, up to five siblings, description, signals and example."""
    rows = table(spark, d, "unified_intents").select(F.col("ma_intent").alias("id"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("l1_category", "l1"), ("l2_intent", "l2"), ("l3_specific_intent", "l3"), ("description", "d"), ("detection_signals", "s"), ("examples", "e"))))
    own = taxonomy.siblings(rows, 5)
    listed = F.when(F.size("siblings") > 0, F.array_join("siblings", ", ")).otherwise("None")
    lines = [F.concat(F.lit("Intent: "), F.concat_ws(".", "l1", "l2", "l3"), F.lit(".")), F.concat(F.lit("Parent: "), "l2", F.lit(".")), F.concat(F.lit("Siblings: "), listed, F.lit("."))]
    lines += [F.concat(F.lit(f"{name}: "), F.col(c)) for name, c in (("Description", "d"), ("Signals", "s"), ("Example", "e"))]
    return own.select("id", F.concat_ws("\n", *lines).alias("text"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_hasaki").filter("row_id % 100 = 0").select(F.col("row_id").alias("id"), F.col("question").alias("text"), F.col("category_name").alias("category"))


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For every question whose id is divisible by 100: the six best labels by words, then the four nearest by vectors of an encoder without weights, each label once."""
    nodes = table(spark, d, "intent_nodes").filter("node_level = 'l3'")
    texts = nodes.select("node_id", F.concat_ws(" ", "name", "description", "l3").alias("text"), F.col("domain").alias("category"), L.path(F.col("l1"), F.col("l2"), F.col("l3")).alias("key"))
    words = retrieval.top_keywords(_asked(spark, d), texts, 6)
    model = annotate.hashed_words(64, unit=False)
    number = F.row_number().over(Window.partitionBy(F.substring("node_id", 1, 3)).orderBy("node_id")).cast("bigint")  # the catalog is of fixed size
    numbered = texts.select("node_id", "text", (-number).alias("id"))
    rows = annotate.encode(numbered.select("id", "text"), "text", "vector", model)
    near = retrieval.top_similar(annotate.encode(_asked(spark, d).select("id", "text"), "text", "vector", model), rows, 4, 0.3)
    near = near.join(numbered.select("id", "node_id"), "id").select("query_id", "node_id", "rank")
    return retrieval.union_ranked([words, near], 10).select("query_id", "node_id", F.col("rank").cast("bigint").alias("rank"))


def verified_calls(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a verifier that fails at every seventh letter count; what fails is retained."""

    def factory():
        def model(text: str) -> str:
            if len(text) % 7 == 0:
                raise TimeoutError("no answer")
            return 'Sure:\n```json\n{"decision": "%s"}\n```' % ("REVISE" if len(text) % 3 == 0 else "RETAIN")

        return model

    rows = table(spark, d, LABELLED).select("row_id", "sentence")
    asked = annotate.call_model(rows, "sentence", factory, tries=2, pause=lambda s: None)
    decision = F.coalesce(rules.json_in(F.col("answer"), "decision string")["decision"], F.lit("RETAIN"))
    return asked.select("row_id", decision.alias("decision"), F.col("failure").isNotNull().alias("failed"))


def label_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A question to a model for each label of level 2: its name, and its labels of level 3 as numbered candidates."""
    nodes = table(spark, d, "intent_nodes").filter("node_level = 'l3' and l2 is not null").groupBy("l2").agg(F.array_sort(F.collect_set("l3")).alias("c"))
    return nodes.select("l2", annotate.prompt("Choose one:", F.col("l2"), F.col("c")).alias("prompt"))


def numeric_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes of confidence that are numbers, and those that are none."""
    number = strip(F.col("confidence_level")).try_cast("double")
    return table(spark, d, "unified_intents").agg(F.count(number).alias("numbers"), F.count_if(number.isNull()).alias("others"), F.round(F.avg(number), 6).alias("mean"))


def _page_text(c: str):
    """Text as a page holds it."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def page_products(spark: SparkSession, d: str) -> DataFrame:
    """Products read from their pages; the pages are made of the crawled rows."""
    row = table(spark, d, "crawl_hasaki")
    html = F.concat(
        F.lit('<div class="Price-box">ask</div><span class="item-price">'), F.col("row_id").cast("string"), F.lit(' VND</span><a class="brand">'), _page_text("brand"), F.lit('</a><p class="description">'), F.repeat(_page_text("question"), F.lit(20)),
        F.lit('</p><img src="'), F.coalesce("image_url", F.lit("none")), F.lit('"><img src="x.png"><img src="x.png"><div class="question">'), _page_text("question"), F.lit('</div><div class="question">short</div>'),
    )
    page = row.select("row_id", rules.product_page(html).alias("p"))
    return page.select("row_id", "p.price", "p.brand", F.length("p.description").alias("described"), F.array_join("p.images", " ").alias("images"), F.array_join("p.questions", "|").alias("questions"))


def page_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions read from pages with answers of the shop between."""
    row = table(spark, d, "crawl_hasaki").filter("product_id is not null")
    block = F.concat(F.lit('<section class="qa border"><p class="user bold">'), _page_text("user_name"), F.lit('</p><p class="text">'), _page_text("question"), F.lit('</p><p class="date">'), _page_text("question_date"), F.lit("</p></section>"))
    html = F.concat(block, F.lit(f'<section class="qa"><p class="user">{SHOP}</p><p class="text">Thanks!</p></section>'))
    return row.select("row_id", F.explode(rules.asked_by(html, SHOP)).alias("q")).select("row_id", "q.user", "q.question")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages of a list (50 rows each): each once, with the first page that has it; pages from the first one without a new link on are not asked for."""
    row = table(spark, d, "crawl_hasaki").filter("product_url is not null and product_url not rlike '[\"''#]'")
    html = F.concat(F.lit('<a class="p" href="'), "product_url", F.lit('">x</a>'))
    pages = row.select(F.floor(F.col("row_id") / 50).alias("page"), F.explode(rules.links(html)).alias("link"))
    first = pages.groupBy("link").agg(F.min("page").alias("page"))
    new = first.select("page").distinct()
    gaps = pages.select("page").distinct().join(new, "page", "left_anti").agg(F.min("page").alias("end"))
    end = F.coalesce(gaps.scalar(), F.lit(1 << 60))
    return first.filter(F.col("page") < end).select("link", "page", rules.link_id(F.col("link")).alias("product_id"))


def files_read(spark: SparkSession, d: str) -> DataFrame:
    """Rows that went through JSON envelopes and CSV files, and those that a second run still has to do after chunks of 200 were written."""
    rows = table(spark, d, "unified_intents").select("row_id", "ma_intent", "description", (F.col("row_id") - 1).alias("_ord"))
    folder = work_folder(spark, "files")
    files.write_results(rows, f"{folder}/json", {"split": "all"})
    files.write_csv(rows, f"{folder}/csv", ["ma_intent", "description"])
    chunks = rows.select("ma_intent", "_ord").filter("_ord < 200")
    files.write_chunks(chunks, f"{folder}/chunks", "_ord")
    files.write_over(chunks.drop("_ord"), f"{folder}/done")
    files.write_over(chunks.drop("_ord").filter("ma_intent like '%1%'"), f"{folder}/done")
    back = files.read_results(spark, f"{folder}/json/*", rows.drop("_ord").schema)
    read = files.read_csv(spark, f"{folder}/csv", ["ma_intent", "description", "absent"])
    left = {"chunks": files.resume(rows, f"{folder}/chunks", "ma_intent"), "over": files.resume(rows, f"{folder}/done", "ma_intent"), "kept": files.resume(rows, f"{folder}/done.1", "ma_intent"), "nothing": files.resume(rows, f"{folder}/none", "ma_intent")}
    parts = [back.select(F.lit("json").alias("source"), "ma_intent", "description"), read.filter("absent is null").select(F.lit("csv").alias("source"), "ma_intent", "description")]
    parts += [df.select(F.lit(k).alias("source"), "ma_intent", F.lit("").alias("description")) for k, df in left.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("ma_intent").alias("ids"), F.sum(F.length(F.coalesce("description", F.lit("")))).alias("letters"))


NAMES = "gold_predictions ablation_stats product_brands quality_issues summary_scalars large_labels approved_only status_queues offset_page annotated_levels predictions slim_train prelabel_records bulk_update picked_names set_on_insert graph_texts hybrid_retrieval verified_calls label_prompts numeric_notes page_products page_questions page_links files_read".split()
QUERIES = {name: globals()[name] for name in NAMES}

_F, _S, _W = sql._F, sql._STRIP, sql._WORDS
_PRED = (
    "WITH p AS (SELECT * FROM (SELECT sample_id, intent_3_level AS i, row_number() OVER (PARTITION BY sample_id ORDER BY train_id DESC) AS rn FROM d1_annotator_train) WHERE rn = 1),"
    " j AS (SELECT gold_level_1 AS g1, gold_level_2 AS g2, gold_level_3 AS g3, coalesce(i.level_1, '') AS m1, coalesce(i.level_2, '') AS m2, coalesce(i.level_3, '') AS m3, gold_level_1 || '::' || gold_level_2 || '::' || gold_level_3 AS g,"
    " coalesce(i.level_1, '') || '::' || coalesce(i.level_2, '') || '::' || coalesce(i.level_3, '') AS m FROM d3_human_gold JOIN p USING (sample_id) WHERE coalesce(gold_level_1, '') <> '' AND coalesce(gold_level_2, '') <> '' AND coalesce(gold_level_3, '') <> '')"
)
_ISSUES = (
    f"WITH r AS ({_F}), c AS (SELECT *, count(*) OVER (PARTITION BY sentence) AS same FROM r LEFT JOIN (SELECT DISTINCT l3 AS k FROM intent_nodes WHERE node_level = 'l3') ON k = l3), i AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER ({w}) AS n FROM c" for n, w in (("invalid_slug", "qa_status = 'pending_new_label_invalid_slug'"), ("skipped_ambiguous", "qa_status = 'skipped_ambiguous'"), ("needs_review", "regexp_matches(coalesce(qa_status, ''), 'needs_review|pending')"), ("duplicates", "same > 1"), ("not_in_taxonomy", "l3 <> '' AND k IS NULL"), ("under_five_words", _W.format("sentence") + " < 5"), ("no_label", "l3 = ''")))
    + ") SELECT * FROM i UNION ALL SELECT 'total', sum(n) FROM i WHERE issue <> 'no_label'"
)
_SUMMARY = f"""
WITH r AS ({_F}), k AS (SELECT DISTINCT l3 FROM intent_nodes WHERE node_level = 'l3'), n AS (SELECT l3, count(*) AS n FROM r WHERE l3 <> '' GROUP BY 1), s AS (SELECT sentence, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS total_samples, count(*) FILTER (qa_status IN ('approved', 'approved_auto_new_label')) AS usable_approved, count(*) FILTER (regexp_matches(coalesce(qa_status, ''), 'needs_review|pending')) AS needs_human_review, count(*) FILTER (qa_status = 'skipped_ambiguous') AS skipped_ambiguous,
  count(*) FILTER (qa_status = 'pending_new_label_invalid_slug') AS invalid_slug, (SELECT sum(n) FROM s) AS exact_duplicates, count(DISTINCT l1) AS unique_l1, count(DISTINCT l2) AS unique_l2, (SELECT count(*) FROM n) AS unique_l3_in_data, (SELECT count(*) FROM k) AS unique_l3_in_taxonomy,
  (SELECT count(*) FROM n WHERE l3 IN (FROM k)) AS l3_covered, (SELECT count(*) FROM k WHERE l3 NOT IN (SELECT l3 FROM n)) AS l3_missing_coverage, (SELECT count(*) FROM n WHERE l3 NOT IN (FROM k)) AS l3_oov_in_data, (SELECT count(*) FROM n WHERE n >= 30) AS intents_sufficient, (SELECT count(*) FROM n WHERE n < 30) AS intents_need_augment,
  (SELECT sum(greatest(0, 30 - n)) FROM n) AS total_gap_to_fill, round(avg({_W.format("sentence")}), 2) AS avg_word_count, round(avg(length(sentence)), 2) AS avg_char_count, count(*) FILTER (l1 = 'truoc_mua_hang') AS l1_before_sale, count(*) FILTER (l1 = 'sau_mua_hang') AS l1_after_sale,
  (SELECT round(max(n) / min(n)::DOUBLE, 2) FROM n) AS imbalance_ratio FROM r"""
_BARE = "WITH a AS (SELECT row_id, " + _S.format("string_split(product_name_raw, chr(10))[1]") + " AS n FROM crawl_hasaki)" + "".join(
    f", {b} AS (SELECT row_id, {_S.format(f'regexp_replace(n, {chr(39)}{p}{chr(39)}, {chr(39) * 2})')} AS n FROM {a})" for a, b, p in zip("abcefg", "bcefgh", rules.AROUND_NAME)
)
_TITLE = "list_aggregate(list_transform(regexp_extract_all(lower(replace({0}, '_', ' ')), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')"
_PAGE = r"trim(regexp_replace(coalesce({}, ''), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
_VECTOR = "SELECT {0}, h % 64 AS k, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {0}, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (SELECT {0}, unnest(list_filter(regexp_split_to_array(lower({1}), '{2}+'), lambda w: w <> '')) AS w FROM {3})) GROUP BY ALL"


def _hybrid() -> str:
    from annolake.plans.graph import _KEYWORDS

    gap = sql._GAP.replace("{{", "{").replace("}}", "}")
    return (
        _KEYWORDS.replace("@pool", "24")
        + ", asked AS (SELECT row_id AS id, question AS text FROM crawl_hasaki WHERE row_id % 100 = 0), labels AS (SELECT node_id AS id, concat_ws(' ', name, description, l3) AS text FROM intent_nodes WHERE node_level = 'l3'), "
        + f"qv AS ({_VECTOR.format('id', 'text', gap, 'asked')}), nv AS ({_VECTOR.format('id', 'text', gap, 'labels')}), "
        + "ql AS (SELECT id, sqrt(sum(v * v)) AS l FROM qv GROUP BY 1 HAVING sum(v * v) > 0), nl AS (SELECT id, sqrt(sum(v * v)) AS l FROM nv GROUP BY 1 HAVING sum(v * v) > 0), "
        + "sim AS (SELECT qv.id AS query_id, nv.id AS node_id, round(sum(qv.v * nv.v) / any_value(ql.l) / any_value(nl.l), 9) AS s FROM qv JOIN nv ON qv.k = nv.k JOIN ql ON ql.id = qv.id JOIN nl ON nl.id = nv.id GROUP BY 1, 2), "
        + "near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id DESC) AS rank FROM sim WHERE s >= 0.3), "
        + "a AS (SELECT query_id, node_id, 0 AS s, rank FROM kw WHERE rank <= 6 UNION ALL SELECT query_id, node_id, 1, rank FROM near WHERE rank <= 4), o AS (SELECT query_id, node_id, min(s * 1000 + rank) AS place FROM a GROUP BY 1, 2) "
        + "SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY place, node_id) AS rank FROM o) WHERE rank <= 10"
    )


ORACLES = {
    "gold_predictions": _PRED + f", {sql._LEVELS}, lab AS (SELECT level, t AS label FROM p1 UNION SELECT level, p FROM p1), f AS (SELECT lab.level, label, count(*) FILTER (t = label) AS s, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS pr FROM lab JOIN p1 ON p1.level = lab.level GROUP BY ALL) SELECT level, sum(s) AS n, round(sum(tp) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(2.0 * tp / (s + pr)), 6) AS macro_f1, round(sum(2.0 * tp / (s + pr) * s) / sum(s), 6) AS weighted_f1 FROM f GROUP BY level".replace(", p AS (", ", p1 AS ("),
    "ablation_stats": "WITH r AS (SELECT split AS configuration, gold_id % 3 AS seed, avg((gold_level_1 = coalesce(machine_level_1, ''))::INT::DOUBLE) AS l1, avg((gold_level_2 = coalesce(machine_level_2, ''))::INT::DOUBLE) AS l2 FROM d3_human_gold WHERE coalesce(gold_level_1, '') <> '' GROUP BY 1, 2) SELECT configuration, 'machine' AS method, count(*) AS runs, round(avg(l1), 6) AS l1_mean, round(stddev_samp(l1), 6) AS l1_deviation, round(avg(l2), 6) AS l2_mean, round(stddev_samp(l2), 6) AS l2_deviation FROM r GROUP BY 1",
    "product_brands": _BARE + ", m AS (SELECT row_id, max(length(brand_name) * 1000000 + brand_no) AS top FROM h JOIN (SELECT brand_name, row_number() OVER (ORDER BY brand_name) AS brand_no FROM brand_list WHERE brand_name <> '') ON starts_with(n, brand_name) GROUP BY 1), y AS (SELECT h.row_id, n, coalesce(brand_name, regexp_extract(n, '^((?:[A-Z][a-z]+){2,})', 1), '') AS brand FROM h LEFT JOIN m USING (row_id) LEFT JOIN (SELECT brand_name, row_number() OVER (ORDER BY brand_name) AS brand_no FROM brand_list WHERE brand_name <> '') x ON x.brand_no = top % 1000000)"
    + f" SELECT row_id, brand, regexp_replace(CASE WHEN brand = '' THEN n ELSE {_S.format('n[length(brand) + 1:]')} END, '(\\d+(?:ml|g|L))[A-Z][a-z].*$', '\\1') AS product_name FROM y",
    "quality_issues": _ISSUES,
    "summary_scalars": _SUMMARY,
    "large_labels": " UNION ALL ".join(f"SELECT * FROM (SELECT 'l{k}' AS level, l{k} AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM ({_F}) GROUP BY 2) WHERE percent > 8 AND label <> ''" for k in (1, 2, 3)),
    "approved_only": "SELECT 'clean' AS from_set, row_id FROM hasaki_labelled_clean WHERE qa_status = 'approved' UNION ALL SELECT 'bare', row_id FROM hasaki_labelled_clean",
    "status_queues": "SELECT 'review' AS queue, count(*) AS n FROM hasaki_labelled_full WHERE qa_status IN ('needs_review', 'pending_new_label_review') UNION ALL SELECT 'usable', count(*) FROM hasaki_labelled_full WHERE qa_status IN ('approved', 'approved_auto_new_label')",
    "offset_page": "SELECT row_id, ma_intent FROM unified_intents ORDER BY row_id LIMIT 10 OFFSET 20",
    "annotated_levels": "SELECT row_id, coalesce(nullif(n.level_1, ''), b.level_1, '') AS l1, coalesce(nullif(n.level_2, ''), b.level_2, '') AS l2, coalesce(n.level_3, b.level_3, '') AS l3 FROM (SELECT row_id, intent_3_level AS n, intent_3_level_before_reverify AS b FROM hasaki_labelled_full_verified)",
    "predictions": "SELECT row_id, coalesce(intent_3_level.level_1, '') AS L1, coalesce(intent_3_level.level_2, '') AS L2, coalesce(intent_3_level.level_3, '') AS L3, coalesce(confidence, 0) AS confidence, coalesce(reasoning, '') AS reasoning, false AS is_new_label FROM hasaki_labelled_full",
    "slim_train": "SELECT sample_id, coalesce(sentence, '') AS sentence, coalesce(category, '') AS category, l1 || '::' || l2 || '::' || l3 AS label, confidence, qa_status, 'annotator' AS label_source FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row_id DESC) AS rn FROM (" + _F + ") WHERE coalesce(sample_id, '') <> '') WHERE rn = 1",
    "prelabel_records": f"SELECT row_id, coalesce(product_id, '') AS product_id, {_S.format(chr(99) + 'oalesce(question, ' + chr(39) * 2 + ')')} AS sentence, nullif(image_url, '') AS image_url, 0 AS spans, '' AS intent, 'text' AS modality, false AS cross_modal_ref, NULL::VARCHAR AS difficulty, 'crawl' AS source FROM crawl_hasaki",
    "bulk_update": f"WITH r AS (SELECT row_id, coalesce(l1_category, '') AS old, {_S.format(chr(99) + 'oalesce(l1_category, ' + chr(39) * 2 + ')')} AS t FROM unified_intents), m AS (SELECT *, CASE replace(lower(t), ' ', '_') WHEN 'truoc_ban' THEN 'truoc_mua_hang' WHEN 'truoc_mua_hang' THEN 'truoc_mua_hang' WHEN 'trước_bán' THEN 'truoc_mua_hang' WHEN 'sau_ban' THEN 'sau_mua_hang' WHEN 'sau_mua_hang' THEN 'sau_mua_hang' ELSE t END AS l1 FROM r) SELECT row_id, old, l1, old <> l1 AS changed FROM m",
    "picked_names": f"WITH r AS (SELECT row_id, coalesce(l2_intent, '') AS l2, coalesce(l3_specific_intent, '') AS l3, {_S.format(chr(99) + 'oalesce(intent_name, ' + chr(39) * 2 + ')')} AS n FROM unified_intents) SELECT row_id, CASE WHEN n <> '' AND n <> l3 AND n <> l2 THEN n WHEN {_S.format('l3')} <> '' THEN {_TITLE.format(_S.format('l3'))} WHEN n <> '' THEN n ELSE 'Intent' END AS name FROM r",
    "set_on_insert": "SELECT user_id, event_id, first_type AS event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type FROM events) WHERE rn = 1",
    "graph_texts": "WITH n AS (SELECT ma_intent AS id, coalesce(l1_category, '') AS l1, coalesce(l2_intent, '') AS l2, coalesce(l3_specific_intent, '') AS l3, coalesce(description, '') AS d, coalesce(detection_signals, '') AS s, coalesce(examples, '') AS e FROM unified_intents), x AS (SELECT a.id, b.l3, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rn FROM n a JOIN n b ON a.l2 = b.l2 AND a.id <> b.id), g AS (SELECT id, string_agg(l3, ', ' ORDER BY other) AS sib FROM x WHERE rn <= 5 AND l3 <> '' GROUP BY id)"
    " SELECT n.id, 'Intent: ' || l1 || '.' || l2 || '.' || l3 || '.' || chr(10) || 'Parent: ' || l2 || '.' || chr(10) || 'Siblings: ' || coalesce(sib, 'None') || '.' || chr(10) || 'Description: ' || d || chr(10) || 'Signals: ' || s || chr(10) || 'Example: ' || e AS text FROM n LEFT JOIN g ON g.id = n.id",
    "hybrid_retrieval": _hybrid(),
    "verified_calls": "SELECT row_id, CASE WHEN length(sentence) % 7 <> 0 AND length(sentence) % 3 = 0 THEN 'REVISE' ELSE 'RETAIN' END AS decision, coalesce(length(sentence) % 7 = 0, false) AS failed FROM hasaki_labelled_full",
    "label_prompts": "WITH n AS (SELECT l2, l3, row_number() OVER (PARTITION BY l2 ORDER BY l3) AS k FROM (SELECT DISTINCT l2, l3 FROM intent_nodes WHERE node_level = 'l3' AND l2 IS NOT NULL)) SELECT l2, 'Choose one:' || chr(10) || l2 || chr(10) || string_agg(k || '. ' || l3, chr(10) ORDER BY k) AS prompt FROM n GROUP BY l2",
    "numeric_notes": f"SELECT count(x) AS numbers, count(*) FILTER (x IS NULL) AS others, round(avg(x), 6) AS mean FROM (SELECT TRY_CAST({_S.format('confidence_level')} AS DOUBLE) AS x FROM unified_intents)",
    "page_products": f"WITH r AS (SELECT row_id, image_url, {_PAGE.format('brand')} AS b, {_PAGE.format('question')} AS q, {_PAGE.format('repeat(coalesce(question, ' + chr(39) * 2 + '), 20)')} AS t FROM crawl_hasaki) SELECT row_id, row_id || ' VND' AS price, b AS brand, CASE WHEN length(t) > 20 THEN least(length(t), 1000) ELSE 0 END AS described, CASE WHEN image_url = 'x.png' THEN 'x.png' ELSE coalesce(image_url, 'none') || ' x.png' END AS images, CASE WHEN length(q) BETWEEN 11 AND 999 THEN q ELSE '' END AS questions FROM r",
    "page_questions": f"SELECT row_id, u AS user, q AS question FROM (SELECT row_id, {_PAGE.format('user_name')} AS u, {_PAGE.format('question')} AS q FROM crawl_hasaki WHERE product_id IS NOT NULL) WHERE length(q) > 2 AND u <> ''",
    "page_links": r"WITH p AS (SELECT row_id // 50 AS page, product_url AS link FROM crawl_hasaki WHERE product_url IS NOT NULL AND product_url <> '' AND NOT regexp_matches(product_url, '[\x22''#]')), f AS (SELECT link, min(page) AS page FROM p GROUP BY 1), e AS (SELECT coalesce(min(page), 1152921504606846976) AS e FROM p WHERE page NOT IN (SELECT page FROM f)) SELECT link, page, CASE WHEN regexp_extract(link, '/san-pham/([^/?#]+?)(?:\.html)?(?:[?#]|$)', 1) <> '' THEN regexp_extract(link, '/san-pham/([^/?#]+?)(?:\.html)?(?:[?#]|$)', 1) ELSE replace(regexp_extract(link, '([^/]*)/?$', 1), '.html', '') END AS product_id FROM f WHERE page < (SELECT e FROM e)",
    "files_read": "WITH r AS (SELECT ma_intent, coalesce(length(description), 0) AS n, row_id - 1 AS o FROM unified_intents) SELECT * FROM (SELECT 'json' AS source, count(*) AS n, count(DISTINCT ma_intent) AS ids, sum(n) AS letters FROM r UNION ALL SELECT 'csv', count(*), count(DISTINCT ma_intent), sum(n) FROM r UNION ALL SELECT 'nothing', count(*), count(DISTINCT ma_intent), 0 FROM r"
    " UNION ALL SELECT 'chunks', count(*), count(DISTINCT ma_intent), 0 FROM r WHERE o >= 200 UNION ALL SELECT 'kept', count(*), count(DISTINCT ma_intent), 0 FROM r WHERE o >= 200 UNION ALL SELECT 'over', count(*), count(DISTINCT ma_intent), 0 FROM r WHERE NOT (o < 200 AND ma_intent LIKE '%1%')) WHERE n > 0",
}
