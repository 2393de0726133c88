"""Taxonomy, retrieval, event and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import labels as L
from annolake.functions import rules, vectors
from annolake.operators import annotate, curate, metrics, retrieval, taxonomy
from annolake.sources.tables import table


def _intents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "unified_intents")
    return rows.select(F.col("ma_intent").alias("id"), F.col("row_id").alias("ord"), F.col("intent_name").alias("name"), F.col("l1_category").alias("l1"), F.col("l2_intent").alias("l2"), F.col("l3_specific_intent").alias("l3"), "description", "examples", "domain")


def taxonomy_merge(spark, d):
    return taxonomy.merge_triples(_intents(spark, d), ["description", "examples"])


def id_migration(spark, d):
    """Each old id with the id of its triple."""
    merged = taxonomy_merge(spark, d).select("l1", "l2", "l3", "primary_id", "new_id")
    return _intents(spark, d).join(merged, ["l1", "l2", "l3"]).select(F.col("id").alias("old_id"), "new_id", (F.col("id") != F.col("primary_id")).alias("merged"))


def graph_nodes(spark, d):
    return taxonomy.graph(_intents(spark, d).withColumn("domain", F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("My pham"))))[0]


def graph_edges(spark, d):
    return taxonomy.graph(_intents(spark, d).withColumn("domain", F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit("My pham"))))[1]


def sibling_texts(spark, d):
    """A text for each label that names its parent and up to five siblings."""
    nodes = table(spark, d, "intent_nodes").filter("node_level = 'l3'").select(F.col("node_id").alias("id"), "name", "l1", "l2", "l3")
    own = taxonomy.siblings(nodes, 5)
    listed = F.when(F.size("siblings") > 0, F.array_join("siblings", ", ")).otherwise("None")
    return own.select("id", F.concat(F.lit("Intent: "), F.concat_ws(" > ", "l1", "l2", "l3"), F.lit(". Parent: "), "l2", F.lit(". Siblings: "), listed, F.lit(".")).alias("text"))


def canonical_labels(spark, d):
    """Labels whose normal form is a known name, with the known one, and whether all three levels are known."""
    nodes, rows = table(spark, d, "intent_nodes"), table(spark, d, "hasaki_labelled_full")
    out = rows.select("row_id", *(F.col(f"intent_3_level.level_{k}").alias(f"l{k}") for k in (1, 2, 3)))
    for k in (1, 2, 3):
        known = nodes.filter(F.col("node_level") == f"l{k}").select(F.col(f"l{k}").alias("name"))
        names = taxonomy.canonical_names(known, "name", L.normal_label(F.col("name"))).withColumnsRenamed({"key": f"k{k}", "canonical": f"c{k}"})
        out = out.withColumn(f"k{k}", L.normal_label(F.col(f"l{k}"))).join(names, f"k{k}", "left")
    known = F.col("c1").isNotNull() & F.col("c2").isNotNull() & F.col("c3").isNotNull()
    return out.select("row_id", *(F.coalesce(f"c{k}", f"l{k}").alias(f"l{k}") for k in (1, 2, 3)), known.alias("allowed"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def semantic_topk(spark, d):
    """For every vector whose id is divisible by 100: the ten most similar others of a similarity of 0.1 or more."""
    rows = _vectors(spark, d)
    return retrieval.top_similar(rows.filter("id % 100 = 0"), rows, 10, 0.1).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def nearest_snap(spark, d):
    """The nearest other vector of each query, if it is similar enough."""
    rows = _vectors(spark, d)
    return retrieval.top_similar(rows.filter("id % 100 = 0"), rows, 1, 0.2).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def vector_recall(spark, d):
    """How well nearness finds vectors of the query's own label: recall and mean reciprocal rank."""
    rows = _vectors(spark, d)
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ranked = retrieval.top_similar(rows.filter("id % 100 = 0"), rows, 10).select(F.col("query_id").alias("query"), "id", "rank")
    queries = kinds.filter("id % 100 = 0").select(F.col("id").alias("query"), "label")
    relevant = queries.join(kinds, "label").filter("query <> id").select("query", "id")
    return metrics.recall_at(ranked, relevant, [1, 5, 10])


def vector_norms(spark, d):
    """Length of each vector, and its cosine with the first one of its label."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    first = curate.one_per_key(rows, ["label"], F.col("vec_id")).select("label", F.col("embedding").alias("other"))
    return rows.join(first, "label").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def relabelled(spark, d):
    """Verified labels, with those from before where a level is blank, and whether they changed."""
    rows = table(spark, d, "hasaki_labelled_full_verified")
    now, before = ([F.col(f"{c}.level_{k}") for k in (1, 2, 3)] for c in ("intent_3_level", "intent_3_level_before_reverify"))
    chosen = L.prefer(now, before)
    return rows.select("row_id", L.path(*chosen).alias("label"), (L.path(*chosen) != L.path(*before)).alias("changed"))


def node_vectors(spark, d):
    """How many labels of each level have a vector, by the encoder without weights."""
    nodes = table(spark, d, "intent_nodes").select("node_level", F.concat_ws(" ", "name", "description").alias("text"))
    made = annotate.encode(nodes, "text", "vector", annotate.hashed_words())
    return made.groupBy("node_level").agg(F.count("vector").alias("n"), F.min(F.size("vector")).cast("bigint").alias("size"))


def _keywords(spark: SparkSession, d: str, k: int) -> DataFrame:
    nodes = table(spark, d, "intent_nodes").filter("node_level = 'l3'")
    texts = nodes.select("node_id", F.concat_ws(" ", "name", "description", "l3").alias("text"), F.col("domain").alias("category"), L.path(F.col("l1"), F.col("l2"), F.col("l3")).alias("key"))
    asked = table(spark, d, "crawl_hasaki").filter("row_id % 100 = 0").select(F.col("row_id").alias("id"), F.col("question").alias("text"), F.col("category_name").alias("category"))
    return retrieval.top_keywords(asked, texts, k)


def keyword_retrieval(spark, d):
    """For every question whose id is divisible by 100: the ten labels whose texts hold most of its words."""
    return _keywords(spark, d, 10).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def union_retrieval(spark, d):
    """Two rankings as one, the first source first: labels by words, then those most used for the questions of the product."""
    asked = table(spark, d, "crawl_hasaki").filter("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "product_id").filter("product_id is not null")
    used = table(spark, d, "hasaki_labelled_full").select("product_id", F.concat(F.lit("l3:"), "intent_3_level.level_3").alias("node_id")).filter("node_id is not null and product_id is not null").groupBy("product_id", "node_id").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    best = used.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("n"), "node_id"))).filter("rank <= 4")
    second = asked.join(best, "product_id").select("query_id", "node_id", "rank")
    return retrieval.union_ranked([_keywords(spark, d, 6), second], 8).select("query_id", "node_id", F.col("rank").cast("bigint").alias("rank"))


def resume_antijoin(spark, d):
    """Events that are still to do, where those of type click are done."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    return rows.join(rows.filter("event_type = 'click'").select("event_id"), "event_id", "left_anti")


def upsert_latest(spark, d):
    """The newest event of each user, where purchases are written over the rest."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return curate.upsert(rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'"), "user_id", "event_id")


def parsed_props(spark, d):
    """The number in each event's JSON."""
    return table(spark, d, "events").select("event_id", rules.json_in(F.col("props"), "k bigint")["k"].alias("k"))


NAMES = "taxonomy_merge id_migration graph_nodes graph_edges sibling_texts canonical_labels semantic_topk nearest_snap vector_recall vector_norms relabelled node_vectors keyword_retrieval union_retrieval resume_antijoin upsert_latest parsed_props".split()
QUERIES = {name: globals()[name] for name in NAMES}

_I = "SELECT ma_intent AS id, row_id AS ord, intent_name AS name, l1_category AS l1, l2_intent AS l2, l3_specific_intent AS l3, description, examples, coalesce(nullif(trim(domain), ''), 'My pham') AS domain FROM unified_intents"
_MERGE = rf"""
WITH i AS (SELECT *, coalesce(TRY_CAST(regexp_extract(id, '^INT-(\d{{1,18}})$', 1) AS BIGINT), 1000000000) AS num FROM ({_I}) WHERE coalesce(l1, '') <> '' AND coalesce(l2, '') <> '' AND coalesce(l3, '') <> ''),
o AS (SELECT *, CASE WHEN num < 1000000000 THEN 0 WHEN starts_with(id, 'AUTO-') THEN 1 ELSE 2 END AS kind FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY kind, num, ord) AS rn FROM o),
e AS (SELECT l1, l2, l3, rn, f, regexp_replace(coalesce(v, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS v FROM (SELECT l1, l2, l3, rn, unnest(['d', 'e']) AS f, unnest([description, examples]) AS v FROM r)),
u AS (SELECT l1, l2, l3, f, v, min(rn) AS place FROM e WHERE v <> '' GROUP BY ALL),
t AS (SELECT l1, l2, l3, f, substr(string_agg(v, ' | ' ORDER BY place), 1, 2000) AS v FROM u GROUP BY l1, l2, l3, f),
m AS (SELECT l1, l2, l3, count(*) AS members, max(id) FILTER (rn = 1) AS primary_id, max(num) FILTER (rn = 1) AS num, max(name) FILTER (rn = 1) AS name FROM r GROUP BY l1, l2, l3),
n AS (SELECT l1, l2, l3, row_number() OVER (ORDER BY l1, l2, l3) AS k FROM m WHERE num = 1000000000),
f AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT unnest(range(133, 133 + 2 * (SELECT count(*) FROM unified_intents) + 2)) AS x) WHERE x NOT IN (SELECT num FROM i)),
g AS (SELECT l1, l2, l3, 'INT-' || x AS given FROM n JOIN f USING (k)),
merged AS (SELECT m.l1, m.l2, m.l3, members, primary_id, coalesce(given, primary_id) AS new_id, name, coalesce(a.v, '') AS description, coalesce(b.v, '') AS examples
  FROM m LEFT JOIN g ON (m.l1, m.l2, m.l3) = (g.l1, g.l2, g.l3) LEFT JOIN t a ON (m.l1, m.l2, m.l3) = (a.l1, a.l2, a.l3) AND a.f = 'd' LEFT JOIN t b ON (m.l1, m.l2, m.l3) = (b.l1, b.l2, b.l3) AND b.f = 'e')
"""
_PATH = f"WITH i AS ({_I}), p AS (SELECT ['root', 'domain:' || domain, 'l1:' || l1, 'l2:' || l2, 'l3:' || l3, 'intent:' || id] AS ids, ['root', domain, l1, l2, l3, id] AS names FROM i)"
_SIMILAR = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT q.id AS query_id, v.id, q.label AS ql, v.label AS vl, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q JOIN v ON q.id % 100 = 0 AND q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s WHERE s >= {})"
_NORMAL = r"lower(regexp_replace(regexp_replace(nfc_normalize({}), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"
_KEYWORDS = r"""
WITH n AS (SELECT node_id, lower(concat_ws(' ', name, description, l3)) AS blob, lower(coalesce(domain, '')) AS place, l1 || '::' || l2 || '::' || l3 AS key FROM intent_nodes WHERE node_level = 'l3'),
q AS (SELECT row_id AS query_id, product_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[\p{{L}}\p{{N}}_]+')), lambda w: length(w) >= 2) AS w,
  list_filter(regexp_extract_all(lower(coalesce(category_name, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3) AS c FROM crawl_hasaki WHERE row_id % 100 = 0),
s AS (SELECT query_id, node_id, key, len(list_filter(w, lambda x: contains(blob, x))) AS hits, len(list_filter(c, lambda x: contains(place, x))) AS places FROM q, n),
d AS (SELECT *, hits + CASE WHEN places > 0 THEN 0.2::DOUBLE ELSE 0 END AS score FROM s WHERE hits > 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, node_id) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS pr FROM d) WHERE pr <= @pool) WHERE rk = 1),
kw AS (SELECT query_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM k)
""".replace("{{", "{").replace("}}", "}")

ORACLES = {
    "taxonomy_merge": _MERGE + "SELECT * FROM merged",
    "id_migration": _MERGE + "SELECT i.id AS old_id, new_id, i.id <> primary_id AS merged FROM i JOIN merged ON (i.l1, i.l2, i.l3) = (merged.l1, merged.l2, merged.l3)",
    "graph_nodes": _PATH + " SELECT DISTINCT unnest(ids) AS node_id, unnest(['root', 'domain', 'l1', 'l2', 'l3', 'intent']) AS level, unnest(names) AS name FROM p",
    "graph_edges": _PATH + " SELECT DISTINCT unnest(ids[1:5]) AS source, unnest(ids[2:6]) AS target FROM p",
    "sibling_texts": "WITH n AS (SELECT node_id AS id, l1, l2, l3 FROM intent_nodes WHERE node_level = 'l3'), s AS (SELECT a.id, b.l3, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rn, b.id AS other FROM n a JOIN n b ON a.l2 = b.l2 AND a.id <> b.id), g AS (SELECT id, string_agg(l3, ', ' ORDER BY other) AS sib FROM s WHERE rn <= 5 AND coalesce(l3, '') <> '' GROUP BY id) SELECT n.id, 'Intent: ' || l1 || ' > ' || l2 || ' > ' || l3 || '. Parent: ' || l2 || '. Siblings: ' || coalesce(sib, 'None') || '.' AS text FROM n LEFT JOIN g ON g.id = n.id",
    "canonical_labels": "WITH "
    + ", ".join(f"c{k} AS (SELECT {_NORMAL.format(f'l{k}')} AS key, min(l{k}) AS name FROM intent_nodes WHERE node_level = 'l{k}' GROUP BY 1)" for k in (1, 2, 3))
    + ", r AS (SELECT row_id, intent_3_level.level_1 AS l1, intent_3_level.level_2 AS l2, intent_3_level.level_3 AS l3 FROM hasaki_labelled_full) SELECT row_id, coalesce(c1.name, l1) AS l1, coalesce(c2.name, l2) AS l2, coalesce(c3.name, l3) AS l3, c1.name IS NOT NULL AND c2.name IS NOT NULL AND c3.name IS NOT NULL AS allowed FROM r "
    + " ".join(f"LEFT JOIN c{k} ON c{k}.key = {_NORMAL.format(f'l{k}')}" for k in (1, 2, 3)),
    "semantic_topk": _SIMILAR.format("0.1") + " SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10",
    "nearest_snap": _SIMILAR.format("0.2") + " SELECT query_id, id, round(s, 6) AS similarity FROM r WHERE rank = 1",
    "vector_recall": _SIMILAR.format("-1") + ", h AS (SELECT query_id, count(*) AS a, min(rank) AS f, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, " + ", ".join(f"coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in (1, 5, 10)) + " FROM r WHERE ql = vl GROUP BY 1) " + " UNION ALL ".join(f"SELECT {k} AS k, round(avg(h{k} / a::DOUBLE), 6) AS recall, round(avg(CASE WHEN f <= {k} THEN 1.0::DOUBLE / f ELSE 0 END), 6) AS mrr, round(avg(g{k} / list_sum(list_transform(range(1, least(a, {k}) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM h" for k in (1, 5, 10)),
    "vector_norms": "WITH f AS (SELECT label, embedding::DOUBLE[] AS o FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1) SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], o), 6) AS cosine FROM embeddings JOIN f USING (label)",
    "relabelled": "WITH r AS (SELECT row_id, "
    + ", ".join(f"coalesce(nullif(intent_3_level.level_{k}, ''), intent_3_level_before_reverify.level_{k}, '') AS n{k}, coalesce(intent_3_level_before_reverify.level_{k}, '') AS b{k}" for k in (1, 2, 3))
    + " FROM hasaki_labelled_full_verified) SELECT row_id, n1 || '::' || n2 || '::' || n3 AS label, n1 || '::' || n2 || '::' || n3 <> b1 || '::' || b2 || '::' || b3 AS changed FROM r",
    "node_vectors": "SELECT node_level, count(*) AS n, 64 AS size FROM intent_nodes GROUP BY 1",
    "keyword_retrieval": _KEYWORDS.replace("@pool", "40") + "SELECT * FROM kw WHERE rank <= 10",
    "union_retrieval": _KEYWORDS.replace("@pool", "24") + """, u AS (SELECT product_id, 'l3:' || intent_3_level.level_3 AS node_id, count(*) AS n FROM hasaki_labelled_full WHERE intent_3_level.level_3 IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, node_id) AS rank FROM u),
      a AS (SELECT query_id, node_id, 0 AS s, rank FROM kw WHERE rank <= 6 UNION ALL SELECT query_id, node_id, 1, rank FROM q JOIN b ON q.product_id = b.product_id WHERE rank <= 4),
      o AS (SELECT query_id, node_id, min(s * 1000 + rank) AS place FROM a GROUP BY 1, 2) SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY place, node_id) AS rank FROM o) WHERE rank <= 8""",
    "resume_antijoin": "SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')",
    "upsert_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "parsed_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
