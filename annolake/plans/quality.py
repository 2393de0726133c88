"""Queries of problems 1 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.text import blank, strip
from annolake.operators.compare import diff, hashed, latest
from annolake.operators.packed import explode_packed
from annolake.sources.tables import spread, table

#: Field -> whether a bare comma parts its values: signals are words or short phrases, the others whole sentences.
PACKED = {"detection_signals": True, "examples": False, "description": False}
COMPARED = ("sentence", "category", "level_1", "level_2", "level_3", "confidence", "qa_status")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(spread(table(spark, d, "unified_intents").select("row_id", *PACKED)), "row_id", PACKED)


COPIES = ("hasaki_labelled_clean", "hasaki_labelled_full_verified")


def _fields() -> dict:
    """What is compared of a row; null equals blank in text."""
    text = {f.split(".")[-1]: F.when(~blank(F.col(f)), F.col(f)) for f in ("sentence", "category", *(f"intent_3_level.level_{k}" for k in (1, 2, 3)), "qa_status")}
    return text | {"confidence": F.when(F.col("confidence").isNotNull(), F.format_string("%.4f", F.round("confidence", 4)))}


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Findings, by hashes of the fields, with the rows that they were found in."""
    fields = {f: hashed(c) for f, c in _fields().items()} | {"row_id": F.col("row_id")}
    clean, verified = (latest(table(spark, d, t), F.lower(strip(F.col("sample_id"))), fields, ("updated_at", "row_id")) for t in COPIES)
    return diff(clean, verified, COMPARED, ("clean", "verified"), "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d).select(F.col("key").alias("sample_id"), "finding")


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells that differ, with both values; only rows that differ are looked up."""
    found = _sides(spark, d).filter(~F.col("finding").startswith("missing_in_")).select(F.col("key").alias("sample_id"), "finding", "left_row_id", "right_row_id")
    for side, t in zip(("left", "right"), COPIES):
        cells = F.map_from_arrays(F.array(*(F.lit(f) for f in _fields())), F.array(*_fields().values())).alias("cells")
        rows = table(spark, d, t).select(F.col("row_id").alias(f"{side}_row_id"), cells)
        found = found.join(rows, f"{side}_row_id").withColumn(f"{side}_value", F.element_at("cells", F.col("finding"))).drop("cells")
    return found.select("sample_id", "finding", F.col("left_value").alias("in_clean"), F.col("right_value").alias("in_verified"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d).groupBy("finding").agg(F.count("*").alias("n"), F.count("left_value").alias("in_clean"), F.count("right_value").alias("in_verified"))


_DIFF = """
WITH side AS (
  SELECT 'c' AS s, row_id, sample_id, sentence, category, intent_3_level, confidence, qa_status, updated_at FROM hasaki_labelled_clean
  UNION ALL SELECT 'v', row_id, sample_id, sentence, category, intent_3_level, confidence, qa_status, updated_at FROM hasaki_labelled_full_verified),
ranked AS (
  SELECT s, lower(regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g')) AS k, *,
    row_number() OVER (PARTITION BY s, lower(regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g')) ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS rn
  FROM side),
one AS (
  SELECT s, k, unnest([
    {'f': 'sentence', 'v': sentence}, {'f': 'category', 'v': category}, {'f': 'qa_status', 'v': qa_status},
    {'f': 'level_1', 'v': intent_3_level.level_1}, {'f': 'level_2', 'v': intent_3_level.level_2}, {'f': 'level_3', 'v': intent_3_level.level_3},
    {'f': 'confidence', 'v': CAST(CAST(round(confidence * 10000) AS BIGINT) AS VARCHAR)}]) AS x
  FROM ranked WHERE rn = 1 AND coalesce(k, '') <> ''),
cells AS (SELECT s, k, x.f AS f, CASE WHEN x.f <> 'confidence' AND trim(coalesce(x.v, '')) = '' THEN NULL ELSE x.v END AS v FROM one),
found AS (
  SELECT coalesce(a.k, b.k) AS sample_id,
    CASE WHEN b.k IS NULL THEN 'missing_in_verified' WHEN a.k IS NULL THEN 'missing_in_clean' ELSE a.f END AS finding, a.v AS va, b.v AS vb
  FROM (FROM cells WHERE s = 'c') a FULL JOIN (FROM cells WHERE s = 'v') b ON a.k = b.k AND a.f = b.f
  WHERE a.k IS NULL AND b.f = 'sentence' OR b.k IS NULL AND a.f = 'sentence' OR a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v)
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_cells": p3_cells, "p3_report": p3_report}
ORACLES = {
    "p3_found": _DIFF + "SELECT sample_id, finding FROM found",
    "p3_cells": _DIFF + "SELECT sample_id, finding, CASE WHEN finding = 'confidence' THEN printf('%.4f', va::DOUBLE / 10000) ELSE va END AS in_clean, CASE WHEN finding = 'confidence' THEN printf('%.4f', vb::DOUBLE / 10000) ELSE vb END AS in_verified FROM found WHERE finding NOT LIKE 'missing%'",
    "p3_report": _DIFF
    + """SELECT finding, count(*) AS n,
      count(*) FILTER (WHERE finding NOT LIKE 'missing%' AND va IS NOT NULL) AS in_clean, count(*) FILTER (WHERE finding NOT LIKE 'missing%' AND vb IS NOT NULL) AS in_verified
      FROM found GROUP BY finding""",
}
