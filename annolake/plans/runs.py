"""Queries that run a stream or a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.text import level
from annolake.operators import metrics
from annolake.plans.models import fit_svm, predict
from annolake.session import work_folder
from annolake.sources.tables import table
from annolake.streaming.ingest import file_stream, latest_version, upsert_stream, windowed_counts

#: Labelled rows that the model is fitted on; the bound on the sample.
FITTED = 5_000


def streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, read as a stream and written as upserts."""
    events = table(spark, d, "events")
    folder = work_folder(spark, "ingest")
    stream = file_stream(spark, f"{d}/events.parquet*", events.schema)
    upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint", "user_id", "event_id").awaitTermination()
    return latest_version(spark, f"{folder}/table").select("user_id", "event_id", "event_type", "value")


def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, by the function that streams use too. An extension: the data flow it stands for knows no windows."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


def tfidf_svm(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and F1 of level 1 and its prediction, fitted on verified rows and judged on others."""
    rows = table(spark, d, "hasaki_labelled_clean").select("row_id", "sentence", level("intent_3_level", 1).alias("l1")).filter("l1 rlike '^[a-z_]+$' and sentence is not null")
    known = table(spark, d, "intent_nodes").filter("node_level = 'l1'").select(F.col("l1").alias("k")).distinct()
    rows = rows.join(known, F.col("l1") == F.col("k"), "left_semi")
    train = rows.filter("row_id % 5 <> 0").orderBy(F.xxhash64("row_id")).limit(FITTED)
    judged = predict(fit_svm(train, "sentence", "l1"), rows.filter("row_id % 5 = 0"))
    return metrics.hierarchical(judged, {"l1": ("l1", "predicted")})


QUERIES = {"streaming_ingest": streaming_ingest, "hourly_counts": hourly_counts, "tfidf_svm": tfidf_svm}
ORACLES = {
    "streaming_ingest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
