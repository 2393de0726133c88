"""Hierarchical label metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _level(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Per label, over the labels of either side: support, predictions, hits and F1 (0 where it is undefined)."""
    pairs = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))
    labels = pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(*(F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")))
    return labels.withColumn("f1", F.col("hits") * 2.0 / (F.col("support") + F.col("predicted")))


def hierarchical(df: DataFrame, levels: dict[str, tuple[str, str]]) -> DataFrame:
    """Per level of df (true and predicted column each, not null): accuracy, macro F1 over the labels of either side, and F1 weighted by support. Empty tables give nulls."""
    out = None
    for name, (true, predicted) in levels.items():
        row = _level(df, true, predicted).agg(
            F.lit(name).alias("level"), F.coalesce(F.sum("support"), F.lit(0)).alias("n"), F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
            F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def confusion(df: DataFrame, true: str, predicted: str, top: int) -> DataFrame:
    """Rows (true, predicted, n, share) over the `top` most frequent true labels and Other; share is of the row's sum."""
    counts = df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    named = counts.groupBy("t").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "t").limit(top).select("t")
    tops = named.withColumn("kept", F.lit(True))
    marked = counts.join(F.broadcast(tops), "t", "left").join(F.broadcast(tops.withColumnsRenamed({"t": "p", "kept": "kept_p"})), "p", "left")
    cell = lambda c, kept: F.when(F.col(kept), F.col(c)).otherwise("Other")
    cells = marked.groupBy(cell("t", "kept").alias("true"), cell("p", "kept_p").alias("predicted")).agg(F.sum("n").alias("n"))
    sums = cells.groupBy("true").agg(F.sum("n").alias("all"))
    return cells.join(sums, "true").select("true", "predicted", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Per k: recall, mean reciprocal rank and nDCG of ranked (query, id, rank) against relevant (query, id), over the queries with anything relevant."""
    hits = relevant.join(ranked, ["query", "id"], "left")
    gain = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    each = hits.groupBy("query").agg(F.count("*").alias("all"), *(F.count_if(F.col("rank") <= k).alias(f"hit{k}") for k in ks), *(gain(k).alias(f"gain{k}") for k in ks), F.min("rank").alias("first"))
    best = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("all"), F.lit(k)).cast("int")), F.lit(0.0), lambda done, i: done + 1 / F.log2(i + 1))
    rows = [F.struct(F.lit(k).alias("k"), F.avg(F.col(f"hit{k}") / F.col("all")).alias("recall"), F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"), F.avg(F.col(f"gain{k}") / best(k)).alias("ndcg")) for k in ks]
    return each.agg(F.array(*rows).alias("r")).select(F.inline("r")).select("k", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


def by_configuration(results: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Per configuration: mean and sample deviation (null for one run) of each measure over its runs."""
    return results.groupBy(*by).agg(F.count("*").alias("runs"), *(f(m).alias(f"{m}_{name}") for m in measures for f, name in ((lambda c: F.round(F.avg(c), 6), "mean"), (lambda c: F.round(F.stddev_samp(c), 6), "deviation"))))
