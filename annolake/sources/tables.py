"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small file would be read by fewer tasks; for work that is heavy for each row. Large tables have more parts than that, and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def wide(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as the session's shuffles have, also where its rows are so small that adaptive execution would put the parts together; for work that is heavy for each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
