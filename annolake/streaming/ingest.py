"""Incremental runs: the same transformations over a stream of files, written as keyed upserts.

The stream's checkpoint takes the place of done-lists; a batch that is run again gives the same table, since the newest row of a key wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from annolake.operators.curate import upsert
from annolake.session import delete


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Buckets of a target table, by a hash of the key; a batch rewrites those that its keys are in.
BUCKETS = 64


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each batch is transformed and written into `target`; the newest row of each key stays. Runs until all that is there is read.

    A batch writes new versions of the buckets that its keys are in, and of no others; of each bucket the last two versions are kept, so that a batch that failed halfway is run
    again from the version before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = transform(batch).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        touched = {r.bucket for r in newest.select("bucket").distinct().toLocalIterator()}  # BUCKETS at most
        held = _buckets(spark, target, number)
        paths = [held[b][-1] for b in sorted(touched & set(held))]
        bare = newest.drop("bucket")
        current = spark.read.schema(bare.schema).parquet(*paths) if paths else bare.limit(0)
        merged = upsert(current, bare, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        newest.unpersist()
        for b in touched & set(held):
            for old in held[b][:-1]:
                delete(spark, old)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket's versions, oldest first, of batches that ended, before one if given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = path(target)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return {}
    versions = {int(s.getPath().getName()[2:]): s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("v=") and files.exists(path(s.getPath(), "_SUCCESS"))}
    found: dict[int, list[str]] = {}
    for v in sorted(v for v in versions if before is None or v < before):
        for s in files.listStatus(versions[v]):
            if (name := s.getPath().getName()).startswith("bucket="):
                found.setdefault(int(name[7:]), []).append(s.getPath().toString())
    return found


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """The table as it stands: the last version of each bucket."""
    return spark.read.parquet(*(paths[-1] for _, paths in sorted(_buckets(spark, target).items())))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window of event time and value of `by`; rows later than `late` are left out once the window is given out. For streams and tables alike."""
    held = stream.withWatermark(time, late) if stream.isStreaming else stream
    return held.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
