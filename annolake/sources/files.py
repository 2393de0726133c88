"""Files of labelled records: JSON in an envelope or as a bare list, CSV, numbered chunks, versions, and resuming from them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = "results"


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON files that hold {"results": [...], ...} or a list, with `_ord`, their place in the file. level_3 may be a string or a list of one.

    Another shape is an error. A file is one JSON value, so it is read by one task; tables are the form for large data.
    """
    text = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("_file"))
    listed = T.ArrayType(schema)
    bare, inside = F.from_json("value", listed), F.from_json("value", T.StructType([T.StructField(RECORDS, listed)]))[RECORDS]
    start = F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)
    wrong = F.raise_error(F.concat(F.lit("neither a list nor an object with results: "), "_file"))
    rows = F.when(start == "[", bare).when((start == "{") & inside.isNotNull(), inside).otherwise(wrong)
    return text.select(F.posexplode(rows).alias("_ord", "_row")).select("_row.*", "_ord")


def write_results(df: DataFrame, path: str, meta: dict[str, str] | None = None, order: str = "_ord", size: int = 200) -> None:
    """df as JSON files of one envelope each, {meta..., "num_samples": n, "results": [...]}, of `size` consecutive rows by the column `order`, which counts the rows from 0 and is not written."""
    shown = [c for c in df.columns if c != order]
    rows = df.select(F.floor(F.col(order) / size).alias("chunk"), F.struct(F.col(order).alias("at"), F.struct(*shown).alias("row")).alias("x"))
    each = rows.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.row).alias(RECORDS))
    fields = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    whole = F.to_json(F.struct(*fields, F.size(RECORDS).alias("num_samples"), F.col(RECORDS)))
    each.select("chunk", whole.alias("value")).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all columns text; columns that the file lacks are null, and nothing is inferred."""
    held = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return held.select(*(F.col(c) if c in held.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns named, and no others, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_chunks(df: DataFrame, path: str, order: str, size: int = 200) -> None:
    """df in folders of `size` consecutive rows each, by a column that counts the rows from 0."""
    df.withColumn("chunk", F.floor(F.col(order) / size)).repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)


def done_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Ids that earlier output holds. Where nothing was written yet there are none, and damaged files are passed over; any other failure is an error."""
    none = spark.createDataFrame([], T.StructType([T.StructField(key, T.StringType())]))
    try:
        return spark.read.option("ignoreCorruptFiles", True).parquet(path).select(key).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return none
        raise


def write_over(df: DataFrame, path: str) -> None:
    """df as Parquet at path; what was there is kept beside it as path.1, path.2 and so on, and is moved only after df is written."""
    spark = df.sparkSession
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    if files.exists(of(path)):
        n = 1
        while files.exists(of(f"{path}.{n}")):
            n += 1
        files.rename(of(path), of(f"{path}.{n}"))
    files.rename(of(f"{path}.new"), of(path))


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of df whose id is not in the output at path."""
    return df.join(done_ids(df.sparkSession, path, key), key, "left_anti")
