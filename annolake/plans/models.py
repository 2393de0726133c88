"""A linear model of labels over word counts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_svm(train: DataFrame, text: str, label: str, words: int = 50_000, least: int = 2, iterations: int = 10) -> PipelineModel:
    """One linear support vector machine per class over the TF-IDF of words and word pairs, on rows weighted against their class's size.

    Give it a sample of labelled rows whose size is bounded; the model is then applied to any number of rows.
    """
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))
    weighted = train.join(sizes, label).withColumn("weight", 1.0 / F.col("_n"))
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=words, minDF=least),
        IDF(inputCol="_counts", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="label_number", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneVsRest(classifier=LinearSVC(maxIter=iterations, weightCol="weight"), labelCol="label_number", featuresCol="features", weightCol="weight"),
    ]
    return Pipeline(stages=stages).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame, name: str = "predicted") -> DataFrame:
    """rows with the label the model gives each."""
    labels = F.array(*map(F.lit, model.stages[-2].labels))
    kept = rows.columns
    own = rows if "weight" in kept else rows.withColumn("weight", F.lit(1.0))
    return model.transform(own).select(*kept, F.get(labels, F.col("prediction").cast("int")).alias(name))
