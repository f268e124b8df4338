"""Where results go: verdicts as JSON, labelled corpora as folders, models as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.operators.bayes import Model


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """df(subject, message, label_text) as text under one folder per label."""
    content = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("message", F.lit("")))
    df.select(content.alias("value"), "label_text").write.mode("overwrite").partitionBy("label_text").text(path)


def save_model(model: Model, path: str) -> None:
    model.prior.write.mode("overwrite").parquet(f"{path}/prior")
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")


def load_model(spark: SparkSession, path: str) -> Model:
    return Model(spark.read.parquet(f"{path}/prior"), spark.read.parquet(f"{path}/counts"))


def training_summary(docs: DataFrame, vocabulary_limit: int) -> DataFrame:
    """docs(category, tokens) -> one row: documents of each class, distinct tokens, the limit."""
    each = docs.select("category", F.lit(0).alias("token")).unionByName(docs.select(F.explode("tokens").alias("t")).distinct().select(F.lit(None).cast("string").alias("category"), F.lit(1).alias("token")))
    n = each.agg(F.count_if(F.col("token") == 0).alias("documents"), F.count_if(F.col("category") == "ham").alias("ham"), F.count_if(F.col("category") == "spam").alias("spam"), F.count_if(F.col("token") == 1).alias("tokens"))
    return n.withColumn("vocabulary_limit", F.lit(vocabulary_limit))
