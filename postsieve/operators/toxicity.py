"""A trainable text scorer in Spark ML, and the place where a model for images is plugged in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.session import cut_lineage


def train(labelled: DataFrame, features: int = 1 << 14):
    """labelled(text, label double) -> a fitted pipeline: words, hashed counts, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+")
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    return Pipeline(stages=[words, hashed, LogisticRegression(maxIter=20, regParam=0.01)]).fit(labelled.where("text is not null and label is not null"))


def score(model, texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """texts(id, text) -> (id, toxicity, toxic)."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return model.transform(texts.where("text is not null")).select("id", p.alias("toxicity"), (p >= threshold).alias("toxic"))


#: Labels of toxic text.
LABELS = ("identity_attack", "insult", "obscene", "severe_toxicity", "sexual_explicit", "threat")


def train_labels(labelled: DataFrame, labels: tuple[str, ...] = LABELS, features: int = 1 << 14) -> dict:
    """labelled(text, and a column 0 or 1 for each label) -> a model for each label that has both values; words and counts are made once."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+")
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=features)
    made = cut_lineage(hashed.transform(words.transform(labelled.where("text is not null"))).select("features", *(F.col(x).cast("double").alias(x) for x in labels)))
    both = made.agg(*(F.count_distinct(x).alias(x) for x in labels)).first()
    models = {x: LogisticRegression(labelCol=x, maxIter=20, regParam=0.01).fit(made.where(F.col(x).isNotNull())) for x in labels if both[x] > 1}
    return {"words": words, "hashed": hashed, "models": models}


def score_labels(trained: dict, texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """texts(id, text) -> (id, label, probability) of the labels that a text matches; one pass over the texts for all labels."""
    from pyspark.ml.functions import vector_to_array

    df = trained["hashed"].transform(trained["words"].transform(texts.where("text is not null").select("id", "text"))).select("id", "features")
    for label, model in trained["models"].items():
        model = model.copy()
        model.setProbabilityCol(f"p_{label}").setRawPredictionCol(f"r_{label}").setPredictionCol(f"y_{label}")
        df = model.transform(df)
    if not trained["models"]:
        return df.select("id", F.lit("").alias("label"), F.lit(0.0).alias("probability")).limit(0)
    each = F.array(*(F.struct(F.lit(x).alias("label"), vector_to_array(F.col(f"p_{x}"))[1].alias("probability")) for x in trained["models"]))
    return df.select("id", F.explode(each).alias("x")).select("id", "x.label", "x.probability").where(F.col("probability") >= threshold)


def image_kind(content: Column) -> Column:
    """png, jpeg, gif or webp by the first bytes, null for other content."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def image_scores(attachments: DataFrame, model: Callable[[pd.Series], pd.Series], threshold: float = 0.6) -> DataFrame:
    """attachments(message_id, filename, content) -> (message_id, filename, kind, score, flagged) of the images, by a caller's model of bytes."""
    images = attachments.withColumn("kind", image_kind(F.col("content"))).where("kind is not null")
    return images.select("message_id", "filename", "kind", F.pandas_udf(model, "double")(F.col("content")).alias("score")).withColumn("flagged", F.col("score") > threshold)
