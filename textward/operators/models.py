"""Linear models trained and applied with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.operators.ensemble import bundle_result, toxicity_result


def train_text_model(
    df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14, iterations: int = 20
) -> PipelineModel:
    """Hashed word counts into a logistic regression. No vocabulary, so one pass per iteration."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__words", outputCol="__features", numFeatures=features),
        LogisticRegression(
            featuresCol="__features", labelCol=label, predictionCol="__prediction",
            rawPredictionCol="__raw", probabilityCol="__probability", maxIter=iterations, regParam=0.01,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


_MODEL_COLUMNS = ["__words", "__features", "__raw", "__probability", "__prediction"]


def _with_outputs(df: DataFrame, model: PipelineModel) -> tuple[DataFrame, Column, Column]:
    out = model.transform(df).withColumn("__probs", vector_to_array("__probability"))
    return out, F.col("__prediction"), F.col("__probs")


def score_toxicity(df: DataFrame, model: PipelineModel, name: str = "Toxicity", into: str = "toxicity") -> DataFrame:
    """Adds the model's result: blocked on a prediction of 1, scored by that class's probability."""
    out, prediction, probs = _with_outputs(df, model)
    return out.withColumn(into, toxicity_result(name, prediction, F.get(probs, F.lit(1)))).drop(
        *_MODEL_COLUMNS, "__probs"
    )


def score_bundle(
    df: DataFrame, model: PipelineModel, name: str, classes: list[str], into: str = "result"
) -> DataFrame:
    """Adds the result of a model whose classes have names; the predicted name decides."""
    out, prediction, probs = _with_outputs(df, model)
    names = F.array(*[F.lit(c) for c in classes])
    predicted = F.get(names, prediction.cast("int"))
    return out.withColumn(into, bundle_result(name, predicted, probs, names)).drop(
        *_MODEL_COLUMNS, "__probs"
    )


def train_head(
    df: DataFrame, embedding: str = "embedding", label: str = "label", iterations: int = 20
) -> PipelineModel:
    """A logistic regression on embeddings computed elsewhere."""
    head = LogisticRegression(
        featuresCol="__features", labelCol=label, predictionCol="__prediction",
        rawPredictionCol="__raw", probabilityCol="__probability", maxIter=iterations, regParam=0.01,
    )
    return Pipeline(stages=[head]).fit(with_vector(df, embedding))


def with_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("__features", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))


def apply_head(df: DataFrame, model: PipelineModel, embedding: str = "embedding") -> DataFrame:
    """Adds ``pred`` and ``score``, the probability of class 1."""
    out, prediction, probs = _with_outputs(with_vector(df, embedding), model)
    return out.select(
        *df.columns, prediction.cast("int").alias("pred"), F.get(probs, F.lit(1)).alias("score")
    )
