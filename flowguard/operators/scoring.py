"""Scorers: DataFrame in, the same DataFrame with ``prediction`` out.

The trained models this engine's jobs were designed around are not available, so a scorer is a
parameter everywhere: a SQL rule, or an MLlib pipeline trained on the caller's labelled data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import Column, DataFrame, functions as F

Scorer = Callable[[DataFrame], DataFrame]


def rule(condition: str) -> Scorer:
    """1 where the SQL condition holds, else 0."""
    return lambda df: df.withColumn("prediction", F.coalesce(F.expr(condition), F.lit(False)).cast("int"))


def model(fitted: PipelineModel) -> Scorer:
    """Score with a fitted pipeline; only its ``prediction`` is kept, as an integer."""

    def score(df: DataFrame) -> DataFrame:
        return fitted.transform(df).select(*df.columns, F.col("prediction").cast("int"))

    return score


def save(fitted: PipelineModel, path: str) -> str:
    """Write a fitted pipeline to the shared folder, from which any session loads it."""
    fitted.write().overwrite().save(path)
    return path


def load(path: str) -> Scorer:
    return model(PipelineModel.load(path))


def held_out(key: Column, share: int = 5) -> Column:
    """Whether a row is kept from training: one of ``share`` keys, by a digest, so that copies of a key stay together."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % share == 0


def quality(scored: DataFrame, label: str = "label", least: float = 0.9) -> DataFrame:
    """One row on scored rows with their label: how many, how many positive ones, and whether ``least`` of all are right."""
    right = F.avg((F.col(label).cast("int") == F.col("prediction")).cast("double"))
    return scored.agg(
        F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), (right >= least).alias("good")
    )


def train_forest(
    df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 7
) -> PipelineModel:
    assemble = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, maxBins=32
    )
    return Pipeline(stages=[assemble, forest]).fit(df)


def train_logistic(df: DataFrame, vector: str, size: int, label: str, rounds: int = 20) -> PipelineModel:
    """Logistic regression on a vector column; the assembler stores a mostly empty vector sparsely."""
    hint = VectorSizeHint(inputCol=vector, size=size)
    pack = VectorAssembler(inputCols=[vector], outputCol="_x")
    lr = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=rounds, regParam=0.01)
    return Pipeline(stages=[hint, pack, lr]).fit(df)


def top_class(probabilities: Column) -> Column:
    """Index of the largest class probability; the lowest index wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def at_least_half(probability: Column) -> Column:
    """1 above 0.5, else 0."""
    return F.when(probability > 0.5, 1).otherwise(0)


def any_positive(df: DataFrame, by: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """One row per group: 1 if any member is positive (a directory of files, the frames of a text)."""
    return df.groupBy(*by).agg(F.max(prediction).alias(prediction))
