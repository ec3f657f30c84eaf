"""Models of the ranking side that Spark's own library fits: clusters of vectors, and a balanced linear probe."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def clusters(df: DataFrame, column: str, k: int, seed: int = 42, rounds: int = 25) -> DataFrame:
    """df with its cluster, from k-means over the vectors."""
    rows = vectors(df, column)
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="assigned").fit(rows)
    return model.transform(rows).drop("features")


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Both classes weigh the same in all."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    share = rows.agg(F.avg("label")).first()[0] or 0.5
    return rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / max(1 - share, 1e-9)))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "weight", "label")


def fitted_probe(known: DataFrame, column: str, label: str, c: float = 1.0) -> PipelineModel:
    """The probe as a pipeline of one model, so that it can be saved; it takes vectors() and gives what scored() takes."""
    rows = _weighted(vectors(known, column), label)
    return Pipeline(stages=[LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(rows.count(), 1)))]).fit(rows)


def fitted_trees(known: DataFrame, columns: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Assembled columns and boosted trees as one pipeline, so that what scores rows is saved whole."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(_weighted(known, label))


def save_model(model: PipelineModel, path: str) -> None:
    """As an artefact in a shared folder, replaced as a whole."""
    model.write().overwrite().save(path)


def load_model(path: str, spark: SparkSession | None = None) -> PipelineModel:
    """For a session; without one, for the one that is active."""
    reader = PipelineModel.read()
    return (reader.session(spark) if spark else reader).load(path)


def linear_probe(known: DataFrame, candidates: DataFrame, column: str, label: str, c: float = 1.0) -> DataFrame:
    """candidates with the probability of label = 1, from a balanced logistic model fitted on what is known; c weighs the rows against the penalty."""
    return scored(fitted_probe(known, column, label, c), vectors(candidates, column))


def boosted_trees(known: DataFrame, candidates: DataFrame, columns: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """candidates with the probability of label = 1, from boosted trees fitted on what is known; both classes weigh the same."""
    return scored(fitted_trees(known, columns, label, rounds, depth, seed), candidates)
