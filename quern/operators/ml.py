"""Risk models on series statistics: features pivoted by item, imputed and scaled on the training rows alone."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max", "median", "availability")


def feature_table(stats: DataFrame, entity: str, item: str, items: list[str], people: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """A row an entity, a column for each item and statistic, null where an item has no series. people: more numbers by entity (age,
    gender ...); codes: entity and code, of which distinct ones are counted as n_codes."""
    wide = stats.groupBy(entity).pivot(item, items).agg(*[F.first(s).alias(s) for s in STATS])
    if people is not None:
        wide = wide.join(people, entity, "left")
    if codes is not None:
        wide = wide.join(codes.groupBy(entity).agg(F.count_distinct("code").cast("double").alias("n_codes")), entity, "left").fillna(0.0, ["n_codes"])
    return wide


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weights by which all labels count alike."""
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    whole = sizes.agg(F.sum("__n").alias("n"), F.count("*").alias("k")).first()
    weights = sizes.select("__l", (F.lit(whole["n"]) / (whole["k"] * F.col("__n"))).alias("weight"))
    return df.join(weights, F.col(label).eqNullSafe(F.col("__l"))).drop("__l")


def fit(train: DataFrame, features: list[str], label: str, model: str = "forest", seed: int = 42) -> PipelineModel:
    """A random forest (100 trees, depth 10) or a logistic regression, both balanced."""
    filled, n = [f"{f}__f" for f in features], train.count()
    population = Vectors.dense([(n / max(n - 1, 1)) ** 0.5] * len(features))  # the scaler divides by the sample's deviation
    steps = [
        Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), ElementwiseProduct(scalingVec=population, inputCol="scaled", outputCol="features")
    ]
    if model == "forest":
        steps.append(RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=100, maxDepth=10, seed=seed))
    else:
        steps.append(LogisticRegression(labelCol=label, weightCol="weight", maxIter=1000))
    return Pipeline(stages=steps).fit(balanced(train, label))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    return sorted(zip(features, last.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
