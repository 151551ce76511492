"""Classifiers by name, all on MLlib, behind one fit/score surface."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.preprocess import FittedFeatures, balanced_weights
from tidewatch.schema import LABEL

# Model names in registry order.
MODELS = ("majority", "logistic_regression", "random_forest", "gradient_boosting", "neural_network")


@dataclass
class FittedModel:
    """A trained classifier and what it was trained with."""

    name: str
    features: FittedFeatures
    model: object
    seconds: float
    rows: int
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "y_score") -> DataFrame:
        """Add P(label = 1) to a table."""
        if self.name == "majority":
            return df.withColumn(out, F.lit(float(self.model)))
        scored = self.model.transform(self.features.vectors(df, "_features"))
        return scored.withColumn(out, vector_to_array("probability")[1]).drop(
            "_features", "probability", "rawPrediction", "prediction")

    def importances(self) -> list[tuple[str, float]]:
        """Feature importances, largest first (tree models)."""
        values = self.model.featureImportances.toArray()
        return sorted(zip(self.features.names, map(float, values)), key=lambda p: (-p[1], p[0]))


def estimator(name: str, width: int, rows: int, seed: int, params: dict):
    """An MLlib estimator with the settings of the named model."""
    common = dict(featuresCol="_features", labelCol=LABEL)
    if name == "logistic_regression":
        # Balanced weights add up to the number of rows, which scales the penalty.
        strength = 1.0 / (float(params.get("C", 1.0)) * max(rows, 1))
        return LogisticRegression(maxIter=int(params.get("max_iter", 1000)), regParam=strength, elasticNetParam=0.0,
                                  standardization=False, weightCol="weight", **common)
    if name == "random_forest":
        if int(params.get("max_depth") or 30) > 30:
            raise ValueError("random forests grow to a depth of 30 at most (also the default)")
        return RandomForestClassifier(
            numTrees=int(params.get("n_estimators", 200)), maxDepth=int(params.get("max_depth") or 30),
            minInstancesPerNode=int(params.get("min_samples_leaf", 1)), weightCol="weight", seed=seed, **common)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=int(params.get("n_estimators", 100)), maxDepth=int(params.get("max_depth", 3)),
                             stepSize=float(params.get("learning_rate", 0.1)),
                             subsamplingRate=float(params.get("subsample", 1.0)), seed=seed, **common)
    if name == "neural_network":
        hidden = list(params.get("hidden_layer_sizes", (64, 32)))
        return MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=int(params.get("max_iter", 60)),
                                              seed=seed, **common)
    raise KeyError(f"unknown model {name!r}; known: {MODELS}")


def fit_model(name: str, train: DataFrame, features: FittedFeatures, params: dict | None = None, seed: int = 42,
              inverted_majority: bool = False) -> FittedModel:
    """Train one model on the rows given.

    ``inverted_majority`` gives the baseline the score of the other class, which some
    published numbers of the baseline rest on.
    """
    params = dict(params or {})
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {MODELS}")
    start = time.perf_counter()
    if name == "majority":
        one, rows = train.agg(F.count_if(F.col(LABEL) == 1), F.count("*")).first()
        top = 1 if one * 2 > rows else 0
        return FittedModel(name, features, float(1 - top if inverted_majority else top),
                           time.perf_counter() - start, rows, params)
    # One class only would leave a classifier with nothing to separate.
    vectors = features.vectors(balanced_weights(train), "_features").select("_features", LABEL, "weight")
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = vectors.count()
        model = estimator(name, len(features.names), rows, seed, params).fit(vectors)
    finally:
        vectors.unpersist()
    return FittedModel(name, features, model, time.perf_counter() - start, rows, params)
