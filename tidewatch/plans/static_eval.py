"""Static evaluation: train and test tables, several models and feature sets, threshold 0.5."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import metrics, profile
from tidewatch.operators.combine import with_row
from tidewatch.operators.flows import require_binary, trimmed
from tidewatch.operators.preprocess import FittedFeatures, fit_features
from tidewatch.plans.experiment import at_once, held
from tidewatch.plans.models import fit_model


def prepare_static(df: DataFrame, feature_set: str, sets: Mapping[str, Sequence[str]] | None = None,
                   label: str = schema.LABEL) -> tuple[DataFrame, list[str], list[str]]:
    """Trimmed, policy-checked table with its binary target; (table, numeric, categorical)."""
    clean = require_binary(trimmed(df), label)
    chosen, _ = schema.select_feature_set(clean, feature_set, sets)
    numeric, categorical = schema.split_by_type(chosen)
    return clean.select(*numeric, *categorical, label), numeric, categorical


def fit_static(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> FittedFeatures:
    """Median and mode filling, scaling and one-hot levels from the training table only."""
    return fit_features(train, numeric, categorical, impute=True)


def evaluate_grid(train: DataFrame, test: DataFrame, models: Sequence[str], sets: Mapping[str, Sequence[str]] | None = None,
                  params: Mapping[str, dict] | None = None, seed: int = 42) -> DataFrame:
    """Metrics of every model on every feature set, with the training accuracy."""
    sets = schema.FEATURE_SETS if sets is None else sets
    spark = train.sparkSession

    def prepared(name: str) -> tuple[DataFrame, DataFrame, FittedFeatures]:
        rows, numeric, categorical = prepare_static(train, name, sets)
        return rows, prepare_static(test, name, sets)[0], fit_static(rows, numeric, categorical)

    def evaluated(name: str, model: str, rows: DataFrame, unseen: DataFrame, fitted: FittedFeatures) -> DataFrame:
        trained = fit_model(model, rows, fitted, (params or {}).get(model), seed)

        def judged(df):
            scored = trained.score(df).select(F.col(schema.LABEL).alias("y_true"), "y_score")
            return scored.withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))

        accuracy = judged(rows).agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("int"))).first()[0]
        with held(judged(unseen)) as predicted:
            part = with_row(metrics.static_metrics(predicted), metrics.ranking(predicted)).withColumns({
                "feature_set": F.lit(name), "model": F.lit(model), "train_accuracy": F.lit(accuracy)})
            return spark.createDataFrame(part.collect(), part.schema)

    parts = dict(zip(sets, at_once(spark, [lambda name=name: prepared(name) for name in sets])))
    return reduce(DataFrame.unionByName, at_once(spark, [
        lambda name=name, model=model: evaluated(name, model, *parts[name]) for name in sets for model in models]))


def validate_table(df: DataFrame, expected: Sequence[str] = tuple(schema.STATIC_COLUMNS), label: str = schema.LABEL,
                   excluded: Sequence[str] = tuple(schema.EXCLUDED_FEATURES)) -> dict[str, DataFrame]:
    """Structure, target and feature checks of one raw table."""
    numeric, categorical = schema.split_by_type(df.drop(*excluded, label))
    roles = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical] + [
        (c, "excluded") for c in excluded if c in df.columns]
    wanted = df.sparkSession.createDataFrame([(c, None) for c in expected], "column_name string, data_type string")
    return {
        "columns": profile.column_profile(df), "duplicates": profile.duplicate_rows(df),
        "schema": profile.schema_difference(profile.columns_of(df), wanted), "target": profile.target_counts(df, label),
        "roles": df.sparkSession.createDataFrame(roles, "column_name string, role string"),
    }
