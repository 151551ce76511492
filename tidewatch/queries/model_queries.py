"""Trained models on the flow tables. Results depend on the solver, so they carry no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.drift import DriftSettings
from tidewatch.operators.windows import HOUR
from tidewatch.plans import ablation, adaptation, experiment, shift_study, static_eval
from tidewatch.queries.base import query
from tidewatch.sources import views

DAY = 24 * HOUR
PARAMS = {"logistic_regression": {"max_iter": 20}, "random_forest": {"n_estimators": 10, "max_depth": 5},
          "gradient_boosting": {"n_estimators": 5, "max_depth": 3}, "neural_network": {"max_iter": 10}}
DRIFT = DriftSettings(window=DAY, min_samples=20, cusum_block=5, cusum_warmup=10, tiebreak=("event_id",),
                      features=["flow_duration", "total_packets", "total_bytes"])


def bench(spark, folder, columns=None):
    data = views.events_common(spark, folder)
    return experiment.prepare(data, columns, params=PARAMS)


NUMERIC = ["flow_duration", "total_packets", "total_bytes", "packet_rate", "bytes_log1p"]


@query("model_backtest_forward")
def model_backtest_forward(spark, folder):
    """Five models: fit on train, threshold on validation, metrics on both later periods."""
    return experiment.benchmark(bench(spark, folder, NUMERIC), [
        "majority", "logistic_regression", "random_forest", "gradient_boosting", "neural_network"]).drop("train_seconds")


@query("adaptation_study")
def adaptation_study(spark, folder):
    b = bench(spark, folder, NUMERIC)
    run = experiment.run_model(b, "logistic_regression")
    return adaptation.study(b, run, window_us=2 * DAY, step_us=2 * DAY).drop("training_seconds")


@query("shift_study")
def shift_study_query(spark, folder):
    """All shift kinds on one frozen model."""
    b = bench(spark, folder, NUMERIC)
    return shift_study.shift_study(b, "logistic_regression", ["event_id"], DRIFT, window_us=2 * DAY)


@query("ablation_sweeps")
def ablation_sweeps(spark, folder):
    b = bench(spark, folder, NUMERIC)
    names = ["split_mode", "feature_policy", "adaptation_window", "telemetry_family", "target_fpr"]
    return ablation.run_ablations(b, ["logistic_regression"], ["event_id"], names).drop("seconds")


@query("ablation_drift_thresholds")
def ablation_drift_thresholds(spark, folder):
    """All twelve threshold settings, CUSUM false-alarm rates included."""
    b = bench(spark, folder, NUMERIC)
    settings = DriftSettings(**{**DRIFT.__dict__, "methods": ("ks", "wasserstein", "psi", "cusum")})
    return ablation.run_ablations(b, ["logistic_regression"], ["event_id"], ["drift_threshold"], settings).select(
        "ablation", "variant", "alerts", "comparisons", "alert_rate", "mean_effect_size", "note")


@query("feature_importance")
def feature_importance(spark, folder):
    model = bench(spark, folder, NUMERIC).fit("random_forest")
    rows = [(i + 1, name, value) for i, (name, value) in enumerate(model.importances()[:20])]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


@query("static_grid")
def static_grid(spark, folder):
    """Two feature sets and three models on a table of train and test halves."""
    items = views.lineitem_common(spark, folder)
    sets = {"FULL": ["flow_duration", "total_packets", "total_bytes", "packet_rate", "protocol"],
            "RESTRICTED": ["flow_duration", "total_packets"]}
    train = items.where(F.pmod("l_orderkey", F.lit(2)) == 0)
    test = items.where(F.pmod("l_orderkey", F.lit(2)) == 1)
    return static_eval.evaluate_grid(train, test, ["majority", "logistic_regression", "random_forest"], sets, PARAMS).drop(
        "confusion_matrix")
