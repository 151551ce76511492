import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.drift import DriftSettings
from tidewatch.operators.split import TemporalLeakageError
from tidewatch.operators.windows import HOUR
from tidewatch.plans import ablation, adaptation, experiment, models, shift_study

PARAMS = {"logistic_regression": {"max_iter": 15}, "random_forest": {"n_estimators": 4, "max_depth": 3}}


@pytest.fixture(scope="module")
def bench(spark):
    rng = np.random.default_rng(3)
    n = 3000
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "timestamp": pd.date_range("2024-01-01", periods=n, freq="2min"), "label": y,
                        "flow_duration": rng.exponential(2 + 3 * y), "total_packets": rng.poisson(5 + 4 * y).astype(float),
                        "total_bytes": rng.exponential(100, n), "packet_rate": rng.exponential(3, n), "byte_rate": rng.exponential(9, n),
                        "protocol": rng.choice(["TCP", "UDP"], n)})
    df = spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return experiment.prepare(df, params=PARAMS)


def test_benchmark_learns(bench):
    got = experiment.benchmark(bench, ["majority", "logistic_regression"]).toPandas().set_index(["model", "period"])
    assert got.roc_auc["logistic_regression", "forward"] > 0.75 and got.roc_auc["majority", "forward"] == 0.5
    assert got.false_positive_rate["logistic_regression", "backtest"] < 0.12


def test_majority_both_ways(bench):
    train = bench.period("train")
    plain = models.fit_model("majority", train, bench.features)
    flipped = models.fit_model("majority", train, bench.features, inverted_majority=True)
    assert plain.score(train).first().y_score == 0.0 and flipped.score(train).first().y_score == 1.0
    with pytest.raises(KeyError):
        models.fit_model("nope", train, bench.features)


def test_strategies(bench):
    run = experiment.run_model(bench, "logistic_regression")
    got = adaptation.study(bench, run, window_us=12 * HOUR, step_us=6 * HOUR).toPandas().set_index("strategy")
    assert list(got.index) == list(adaptation.STRATEGIES)
    assert got.f1_gain["none"] == 0.0 and got.refits["none"] == 0
    assert got.rows_used["recent_window_retrain"] == 360 and got.refits["rolling_window_retrain"] >= 3
    assert got.rows_used["historical_plus_recent_retrain"] == 1860
    forward = {r.period: r for r in run.metrics.collect()}["forward"]
    assert got.f1["none"] == pytest.approx(forward.f1) and got.threshold["none"] == run.threshold
    assert abs(got.f1["recent_window_retrain"] - got.f1["rolling_window_retrain"]) > 1e-9


def test_history_reaching_into_the_scored_period_is_refused(bench):
    run = experiment.run_model(bench, "majority")
    with pytest.raises(TemporalLeakageError):
        adaptation.adapt(bench, run, "threshold_recalibration", bench.period("forward"), bench.period("forward"), None)
    with pytest.raises(KeyError):
        adaptation.adapt(bench, run, "nope", bench.period("backtest"), bench.period("forward"), None)


def test_shift_study(bench):
    settings = DriftSettings(window=3 * HOUR, min_samples=50, features=["flow_duration", "total_packets"], tiebreak=("id",))
    got = shift_study.shift_study(bench, "logistic_regression", ["id"], settings,
                                  [("duration", 3.0), ("class_prevalence", 0.05), ("protocol_mixture", 3.0), ("telemetry_reduction", 0.0)],
                                  window_us=24 * HOUR).toPandas().set_index("shift")
    assert got.realized_verified["duration"] and got.detected_drift["duration"]
    assert got.attack_rate["class_prevalence"] == pytest.approx(0.05, abs=0.01)
    assert got.realized_max_categorical_tvd["protocol_mixture"] > 0.1
    assert got.adapt_f1["duration"] >= got.shifted_f1["duration"]
    assert not got.realized_verified["telemetry_reduction"] or len(got.columns_removed["telemetry_reduction"])


def test_ablations(bench):
    got = ablation.run_ablations(bench, ["logistic_regression"], ["id"], ["split_mode", "telemetry_family", "target_fpr"]).toPandas()
    assert not got.note.fillna("").str.startswith("failed").any()
    assert set(got[got.ablation == "split_mode"].variant) == {"temporal", "random"}
    sweep = got[got.ablation == "target_fpr"].sort_values("target_fpr")
    assert len(sweep) == 5 and (sweep.recall.diff().dropna() >= 0).all()
    with pytest.raises(KeyError):
        ablation.run_ablations(bench, ["majority"], ["id"], ["nope"])


def test_a_failed_sweep_fails_the_table_after_the_others_ended(bench, monkeypatch):
    ended = []

    def broken(bench, model, keys):
        raise ValueError(f"no rows for {model}")
    monkeypatch.setitem(ablation.ABLATIONS, "split_mode", broken)
    monkeypatch.setitem(ablation.ABLATIONS, "target_fpr", lambda bench, model, keys: ended.append(model) or [{"variant": "fpr_0.01"}])
    with pytest.raises(ablation.AblationError) as error:
        ablation.run_ablations(bench, ["majority", "random_forest"], ["id"], ["split_mode", "target_fpr"])
    assert all(f"{m}/split_mode: ValueError: no rows for {m}" in str(error.value) for m in ("majority", "random_forest"))
    assert sorted(ended) == ["majority", "random_forest"]
    assert ablation.run_ablations(bench, ["majority"], ["id"], ["target_fpr"]).first().variant == "fpr_0.01"


def test_importances(bench):
    ranked = bench.fit("random_forest").importances()
    assert ranked[0][0] in ("flow_duration", "total_packets") and sum(v for _, v in ranked) == pytest.approx(1.0)
