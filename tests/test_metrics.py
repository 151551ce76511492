import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import failure, metrics


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(1500) < 0.3).astype(int)
    s = np.clip(np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1)
    s[:500] = 0.37  # one score holds a third of the rows
    pdf = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=1500, freq="5min"), "y_true": y, "y_score": s})
    return pdf, spark.createDataFrame(pdf)


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None]).sum() + 0.5 * (p[:, None] == n[None]).sum()) / (len(p) * len(n))


def step_precision(y, s):
    total = 0.0
    for t in np.unique(s):
        hit = s >= t
        total += ((s == t) & (y == 1)).sum() / y.sum() * y[hit].mean()
    return total


def test_ranking_areas(scored, slicing):
    pdf, df = scored
    row = metrics.ranking(df).first()
    y, s = pdf.y_true.to_numpy(), pdf.y_score.to_numpy()
    assert row.roc_auc == pytest.approx(auc(y, s), abs=1e-12)
    assert row.pr_auc == pytest.approx(step_precision(y, s), abs=1e-12)


def test_single_class_has_no_areas(scored):
    _, df = scored
    row = metrics.ranking(df.where("y_true = 0")).first()
    assert row.roc_auc is None and row.pr_auc is None
    assert metrics.threshold_for_budget(df.where("y_true = 1")) == 0.5


def test_budget_threshold_is_the_negative_quantile(scored, slicing):
    pdf, df = scored
    negatives = pdf[pdf.y_true == 0].y_score
    for budget in (0.01, 0.05, 0.2):
        assert metrics.threshold_for_budget(df, budget) == pytest.approx(np.quantile(negatives, 1 - budget), abs=1e-12)
    sweep = metrics.budget_sweep(df).orderBy("target_fpr").toPandas()
    assert (sweep.achieved_fpr.diff().dropna() >= 0).all() and len(sweep) == 5


def test_perfect_wrong_and_empty_predictions(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 0)], "y_true int, y_pred int")
    best = metrics.confusion(rows).first()
    assert best.f1 == 1.0 and best.false_positive_rate == 0.0 and best.balanced_accuracy == 1.0
    worst = metrics.confusion(rows.withColumn("y_pred", 1 - F.col("y_pred"))).first()
    assert worst.f1 == 0.0 and worst.false_negative_rate == 1.0
    none = metrics.confusion(rows.where("y_true = 0")).first()
    assert none.precision == 0.0 and none.recall == 0.0 and none.balanced_accuracy == 1.0


def test_calibration(scored):
    pdf, df = scored
    row = metrics.calibration(df).first()
    assert row.brier == pytest.approx(((pdf.y_score - pdf.y_true) ** 2).mean())
    assert len(row.curve) == 10 and sum(c.n for c in row.curve) == 1500
    assert [c.bin for c in row.curve] == list(range(10))
    assert all((c.mean_pred is None) == (c.n == 0) for c in row.curve)


def test_alert_alignment(spark):
    windows = spark.sql("SELECT timestamp_ntz'2024-01-01' AS bucket, 0.9 AS recall UNION ALL SELECT timestamp_ntz'2024-01-01 06:00', 0.2 UNION ALL SELECT timestamp_ntz'2024-01-01 12:00', NULL")
    events = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2023-12-31 10:00', timestamp_ntz'2023-12-31 11:00', true), (timestamp_ntz'2024-01-01 01:00', timestamp_ntz'2024-01-01 02:00', true),
        (timestamp_ntz'2024-01-01 05:50', timestamp_ntz'2024-01-01 06:50', true), (timestamp_ntz'2024-01-01 05:50', timestamp_ntz'2024-01-01 06:50', true),
        (timestamp_ntz'2024-01-05', timestamp_ntz'2024-01-06', true), (timestamp_ntz'2024-01-01 07:00', timestamp_ntz'2024-01-01 08:00', false) AS t(window_start, window_end, alert)""")
    row = failure.alerts_without_degradation(events, windows).first()
    assert (row.alerts, row.in_degraded_windows, row.without_degradation, row.unmatched_alerts) == (4, 1, 1, 2)
    assert (row.model_windows, row.degraded_windows, row.matched) == (2, 1, True)
    lead = failure.drift_lead(events, windows, baseline_recall=0.9).first()
    assert str(lead.first_degraded_window) == "2024-01-01 06:00:00" and lead.drift_precedes_degradation


def test_asof_with_a_hot_group(spark, slicing):
    rng = np.random.default_rng(4)
    left = pd.DataFrame({"g": np.where(rng.random(900) < 0.8, "hot", "cold"), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 5000, 900), "s"), "i": range(900)})
    right = pd.DataFrame({"g": np.where(rng.random(400) < 0.8, "hot", "cold"), "u": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.choice(5000, 400, replace=False), "s"), "v": rng.normal(0, 1, 400)})
    got = failure.asof(spark.createDataFrame(left), spark.createDataFrame(right), "t", "u", ["v"], by=["g"], expected_rows=1300).toPandas().sort_values("i")
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="g").sort_values("i")
    assert np.array_equal(got.v.to_numpy(), want.v.to_numpy(), equal_nan=True)
