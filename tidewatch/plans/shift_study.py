"""Controlled-shift experiments: a frozen model on shifted copies of the backtest period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions.columns import micros
from tidewatch.operators import audit, drift, metrics, realized, shifts
from tidewatch.operators.windows import assign_windows, plan_windows
from tidewatch.plans.adaptation import recent_history
from tidewatch.plans.experiment import Bench, run_model, score_table
from tidewatch.schema import TIME


def shifted_tables(bench: Bench, keys: Sequence[str], settings: Sequence[tuple[str, float]],
                   ) -> tuple[DataFrame, list[dict]]:
    """All shifted copies under one another with a setting number, and which were skipped.

    Copies are lazy projections of the same scan, so every later step is one job for all.
    """
    backtest = bench.period("backtest")
    out, notes = None, []
    for i, (kind, magnitude) in enumerate(settings):
        try:
            part = shifts.apply_shift(backtest, kind, magnitude, keys, bench.seed)
        except (KeyError, ValueError) as error:
            notes.append({"setting": i, "shift": kind, "magnitude": magnitude, "status": "skipped", "reason": str(error)})
            continue
        gone = sorted(set(backtest.columns) - set(part.columns))
        part = part.withColumn("setting", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        notes.append({"setting": i, "shift": kind, "magnitude": magnitude, "status": "ok",
                      "removed": [c for c in gone], "applicable": not set(gone) & set(schema.flow_features(backtest))})
    if out is None:
        raise ValueError("no shift applies to this dataset")
    return out, notes


def shift_drift(bench: Bench, shifted: DataFrame, features: Sequence[str], settings: drift.DriftSettings,
                copies: int) -> DataFrame:
    """Drift rows of every setting at once; the reference is prepared a single time.

    Window numbers are offset by the setting, so settings are just more windows. Each
    setting anchors its windows on its own first row.
    """
    plan = plan_windows(bench.period("backtest"), settings.window, settings.stride)
    origins = shifted.groupBy("setting").agg(F.min(micros(F.col(TIME))).alias("_origin"))
    placed = assign_windows(shifted.join(F.broadcast(origins), "setting"), plan, origin=F.col("_origin"))
    # One more than the last window of any setting, measured, so that numbers never collide.
    span = (placed.agg(F.max("k")).first()[0] or 0) + 1
    placed = placed.withColumn("k", F.col("setting").cast("long") * F.lit(span) + F.col("k")).drop("_origin")
    stats, cusum, rows = drift.compare_windows(bench.period("train"), placed, plan, features, settings, copies)
    events = drift.emit_events(stats, cusum, rows, settings)
    return events.withColumn("setting", F.expr(f"k div {span}").cast("int"))


def shift_study(bench: Bench, model: str, keys: Sequence[str], drift_settings: drift.DriftSettings,
                settings: Sequence[tuple[str, float]] | None = None, window_us: int | None = None) -> DataFrame:
    """One row per shift setting: clean and shifted metrics, drift, measured effect, best adaptation.

    Adaptation may use the rows before the evaluated period, so the adapted models are the
    same for all settings and are fitted once.
    """
    settings = list(settings or shifts.catalogue())
    spark = bench.data.sparkSession
    run = run_model(bench, model)
    clean = {r.period: r for r in run.metrics.collect()}["backtest"]
    clean_scores = run.predictions.where(F.col("period") == "backtest")
    clean_cal = metrics.calibration(clean_scores).drop("curve").first()

    shifted, notes = shifted_tables(bench, keys, settings)
    ok = [n for n in notes if n["status"] == "ok"]
    runnable = [n["setting"] for n in ok if n["applicable"]]
    scorable = shifted.where(F.col("setting").isin(runnable))

    history = recent_history(bench, window_us, before="backtest")
    recent = bench.fit(model, history)
    combined = bench.fit(model, bench.period("train").unionByName(history))
    candidates = [("none", run.model, run.threshold)]
    for name, fitted in (("threshold_recalibration", run.model), ("recent_window_retrain", recent),
                         ("historical_plus_recent_retrain", combined)):
        candidates.append((name, fitted, metrics.threshold_for_budget(score_table(fitted, history), bench.budget)))
    predicted = None
    for name, fitted, limit in candidates:
        part = metrics.predictions(score_table(fitted, scorable, ("setting",)), limit, label="y_true",
                                   score="y_score", keep=["setting"]).withColumn("strategy", F.lit(name))
        predicted = part if predicted is None else predicted.unionByName(part)

    table = metrics.confusion(predicted, ["setting", "strategy"])
    none = table.where(F.col("strategy") == "none").select(
        "setting", *[F.col(c).alias(f"shifted_{s}") for c, s in (
            ("f1", "f1"), ("precision", "precision"), ("recall", "recall"), ("false_positive_rate", "fpr"))])
    best = audit.best_rows(table, ["setting"], "f1", ["strategy", "false_positive_rate"]).select(
        "setting", F.col("strategy").alias("adapt_strategy"), F.col("f1").alias("adapt_f1"),
        F.col("false_positive_rate").alias("adapt_fpr"))
    cal = metrics.calibration(predicted.where(F.col("strategy") == "none"), ["setting"]).select(
        "setting", F.col("brier").alias("shifted_brier"), F.col("ece").alias("shifted_ece"))

    features = drift.resolve_features(bench.period("train"), shifted, drift_settings.features)
    events = shift_drift(bench, shifted, features, drift_settings, len(ok))
    alerts = events.groupBy("setting").agg(
        F.count_if("alert").alias("drift_alerts"), F.count("*").alias("drift_comparisons"),
        F.max(F.struct("effect_size", "feature"))["feature"].alias("strongest_drift_feature"))

    before = bench.period("backtest")
    moves = realized.numeric_moves(before, shifted, schema.flow_features(before, "number"), ["setting"])
    mixtures = None
    for c in schema.flow_features(before, "name"):
        part = realized.mixture_distance(before, shifted.where(F.col(c).isNotNull()), c, ["setting"]).select("setting", "tvd")
        mixtures = part if mixtures is None else mixtures.unionByName(part)
    measured = realized.verdict(moves, mixtures, realized.class_rates(before, shifted, ["setting"]), ["setting"]).select(
        "setting", F.col("rows_after").alias("row_count"), F.col("attack_rate_after").alias("attack_rate"),
        F.round("max_abs_cohens_d", 6).alias("realized_max_abs_cohens_d"),
        F.round("mean_abs_cohens_d", 6).alias("realized_mean_abs_cohens_d"),
        F.round("max_categorical_tvd", 6).alias("realized_max_categorical_tvd"), "verified")

    named = spark.createDataFrame(
        [(n["setting"], n["shift"], float(n["magnitude"]), n["status"], n.get("reason"), bool(n.get("applicable")),
          n.get("removed", [])) for n in notes],
        "setting int, shift string, magnitude double, status string, reason string, model_applicable boolean, columns_removed array<string>")
    out = named
    for part in (measured, none, cal, alerts, best):
        out = out.join(part, "setting", "left")
    return out.select(
        F.lit(model).alias("model"), "shift", "magnitude", "status", "reason", "row_count", "attack_rate",
        F.lit(run.threshold).alias("threshold"), "model_applicable",
        F.lit(clean.f1).alias("clean_f1"), "shifted_f1", (F.lit(clean.f1) - F.col("shifted_f1")).alias("f1_degradation"),
        (F.lit(clean.recall) - F.col("shifted_recall")).alias("recall_degradation"),
        (F.col("shifted_fpr") - F.lit(clean.false_positive_rate)).alias("fpr_increase"),
        F.when(F.lit(clean.f1) != 0, (F.col("shifted_f1") - F.lit(clean.f1)) / F.lit(clean.f1)).alias("f1_relative_change"),
        F.lit(clean.precision).alias("clean_precision"), "shifted_precision", F.lit(clean.recall).alias("clean_recall"),
        "shifted_recall", F.lit(clean.false_positive_rate).alias("clean_fpr"), "shifted_fpr",
        F.lit(clean_cal.brier).alias("clean_brier"), F.lit(clean_cal.ece).alias("clean_ece"), "shifted_brier", "shifted_ece",
        "drift_alerts", "drift_comparisons", (F.col("drift_alerts") / F.col("drift_comparisons")).alias("drift_alert_rate"),
        (F.col("drift_alerts") > 0).alias("detected_drift"), "strongest_drift_feature",
        "realized_max_abs_cohens_d", "realized_mean_abs_cohens_d", "realized_max_categorical_tvd",
        (F.col("verified") | (F.size("columns_removed") > 0)).alias("realized_verified"), "columns_removed",
        "adapt_strategy", "adapt_f1", "adapt_fpr", (F.col("adapt_f1") - F.col("shifted_f1")).alias("adapt_recovery"),
        F.when(F.lit(clean.f1) != F.col("shifted_f1"), 100.0 * (F.col("adapt_f1") - F.col("shifted_f1"))
               / (F.lit(clean.f1) - F.col("shifted_f1"))).alias("adapt_recovery_pct"))


