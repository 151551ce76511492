"""Failure analysis of scored rows against windows and drift alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import from_micros, micros
from tidewatch.operators.combine import with_row
from tidewatch.operators.metrics import window_metrics
from tidewatch.operators.running import cut_slices, last_seen
from tidewatch.operators.summaries import strongest_features
from tidewatch.operators.windows import HOUR, bucket
from tidewatch.session import rows_per_slice

DAY = 24 * HOUR


def worst_windows(windows: DataFrame, baseline_recall: float, baseline_fpr: float, k: int = 5) -> DataFrame:
    """The k windows of lowest recall and of highest FPR, with their distance to the backtest."""
    def side(metric, order, baseline):
        picked = windows.where(F.col(metric).isNotNull()).orderBy(order, "bucket").limit(k)
        return picked.select(F.lit(metric).alias("metric"), F.col("bucket").alias("window"),
                             F.col(metric).alias("value"), F.lit(float(baseline)).alias("backtest_value"),
                             (F.col(metric) - F.lit(float(baseline))).alias("delta"))
    return side("recall", F.col("recall").asc(), baseline_recall).unionByName(
        side("fpr", F.col("fpr").desc(), baseline_fpr))


def error_profile(predicted: DataFrame, kind: str = "false_positive", by: Sequence[str] = (),
                  k: int = 5, confident: float = 0.8) -> DataFrame:
    """Count, rate and mean score of one kind of error, and the six-hour buckets it fills.

    Errors are counted per bucket first, so the ranking sorts buckets and not rows.
    """
    err = F.col(kind) == 1
    per_bucket = predicted.groupBy(*by, bucket(F.col("timestamp"), 6 * HOUR).alias("window")).agg(
        F.count("*").alias("_rows"), F.count_if(err).alias("errors"),
        F.sum(F.when(err, F.col("y_score"))).alias("_score"),
        F.count_if(err & (F.col("y_score") > confident)).alias("_confident"))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("errors").desc(), "window"))
    ranked = per_bucket.withColumn("_rank", rank)
    worst = F.transform(
        F.array_sort(F.collect_list(F.when((F.col("_rank") <= k) & (F.col("errors") > 0),
                                           F.struct("_rank", "window", "errors")))),
        lambda x: F.struct(x["window"].alias("window"), x["errors"].alias("errors")))
    out = ranked.groupBy(*by).agg(
        F.sum("errors").alias("count"), (F.sum("errors") / F.sum("_rows")).alias("rate"),
        F.coalesce(F.sum("_score") / F.nullif(F.sum("errors"), F.lit(0)), F.lit(0.0)).alias("mean_score"),
        F.sum("_confident").alias("high_confidence_misses"), worst.alias("worst_windows"))
    return out.drop("high_confidence_misses") if kind == "false_positive" else out


def worst_error_buckets(predicted: DataFrame, kind: str = "false_positive", k: int = 5) -> DataFrame:
    """The k six-hour buckets holding most errors of one kind, as rows."""
    return (predicted.where(F.col(kind) == 1)
            .groupBy(bucket(F.col("timestamp"), 6 * HOUR).alias("window")).agg(F.count("*").alias("errors"))
            .orderBy(F.col("errors").desc(), "window").limit(k))


def confident_errors(predicted: DataFrame, threshold: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    sure = F.col("y_score") >= threshold
    wrong = sure & (F.col("y_pred") != F.col("y_true"))
    return predicted.groupBy(*by).agg(
        F.count_if(sure).alias("confident_predictions"), F.count_if(wrong).alias("wrong"),
        F.coalesce(F.try_divide(F.count_if(wrong), F.count_if(sure)), F.lit(0.0)).alias("error_rate_among_confident"),
    ).withColumn("confidence_threshold", F.lit(float(threshold)))


def drift_lead(events: DataFrame, windows: DataFrame, baseline_recall: float | None = None,
               margin: float = 0.05) -> DataFrame:
    """First alert against first degraded window; a positive lag means drift showed first.

    Degraded means recall below the backtest by more than ``margin``. Without a baseline
    the first window that has a recall at all is taken.
    """
    first_alert = events.agg(F.min(F.when(F.col("alert"), F.col("window_start"))).alias("first_alert"))
    bad = F.col("recall").isNotNull()
    if baseline_recall is not None:
        bad = bad & (F.col("recall") < F.lit(baseline_recall - margin))
    first_bad = windows.agg(F.min(F.when(bad, F.col("bucket"))).alias("first_degraded_window"))
    both = with_row(first_alert, first_bad)
    return both.withColumns({
        "drift_precedes_degradation": F.col("first_alert") <= F.col("first_degraded_window"),
        "lag_seconds": (micros(F.col("first_degraded_window")) - micros(F.col("first_alert"))) / 1e6})


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: Sequence[str],
         by: Sequence[str] = (), tolerance_us: int | None = None, expected_rows: int | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it.

    One union and one running "last value" replace the range join. Each group and time of the left side is
    looked up once, whatever its rows hold, and rows take the match by an equality join. What is looked up is counted
    unless ``expected_rows`` (both sides together) says that it is small; large inputs are cut along time, side and a row
    hash, so that even one hot timestamp spreads over slices.
    """
    keys = list(by) or ["_all"]
    payload = F.struct(F.col(right_ts).alias("_at"), *columns)
    rest = [c for c in left.columns if c not in by]
    if not by:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    lows = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"))
    highs = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side")).distinct()
    union = lows.unionByName(highs, allowMissingColumns=True)
    if expected_rows is None or expected_rows > rows_per_slice(left.sparkSession):
        expected_rows = union.count()
    # At one time all right rows come before the left one.
    spread = union.withColumn("_h", F.xxhash64("_r"))
    both, slices = cut_slices(spread, [*keys, "_t", "_side", "_h"], expected_rows)
    found = last_seen(both, keys, ["_t", "_side"], F.col("_r"), "_m", slices).where(F.col("_side") == 1)
    if tolerance_us is not None:
        near = micros(F.col("_t")) - micros(F.col("_m._at")) <= tolerance_us
        found = found.withColumn("_m", F.when(near, F.col("_m")))
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t", "_m")
    same = F.col(left_ts).eqNullSafe(F.col("_t"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(found, same, "left").select(*by, *rest, F.col("_m._at").alias(f"matched_{right_ts}"),
                                                 *[F.col(f"_m.{c}").alias(c) for c in columns])


def alert_midpoints(events: DataFrame) -> DataFrame:
    """One row per alerting window with its midpoint."""
    flagged = events.where("alert").groupBy("window_start").agg(F.min("window_end").alias("window_end"))
    start, end = micros(F.col("window_start")), micros(F.col("window_end"))
    return flagged.withColumn("midpoint", from_micros(start + F.floor((end - start) / 2)))


def alerts_without_degradation(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Alerting windows that fall on degraded (recall < 0.5), sound or no model windows."""
    usable = windows.where(F.col("bucket").isNotNull() & F.col("recall").isNotNull())
    matched = asof(alert_midpoints(events), usable, "midpoint", "bucket", ["recall"], tolerance_us=DAY)
    counts = matched.agg(
        F.count("*").alias("alerts"),
        F.count_if(F.col("recall") < 0.5).alias("in_degraded_windows"),
        F.count_if(F.col("recall") >= 0.5).alias("without_degradation"),
        F.count_if(F.col("recall").isNull()).alias("unmatched_alerts"))
    sizes = usable.agg(F.count("*").alias("model_windows"),
                       F.count_if(F.col("recall") < 0.5).alias("degraded_windows"))
    return with_row(counts, sizes).withColumn("matched", F.col("unmatched_alerts") < F.col("alerts"))


def failure_bundle(predicted: DataFrame, events: DataFrame, baseline_recall: float, baseline_fpr: float,
                   size_us: int = 6 * HOUR, min_rows: int = 50) -> DataFrame:
    """The whole failure analysis of one model as a single nested row."""
    windows = window_metrics(predicted, size_us, min_rows)

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    def many(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))

    out = windows.agg(F.count("*").alias("windows_analyzed"))
    for part in (many(worst_windows(windows, baseline_recall, baseline_fpr), "largest_degradation_windows"),
                 many(strongest_features(events), "strongest_drift_features"),
                 one(error_profile(predicted, "false_positive"), "false_positives"),
                 one(error_profile(predicted, "false_negative"), "false_negatives"),
                 one(confident_errors(predicted), "high_confidence_errors"),
                 one(drift_lead(events, windows, baseline_recall), "drift_vs_degradation"),
                 one(alerts_without_degradation(events, windows), "alerts_without_degradation")):
        out = with_row(out, part)
    return out
