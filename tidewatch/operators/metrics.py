"""Classification metrics, operating points, calibration and per-bucket degradation.

Inputs are score tables: y_true (0/1), y_score and, once a threshold is applied, y_pred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import ratio
from tidewatch.operators.combine import fixed_rows, with_each, with_row
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.running import cut_slices, running_sums
from tidewatch.operators.windows import HOUR, bucket
from tidewatch.schema import TIME

RATES = ["precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "balanced_accuracy"]
COMPARED = [*RATES, "pr_auc", "roc_auc"]


def predictions(scores: DataFrame, threshold: Column | float, ts: str = TIME, label: str = "label",
                score: str = "score", keep: Sequence[str] = ()) -> DataFrame:
    """Row-level predictions with their error flags."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col(score) >= limit
    return scores.select(
        *keep, F.col(ts).alias("timestamp"), F.col(label).cast("int").alias("y_true"),
        F.col(score).cast("double").alias("y_score"), hit.cast("int").alias("y_pred"),
        (hit & (F.col(label) == 0)).cast("int").alias("false_positive"),
        (~hit & (F.col(label) == 1)).cast("int").alias("false_negative"))


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates that follow from them; empty denominators give 0."""
    y, p = F.col("y_true"), F.col("y_pred")
    counts = predicted.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("true_positives"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((y == 1) & (p == 0)).alias("false_negatives"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # A class without rows is left out of the balanced accuracy.
    balanced = (F.when((tp + fn) == 0, specificity).when((tn + fp) == 0, recall)
                .otherwise((recall + specificity) / 2.0))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": recall, "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
        "balanced_accuracy": balanced,
        "row_count": tp + fp + tn + fn, "attacks": tp + fn})


def static_metrics(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fixed-threshold metrics of a static test set, with both class rates and counts."""
    base = confusion(predicted, by)
    return base.withColumns({
        "true_positive_rate": F.col("recall"),
        "true_negative_rate": ratio(F.col("true_negatives"), F.col("true_negatives") + F.col("false_positives")),
        "confusion_matrix": F.array(F.array("true_negatives", "false_positives"),
                                    F.array("false_negatives", "true_positives")),
        "n_normal": F.col("row_count") - F.col("attacks"), "n_anomaly": F.col("attacks"),
    }).withColumnsRenamed({"f1": "f1_score", "row_count": "n_samples"}).drop("attacks", "balanced_accuracy")


def ranking(scores: DataFrame, by: Sequence[str] = (), label: str = "y_true", score: str = "y_score",
            expected_rows: int | None = None) -> DataFrame:
    """ROC AUC and average precision, null where only one class is present.

    Rows collapse to one per distinct score first; running counts over the scores then
    give both areas exactly (ties count half, precision is a step function).
    """
    if expected_rows is None:
        expected_rows = scores.count()
    keys = list(by) or ["_all"]
    frame = scores if by else scores.withColumn("_all", F.lit(0))
    counts = frame.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = counts.withColumn("_down", -F.col(score))
    sliced, slices = cut_slices(counts, [*keys, "_down"], expected_rows)
    run = running_sums(sliced, keys, ["_down"], {"tp": "pos", "fp": "neg"}, {"p": "pos", "n": "neg"}, slices)
    below = F.col("n") - F.col("fp")
    auc = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0)) / (F.first("p").cast("double") * F.first("n").cast("double"))
    step = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("p")
    both = (F.first("p") > 0) & (F.first("n") > 0)
    out = run.groupBy(*keys).agg(F.when(both, auc).alias("roc_auc"), F.when(both, step).alias("pr_auc"))
    return out if by else out.drop("_all")


def budget_thresholds(scores: DataFrame, budgets: Sequence[float], by: Sequence[str] = (),
                      label: str = "y_true", score: str = "y_score",
                      expected_rows: int | None = None) -> DataFrame:
    """(by, target_fpr, threshold): the score quantile of the negatives that meets each budget.

    A group without negatives gets 0.5.
    """
    if expected_rows is None:
        expected_rows = scores.count()
    keys = list(by) or ["_all"]
    frame = scores if by else scores.withColumn("_all", F.lit(0))
    negatives = frame.where(F.col(label) == 0)
    found = exact_quantiles(negatives, keys, score, [1.0 - float(b) for b in budgets], expected_rows)
    wanted = fixed_rows(["target_fpr", "p"], [(float(b), 1.0 - float(b)) for b in budgets])
    groups = frame.select(*keys).distinct().select(*keys, F.inline(wanted))
    out = groups.join(found, [*keys, "p"], "left").select(
        *keys, "target_fpr", F.coalesce("q", F.lit(0.5)).alias("threshold"))
    return out if by else out.drop("_all")


def threshold_for_budget(scores: DataFrame, budget: float = 0.05, label: str = "y_true",
                         score: str = "y_score") -> float:
    """The threshold as a number, for use as a literal in later plans."""
    return budget_thresholds(scores, [budget], label=label, score=score).first().threshold


def budget_sweep(scores: DataFrame, budgets: Sequence[float] = (0.01, 0.02, 0.05, 0.10, 0.20),
                 fit_on: DataFrame | None = None) -> DataFrame:
    """Metrics at every false-positive budget from one pass over the scores.

    Thresholds come from ``fit_on``; by default from the evaluated rows themselves, which
    is an oracle threshold.
    """
    limits = budget_thresholds(scores if fit_on is None else fit_on, budgets).collect()
    y = F.col("y_true")
    counts = {}
    for i, r in enumerate(limits):
        hit = F.col("y_score") >= F.lit(r.threshold)
        counts.update({f"tp{i}": F.count_if((y == 1) & hit), f"fp{i}": F.count_if((y == 0) & hit),
                       f"tn{i}": F.count_if((y == 0) & ~hit), f"fn{i}": F.count_if((y == 1) & ~hit)})
    one = scores.agg(*[c.alias(n) for n, c in counts.items()])
    rows = [F.struct(F.lit(r.target_fpr).alias("target_fpr"), F.lit(r.threshold).alias("threshold"),
                     F.col(f"tp{i}").alias("true_positives"), F.col(f"fp{i}").alias("false_positives"),
                     F.col(f"tn{i}").alias("true_negatives"), F.col(f"fn{i}").alias("false_negatives"))
            for i, r in enumerate(limits)]
    return with_rates(one.select(F.inline(F.array(*rows)))).withColumnRenamed("false_positive_rate", "achieved_fpr")


def score_bin(score: str, bins: int):
    return F.least(F.greatest(F.floor(F.col(score) * F.lit(float(bins))), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability(scores: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Reliability table: every bin, empty ones with nulls."""
    filled = scores.groupBy(*by, score_bin("y_score", bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("y_score").alias("mean_pred"), F.avg("y_true").alias("observed"))
    grid = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = with_each(filled.select(*by).distinct(), "bin", range(bins), "int")
    return grid.join(filled, [*by, "bin"], "left").na.fill(0, ["n"])


def calibration(scores: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error and the reliability curve, one pass."""
    per_bin = scores.groupBy(*by, score_bin("y_score", bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("y_score").alias("mean_pred"), F.avg("y_true").alias("observed"),
        F.sum(F.pow(F.col("y_score") - F.col("y_true"), 2)).alias("_se"))
    gap = F.col("n") * F.abs(F.col("mean_pred") - F.col("observed"))
    points = F.array_sort(F.collect_list(F.struct("bin", "n", "mean_pred", "observed")))
    one = per_bin.groupBy(*by).agg(
        (F.sum("_se") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"), points.alias("_points"))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean_pred"),
                     F.lit(None).cast("double").alias("observed"))

    def slot(b):
        hit = F.filter("_points", lambda x: x["bin"] == b)
        found = F.get(hit, F.lit(0))
        return F.struct(b.alias("bin"), F.coalesce(found["n"], empty["n"]).alias("n"),
                        found["mean_pred"].alias("mean_pred"), found["observed"].alias("observed"))

    curve = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), slot)
    return one.withColumn("curve", curve).drop("_points")


def calibration_change(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = list(by)
    old = before.select(*keys, F.col("brier").alias("brier_backtest"), F.col("ece").alias("ece_backtest"))
    new = after.select(*keys, F.col("brier").alias("brier_forward"), F.col("ece").alias("ece_forward"))
    joined = old.join(new, keys) if keys else with_row(old, new)
    return joined.withColumns({"brier_change": F.col("brier_forward") - F.col("brier_backtest"),
                               "ece_change": F.col("ece_forward") - F.col("ece_backtest")})


def degradation(metrics: DataFrame, by: Sequence[str], columns: Sequence[str] = COMPARED,
                period: str = "period") -> DataFrame:
    """Change and relative change from the backtest row to the forward row of each model."""
    present = [c for c in columns if c in metrics.columns]
    sides = metrics.where(F.col(period).isin("backtest", "forward")).groupBy(*by)
    pick = {}
    for c in present:
        pick[f"_a_{c}"] = F.max(F.when(F.col(period) == "backtest", F.col(c)))
        pick[f"_b_{c}"] = F.max(F.when(F.col(period) == "forward", F.col(c)))
    wide = sides.agg(*[v.alias(k) for k, v in pick.items()])
    out = {}
    for c in present:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        out[f"{c}_change"] = b - a
        out[f"{c}_relative_change"] = F.when(a != 0, (b - a) / a)
    if {"f1", "recall", "false_positive_rate"} <= set(present):
        out["f1_degradation"] = F.col("_a_f1") - F.col("_b_f1")
        out["recall_degradation"] = F.col("_a_recall") - F.col("_b_recall")
        out["fpr_increase"] = F.col("_b_false_positive_rate") - F.col("_a_false_positive_rate")
    return wide.withColumns(out).select(*by, *out)


def window_metrics(predicted: DataFrame, size_us: int = 6 * HOUR, min_rows: int = 0,
                   by: Sequence[str] = ()) -> DataFrame:
    """Per time bucket: rows, attack rate, recall and FPR (null where a class is absent), errors."""
    y, p = F.col("y_true"), F.col("y_pred")
    out = predicted.groupBy(*by, bucket(F.col("timestamp"), size_us).alias("bucket")).agg(
        F.count("*").alias("row_count"), F.sum("y_true").cast("long").alias("attacks"),
        F.avg("y_true").alias("attack_rate"),
        F.try_divide(F.count_if((y == 1) & (p == 1)), F.count_if(y == 1)).alias("recall"),
        F.try_divide(F.count_if((y == 0) & (p == 1)), F.count_if(y == 0)).alias("fpr"),
        F.avg("y_score").alias("mean_score"),
        F.sum("false_positive").cast("long").alias("false_positives"),
        F.sum("false_negative").cast("long").alias("false_negatives"))
    return out.where(F.col("row_count") >= min_rows) if min_rows else out


def class_timeline(predicted: DataFrame, size_us: int = 12 * HOUR) -> DataFrame:
    return predicted.groupBy(bucket(F.col("timestamp"), size_us).alias("bucket")).agg(
        F.avg("y_true").alias("rate"), F.count("*").alias("n"))
