"""Metrics, thresholds, calibration and failure analysis on the event scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.operators import audit, failure, metrics, split
from tidewatch.operators.windows import HOUR
from tidewatch.queries.base import FE, cuts_sql, query
from tidewatch.queries.drift_queries import EVENTS, BASE, PSI, QUANTILES, TWO_SAMPLE, CUSUM, events
from tidewatch.sources import views
from tidewatch.streaming import monitor

RATES = metrics.RATES


def scored(spark, folder):
    """Scores of every event with its period."""
    df = views.event_flows(spark, folder)
    labelled = split.find_cuts(df).label(df)
    return labelled.select("event_id", "timestamp", "period", "protocol", F.col("label").alias("y_true"),
                           F.col("score").alias("y_score"))


def predicted(spark, folder):
    """Predictions at the 5 % false-positive threshold of the validation period."""
    rows = scored(spark, folder)
    limit = metrics.threshold_for_budget(rows.where("period = 'validation'"))
    return metrics.predictions(rows, limit, label="y_true", score="y_score",
                               keep=["event_id", "period", "protocol"])


SCORED = f"""{FE}, {cuts_sql('fe')}, sc AS (SELECT event_id, timestamp, period, protocol, label AS y_true, score AS y_score FROM sp)"""


def quantile_sql(source: str, out: str, keys: str, value: str, p: str, where: str) -> str:
    return f"""{out}_r AS (SELECT {keys} {value} AS v, row_number() OVER (PARTITION BY {keys} 1 ORDER BY {value}) - 1 AS i,
  count(*) OVER (PARTITION BY {keys} 1) AS n FROM {source} WHERE {where}),
{out} AS (SELECT {keys} CASE WHEN any_value((n - 1) * {p} - floor((n - 1) * {p})) >= 0.5
  THEN max(CASE WHEN i = ceil((n - 1) * {p}) THEN v END) - (max(CASE WHEN i = ceil((n - 1) * {p}) THEN v END) - max(CASE WHEN i = floor((n - 1) * {p}) THEN v END)) * (1 - any_value((n - 1) * {p} - floor((n - 1) * {p})))
  ELSE max(CASE WHEN i = floor((n - 1) * {p}) THEN v END) + (max(CASE WHEN i = ceil((n - 1) * {p}) THEN v END) - max(CASE WHEN i = floor((n - 1) * {p}) THEN v END)) * any_value((n - 1) * {p} - floor((n - 1) * {p})) END AS q
  FROM {out}_r {'GROUP BY ' + keys.rstrip(', ') if keys else ''})"""


THRESHOLD = quantile_sql("sc", "th", "", "y_score", "CAST(0.95 AS DOUBLE)", "period = 'validation' AND y_true = 0")
PRED = f"""{SCORED}, {THRESHOLD},
pr AS (SELECT event_id, timestamp, period, protocol, y_true, y_score, CAST(y_score >= q AS INTEGER) AS y_pred,
  CAST(y_score >= q AND y_true = 0 AS INTEGER) AS false_positive, CAST(y_score < q AND y_true = 1 AS INTEGER) AS false_negative FROM sc, th)"""


def rates_sql(source: str, keys: str = "", where: str = "TRUE") -> str:
    """Confusion counts and rates of a prediction table."""
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    return f"""(SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
  coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1, coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS false_positive_rate,
  coalesce(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 0) AS false_negative_rate,
  (coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) + coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0)) / 2 AS balanced_accuracy
  FROM (SELECT {pick} CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS BIGINT) AS fn
    FROM {source} WHERE {where} {group}))"""


_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in RATES)


def _rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("predictions", f"WITH {PRED} SELECT event_id, timestamp, y_true, y_score, y_pred, false_positive, false_negative FROM pr WHERE period = 'forward'")
def predictions(spark, folder):
    return predicted(spark, folder).where("period = 'forward'").drop("period", "protocol")


@query("confusion_metrics", f"""WITH {PRED} SELECT period, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, {_ROUNDED},
tp + fp + tn + fn AS row_count, tp + fn AS attacks FROM {rates_sql('pr', 'period')}""")
def confusion_metrics(spark, folder):
    return _rounded(metrics.confusion(predicted(spark, folder), ["period"]), RATES)


@query("static_metrics", f"""WITH {PRED} SELECT protocol, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1_score, round(false_positive_rate, 9) AS false_positive_rate,
round(false_negative_rate, 9) AS false_negative_rate, round(recall, 9) AS true_positive_rate, round(tn / CAST(tn + fp AS DOUBLE), 9) AS true_negative_rate,
tp + fp + tn + fn AS n_samples, tn + fp AS n_normal, tp + fn AS n_anomaly,
'[[' || CAST(tn AS BIGINT) || ',' || CAST(fp AS BIGINT) || '],[' || CAST(fn AS BIGINT) || ',' || CAST(tp AS BIGINT) || ']]' AS confusion_matrix FROM {rates_sql('pr', 'protocol')}""")
def static_metrics(spark, folder):
    out = metrics.static_metrics(predicted(spark, folder), ["protocol"]).withColumn("confusion_matrix", F.to_json("confusion_matrix"))
    return _rounded(out, ["precision", "recall", "f1_score", "false_positive_rate", "false_negative_rate",
                          "true_positive_rate", "true_negative_rate"])


_RANK = f"""g AS (SELECT period, y_score AS s, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM sc GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY period) AS p, sum(neg) OVER (PARTITION BY period) AS n FROM g
  WINDOW w AS (PARTITION BY period ORDER BY s DESC))"""


@query("roc_auc", f"WITH {SCORED}, {_RANK} SELECT period, round(sum(CAST(pos AS DOUBLE) * (n - fp + neg / 2.0)) / (any_value(p) * CAST(any_value(n) AS DOUBLE)), 9) AS roc_auc FROM c GROUP BY period")
def roc_auc(spark, folder):
    return metrics.ranking(scored(spark, folder), ["period"]).select("period", F.round("roc_auc", 9).alias("roc_auc"))


@query("average_precision", f"WITH {SCORED}, {_RANK} SELECT period, round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / any_value(p), 9) AS pr_auc FROM c GROUP BY period")
def average_precision(spark, folder):
    return metrics.ranking(scored(spark, folder), ["period"]).select("period", F.round("pr_auc", 9).alias("pr_auc"))


@query("threshold_for_budget", f"WITH {SCORED}, {quantile_sql('sc', 'th', 'period, ', 'y_score', 'CAST(0.95 AS DOUBLE)', 'y_true = 0')} SELECT period, round(q, 9) AS threshold FROM th")
def threshold_for_budget(spark, folder):
    found = metrics.budget_thresholds(scored(spark, folder), [0.05], ["period"])
    return found.select("period", F.round("threshold", 9).alias("threshold"))


_BUDGETS = (0.01, 0.02, 0.05, 0.10, 0.20)


@query("fpr_budget_sweep", f"WITH {SCORED}, f AS (SELECT * FROM sc WHERE period = 'forward'), " + ", ".join(
    quantile_sql("f", f"q{i}", "", "y_score", f"CAST({1.0 - b!r} AS DOUBLE)", "y_true = 0") for i, b in enumerate(_BUDGETS)) + """,
lim AS (""" + " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS target_fpr, q AS threshold FROM q{i}" for i, b in enumerate(_BUDGETS)) + f"""),
x AS (SELECT target_fpr, threshold, y_true, CAST(y_score >= threshold AS INTEGER) AS y_pred FROM f, lim)
SELECT target_fpr, round(threshold, 9) AS threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall,
round(false_positive_rate, 9) AS achieved_fpr FROM {rates_sql('x', 'target_fpr, threshold')}""")
def fpr_budget_sweep(spark, folder):
    rows = scored(spark, folder).where("period = 'forward'").select("y_true", "y_score")
    return _rounded(metrics.budget_sweep(rows), ["threshold", "f1", "precision", "recall", "achieved_fpr"]).select(
        "target_fpr", "threshold", "f1", "precision", "recall", "achieved_fpr")


_DEG = f"WITH {PRED}, m AS (SELECT * FROM {rates_sql('pr', 'protocol, period')}), a AS (SELECT * FROM m WHERE period = 'backtest'), b AS (SELECT * FROM m WHERE period = 'forward') SELECT a.protocol, " + ", ".join(
    f"round(b.{c} - a.{c}, 9) AS {c}_change, round(CASE WHEN a.{c} <> 0 THEN (b.{c} - a.{c}) / a.{c} END, 9) AS {c}_relative_change" for c in RATES) + """,
round(a.f1 - b.f1, 9) AS f1_degradation, round(a.recall - b.recall, 9) AS recall_degradation, round(b.false_positive_rate - a.false_positive_rate, 9) AS fpr_increase
FROM a JOIN b ON a.protocol = b.protocol"""


@query("degradation", _DEG)
def degradation(spark, folder):
    table = metrics.confusion(predicted(spark, folder), ["protocol", "period"])
    out = metrics.degradation(table, ["protocol"], RATES)
    return _rounded(out, [c for c in out.columns if c != "protocol"])


_CAL = f"""WITH {SCORED}, b AS (SELECT period, CAST(least(floor(y_score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y_score) AS mp, avg(y_true) AS ob,
sum((y_score - y_true) * (y_score - y_true)) AS se FROM sc GROUP BY 1, 2)"""


@query("calibration", _CAL + " SELECT period, round(sum(se) / sum(n), 9) AS brier, round(sum(n * abs(mp - ob)) / sum(n), 9) AS ece FROM b GROUP BY period")
def calibration(spark, folder):
    return _rounded(metrics.calibration(scored(spark, folder), ["period"]).drop("curve"), ["brier", "ece"])


@query("calibration_bins", _CAL + """, g AS (SELECT period, CAST(unnest(range(10)) AS INTEGER) AS bin FROM (SELECT DISTINCT period FROM sc))
SELECT g.period, g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(mp, 9) AS mean_pred, round(ob, 9) AS observed FROM g LEFT JOIN b ON g.period = b.period AND g.bin = b.bin""")
def calibration_bins(spark, folder):
    return _rounded(metrics.reliability(scored(spark, folder), ["period"]), ["mean_pred", "observed"])


@query("calibration_curve", _CAL + """, g AS (SELECT period, CAST(unnest(range(10)) AS INTEGER) AS bin FROM (SELECT DISTINCT period FROM sc))
SELECT g.period, g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN b ON g.period = b.period AND g.bin = b.bin""")
def calibration_curve(spark, folder):
    """The nested curve of the calibration row, flattened again."""
    nested = metrics.calibration(scored(spark, folder), ["period"])
    return nested.select("period", F.inline("curve")).select("period", "bin", "n")


@query("calibration_change", f"WITH {SCORED}, b AS (SELECT protocol, period, CAST(least(floor(y_score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y_score) AS mp, avg(y_true) AS ob, sum((y_score - y_true) * (y_score - y_true)) AS se FROM sc GROUP BY 1, 2, 3), c AS (SELECT protocol, period, sum(se) / sum(n) AS brier, sum(n * abs(mp - ob)) / sum(n) AS ece FROM b GROUP BY 1, 2) SELECT x.protocol, round(x.brier, 9) AS brier_backtest, round(y.brier, 9) AS brier_forward, round(y.brier - x.brier, 9) AS brier_change, round(x.ece, 9) AS ece_backtest, round(y.ece, 9) AS ece_forward, round(y.ece - x.ece, 9) AS ece_change FROM c x JOIN c y ON x.protocol = y.protocol WHERE x.period = 'backtest' AND y.period = 'forward'")
def calibration_change(spark, folder):
    table = metrics.calibration(scored(spark, folder), ["protocol", "period"]).drop("curve")
    out = metrics.calibration_change(table.where("period = 'backtest'"), table.where("period = 'forward'"), ["protocol"])
    return _rounded(out, [c for c in out.columns if c != "protocol"])


_WM = """wm AS (SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS bucket, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(y_true) AS BIGINT) AS attacks,
avg(y_true) AS attack_rate, count(*) FILTER (y_true = 1 AND y_pred = 1) / CAST(nullif(count(*) FILTER (y_true = 1), 0) AS DOUBLE) AS recall,
count(*) FILTER (y_true = 0 AND y_pred = 1) / CAST(nullif(count(*) FILTER (y_true = 0), 0) AS DOUBLE) AS fpr, avg(y_score) AS mean_score,
CAST(sum(false_positive) AS BIGINT) AS false_positives, CAST(sum(false_negative) AS BIGINT) AS false_negatives FROM pr WHERE period = 'forward' GROUP BY 1)"""
_WM_OUT = "bucket, row_count, attacks, round(attack_rate, 9) AS attack_rate, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(mean_score, 9) AS mean_score, false_positives, false_negatives"


def forward(spark, folder):
    return predicted(spark, folder).where("period = 'forward'")


@query("window_metrics", f"WITH {PRED}, {_WM} SELECT {_WM_OUT} FROM wm")
def window_metrics(spark, folder):
    return _rounded(metrics.window_metrics(forward(spark, folder)), ["attack_rate", "recall", "fpr", "mean_score"])


@query("degradation_windows", f"WITH {PRED}, {_WM} SELECT {_WM_OUT} FROM wm WHERE row_count >= 50")
def degradation_windows(spark, folder):
    return _rounded(metrics.window_metrics(forward(spark, folder), min_rows=50),
                    ["attack_rate", "recall", "fpr", "mean_score"])


@query("class_timeline", f"WITH {PRED} SELECT time_bucket(INTERVAL 12 HOUR, timestamp, TIMESTAMP '1970-01-01') AS bucket, round(avg(y_true), 9) AS rate, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY 1")
def class_timeline(spark, folder):
    return _rounded(metrics.class_timeline(predicted(spark, folder)), ["rate"])


@query("worst_windows", f"""WITH {PRED}, {_WM}, w AS (SELECT * FROM wm WHERE row_count >= 50)
SELECT * FROM (SELECT 'recall' AS metric, bucket AS "window", round(recall, 9) AS value, 0.05 AS backtest_value, round(recall - 0.05, 9) AS delta FROM w WHERE recall IS NOT NULL ORDER BY recall, bucket LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'fpr', bucket, round(fpr, 9), 0.05, round(fpr - 0.05, 9) FROM w WHERE fpr IS NOT NULL ORDER BY fpr DESC, bucket LIMIT 5)""")
def worst_windows(spark, folder):
    table = metrics.window_metrics(forward(spark, folder), min_rows=50)
    return _rounded(failure.worst_windows(table, 0.05, 0.05), ["value", "delta"])


def _profile_sql(kind, extra=""):
    return f"""WITH {PRED} SELECT CAST(sum({kind}) AS BIGINT) AS "count", round(avg({kind}), 9) AS rate,
round(coalesce(avg(CASE WHEN {kind} = 1 THEN y_score END), 0), 9) AS mean_score{extra} FROM pr WHERE period = 'forward'"""


@query("false_positive_profile", _profile_sql("false_positive"))
def false_positive_profile(spark, folder):
    return _rounded(failure.error_profile(forward(spark, folder)).drop("worst_windows"), ["rate", "mean_score"])


@query("false_negative_profile", _profile_sql("false_negative", ", CAST(count(*) FILTER (false_negative = 1 AND y_score > 0.8) AS BIGINT) AS high_confidence_misses"))
def false_negative_profile(spark, folder):
    return _rounded(failure.error_profile(forward(spark, folder), "false_negative").drop("worst_windows"),
                    ["rate", "mean_score"])


@query("worst_error_buckets", f"""WITH {PRED} SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS "window", CAST(count(*) AS BIGINT) AS errors
FROM pr WHERE period = 'forward' AND false_negative = 1 GROUP BY 1 ORDER BY errors DESC, 1 LIMIT 5""")
def worst_error_buckets(spark, folder):
    return failure.worst_error_buckets(forward(spark, folder), "false_negative")


@query("worst_buckets_nested", f"""WITH {PRED} SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS "window", CAST(count(*) AS BIGINT) AS errors
FROM pr WHERE period = 'forward' AND false_positive = 1 GROUP BY 1 ORDER BY errors DESC, 1 LIMIT 5""")
def worst_buckets_nested(spark, folder):
    return failure.error_profile(forward(spark, folder)).select(F.inline("worst_windows"))


@query("confident_errors", f"""WITH {PRED} SELECT period, CAST(0.9 AS DOUBLE) AS confidence_threshold, CAST(count(*) FILTER (y_score >= 0.9) AS BIGINT) AS confident_predictions,
CAST(count(*) FILTER (y_score >= 0.9 AND y_pred <> y_true) AS BIGINT) AS wrong,
round(coalesce(count(*) FILTER (y_score >= 0.9 AND y_pred <> y_true) / CAST(nullif(count(*) FILTER (y_score >= 0.9), 0) AS DOUBLE), 0), 9) AS error_rate_among_confident FROM pr GROUP BY period""")
def confident_errors(spark, folder):
    return _rounded(failure.confident_errors(predicted(spark, folder), by=["period"]), ["error_rate_among_confident"])


_EV = f"{BASE}, {TWO_SAMPLE}, {QUANTILES}, {PSI}, {CUSUM}, {EVENTS}, sc AS (SELECT event_id, timestamp, period, protocol, label AS y_true, score AS y_score FROM sp), {THRESHOLD}, " + \
    PRED[PRED.index("pr AS"):] + f", {_WM}, w AS (SELECT * FROM wm WHERE row_count >= 50)"


@query("drift_lead", f"""WITH {_EV}, x AS (SELECT (SELECT min(window_start) FROM ev WHERE alert AND method <> 'cusum') AS first_alert,
(SELECT min(bucket) FROM w WHERE recall IS NOT NULL) AS first_degraded_window)
SELECT *, first_alert <= first_degraded_window AS drift_precedes_degradation, (epoch_us(first_degraded_window) - epoch_us(first_alert)) / 1e6 AS lag_seconds FROM x""")
def drift_lead(spark, folder):
    table = metrics.window_metrics(forward(spark, folder), min_rows=50)
    return failure.drift_lead(events(spark, folder), table)


@query("asof_alerts", f"""WITH {_EV}, a AS (SELECT window_start, min(window_end) AS window_end FROM ev WHERE alert AND method <> 'cusum' GROUP BY 1),
m AS (SELECT window_start, window_end, window_start + to_microseconds(CAST(floor((epoch_us(window_end) - epoch_us(window_start)) / 2) AS BIGINT)) AS midpoint FROM a),
u AS (SELECT * FROM w WHERE recall IS NOT NULL)
SELECT m.*, CASE WHEN epoch_us(midpoint) - epoch_us(bucket) <= 86400000000 THEN bucket END AS matched_bucket,
round(CASE WHEN epoch_us(midpoint) - epoch_us(bucket) <= 86400000000 THEN recall END, 9) AS recall FROM m ASOF LEFT JOIN u ON m.midpoint >= u.bucket""")
def asof_alerts(spark, folder):
    table = metrics.window_metrics(forward(spark, folder), min_rows=50).where("recall IS NOT NULL")
    marks = failure.alert_midpoints(events(spark, folder))
    out = failure.asof(marks, table, "midpoint", "bucket", ["recall"], tolerance_us=24 * HOUR)
    return _rounded(out, ["recall"])


@query("asof_orders", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderdate AS matched_o_orderdate, o_totalprice FROM lineitem l
ASOF LEFT JOIN (SELECT o_custkey % 100 AS grp, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) o
ON l.l_suppkey % 100 = o.grp AND l.l_shipdate >= o.o_orderdate""")
def asof_orders(spark, folder):
    """The as-of join on a keyed fact table: the latest order of the same group at shipping time."""
    items = views.table(spark, folder, "lineitem").select(
        *views.LINEITEM_KEY, "l_shipdate", (F.col("l_suppkey") % 100).alias("grp"))
    orders = views.table(spark, folder, "orders").groupBy((F.col("o_custkey") % 100).alias("grp"), "o_orderdate").agg(
        F.max("o_totalprice").alias("o_totalprice"))
    return failure.asof(items, orders, "l_shipdate", "o_orderdate", ["o_totalprice"], by=["grp"],
                        expected_rows=items.count() + orders.count()).drop("grp")


@query("alerts_without_degradation", f"""WITH {_EV}, a AS (SELECT window_start, min(window_end) AS window_end FROM ev WHERE alert AND method <> 'cusum' GROUP BY 1),
m AS (SELECT window_start + to_microseconds(CAST(floor((epoch_us(window_end) - epoch_us(window_start)) / 2) AS BIGINT)) AS midpoint FROM a),
u AS (SELECT * FROM w WHERE recall IS NOT NULL),
j AS (SELECT CASE WHEN epoch_us(midpoint) - epoch_us(bucket) <= 86400000000 THEN recall END AS recall FROM m ASOF LEFT JOIN u ON m.midpoint >= u.bucket)
SELECT CAST(count(*) AS BIGINT) AS alerts, CAST(count(*) FILTER (recall < 0.5) AS BIGINT) AS in_degraded_windows, CAST(count(*) FILTER (recall >= 0.5) AS BIGINT) AS without_degradation,
CAST(count(*) FILTER (recall IS NULL) AS BIGINT) AS unmatched_alerts, (SELECT CAST(count(*) AS BIGINT) FROM u) AS model_windows,
(SELECT CAST(count(*) AS BIGINT) FROM u WHERE recall < 0.5) AS degraded_windows, count(*) FILTER (recall IS NULL) < count(*) AS matched FROM j""")
def alerts_without_degradation(spark, folder):
    table = metrics.window_metrics(forward(spark, folder), min_rows=50)
    return failure.alerts_without_degradation(events(spark, folder), table)


@query("failure_bundle")
def failure_bundle(spark, folder):
    """One nested row per model; its parts have their own SQL above."""
    out = failure.failure_bundle(forward(spark, folder), events(spark, folder), 0.05, 0.05)
    return out.select("windows_analyzed", F.to_json(F.struct(*[c for c in out.columns if c != "windows_analyzed"])).alias("analysis"))


@query("failure_volumes", f"""WITH {PRED}, p AS (SELECT * FROM pr WHERE period = 'forward')
SELECT protocol AS model, 'run-1' AS run, CAST(count(*) FILTER (false_positive = 1) AS BIGINT) AS false_positives, round(avg(CASE WHEN false_positive = 1 THEN y_score END), 9) AS fp_mean_score,
CAST(count(*) FILTER (false_negative = 1) AS BIGINT) AS false_negatives, round(avg(CASE WHEN false_negative = 1 THEN y_score END), 9) AS fn_mean_score,
CAST(count(*) FILTER (false_negative = 1 AND y_score > 0.8) AS BIGINT) AS high_confidence_misses FROM p GROUP BY protocol""")
def failure_volumes(spark, folder):
    """Error volumes read back from stored failure documents, one for each protocol's predictions."""
    y = F.col("y_score")

    def errors(flag: str):
        hit = F.col(flag) == 1
        return F.struct(F.count_if(hit).alias("count"), F.avg(F.when(hit, y)).alias("mean_score"),
                        F.count_if(hit & (y > 0.8)).alias("high_confidence_misses"))
    documents = forward(spark, folder).groupBy(F.col("protocol").alias("model")).agg(
        F.lit("run-1").alias("run"), errors("false_positive").alias("false_positives"), errors("false_negative").alias("false_negatives"))
    root = monitor.scratch(spark, "documents")
    path = sinks.write_document(documents, root, "run-1", "failure_analysis")
    kinds = documents.schema
    return _rounded(audit.failure_volumes(spark.read.schema(kinds).json(path)), ["fp_mean_score", "fn_mean_score"])
