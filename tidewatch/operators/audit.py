"""Audits and reports over recorded results (model, strategy, period and drift tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.combine import with_each
from tidewatch.operators.shifts import KINDS
from tidewatch.operators.split import period_rank

# What a complete run has to contain.
REQUIRED_MODELS = ["majority", "logistic_regression", "random_forest", "gradient_boosting"]
REQUIRED_STRATEGIES = ["none", "threshold_recalibration", "recent_window_retrain",
                       "rolling_window_retrain", "historical_plus_recent_retrain"]
REQUIRED_METADATA = ["git_commit", "random_seed", "feature_schema_hash", "package_versions",
                     "temporal_split", "dataset"]
REQUIRED_PACKAGES = ["python", "numpy", "pandas", "scikit-learn"]
REQUIRED_ABLATIONS = ["split_mode", "feature_policy", "drift_threshold", "adaptation_window",
                      "telemetry_family", "target_fpr"]
REQUIRED_METRICS = ["precision", "recall", "f1", "roc_auc", "pr_auc", "false_positive_rate", "balanced_accuracy"]
ALLOWED_EMPTY = {"drift_threshold": ["f1", "precision", "recall", "roc_auc", "pr_auc"],
                 "target_fpr": ["false_positive_rate", "roc_auc", "pr_auc"]}
REGISTRY = ["majority", "logistic_regression", "random_forest", "gradient_boosting", "neural_network"]
BAD_TEXT = ["nan", "inf", "-inf", "+inf", "infinity", "-infinity"]


def missing_values(actual: DataFrame, by: Sequence[str], column: str, expected: Sequence[str]) -> DataFrame:
    """Expected values that a group lacks (anti join of every group's wanted values)."""
    groups = actual.select(*by).distinct()
    wanted = with_each(groups, column, expected)
    return wanted.join(actual.select(*by, column).distinct(), [*by, column], "left_anti")


def _known(requested: DataFrame, column: str, registry: Sequence[str]) -> DataFrame:
    return requested.sparkSession.createDataFrame([(m, i) for i, m in enumerate(registry)], f"{column} string, position int")


def unknown_models(requested: DataFrame, column: str = "model", registry: Sequence[str] = tuple(REGISTRY)) -> DataFrame:
    """Requested models that the registry lacks, each once."""
    return requested.select(column).distinct().join(_known(requested, column, registry), column, "left_anti")


def requested_models(requested: DataFrame, column: str = "model", registry: Sequence[str] = tuple(REGISTRY)) -> DataFrame:
    """Requested models in registry order; an unknown one is an error."""
    unknown = unknown_models(requested, column, registry).limit(20).collect()
    if unknown:
        raise KeyError(f"unknown models {sorted(r[0] for r in unknown)}; known: {list(registry)}")
    known = _known(requested, column, registry)
    return known.join(requested.select(column).distinct(), column, "left_semi")


def bad_cells(text_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """NaN and infinity spellings per column of an all-text table."""
    columns = [c for c in text_table.columns if c not in by]
    flags = {c: F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(BAD_TEXT)) for c in columns}
    counts = text_table.groupBy(*by).agg(*[v.alias(c) for c, v in flags.items()])
    return counts.unpivot(list(by), columns, "column_name", "bad").where(F.col("bad") > 0)


def unexpected_bad_cells(cells: DataFrame, ablation: str = "ablation") -> DataFrame:
    """Bad cells outside the columns an ablation family legitimately leaves empty."""
    allowed = F.lit(False)
    for family, columns in ALLOWED_EMPTY.items():
        allowed = allowed | ((F.col(ablation) == family) & F.col("column_name").isin(columns))
    return cells.where(~allowed)


def _leaves(kind: T.DataType, column: Column, path: Column) -> list[Column]:
    """Arrays of (path, value) for every double below a nested column, built at plan time."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [F.array(F.struct(path.alias("path"), column.cast("double").alias("value")))]
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            out += _leaves(f.dataType, column[f.name], F.concat(path, F.lit(f".{f.name}")))
        return out
    if isinstance(kind, T.ArrayType):
        probe = _leaves(kind.elementType, F.lit(None).cast(kind.elementType), path)
        if not probe:
            return []
        per_item = F.transform(column, lambda x, i: F.flatten(F.array(*_leaves(
            kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        return [F.flatten(per_item)]
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, (T.DoubleType, T.FloatType)):
        return [F.transform(F.map_entries(column), lambda e: F.struct(
            F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"].cast("double").alias("value")))]
    return []


def bad_numbers(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, path, value) of every NaN or infinite double anywhere in nested columns."""
    leaves = []
    for f in df.schema.fields:
        if f.name not in by:
            leaves += _leaves(f.dataType, F.col(f.name), F.lit(f.name))
    filled = [F.coalesce(c, F.array().cast("array<struct<path:string,value:double>>")) for c in leaves]
    rows = df.select(*by, F.inline(F.flatten(F.array(*filled))))
    return rows.where(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))))


def model_table(metrics: DataFrame) -> DataFrame:
    """(run, model): both periods side by side with their differences."""
    def at(period, column):
        return F.max(F.when(F.col("period") == period, F.col(column)))

    wide = metrics.groupBy("run", "model").agg(
        at("backtest", "f1").alias("bt_f1"), at("forward", "f1").alias("fw_f1"),
        at("backtest", "recall").alias("bt_recall"), at("forward", "recall").alias("fw_recall"),
        at("backtest", "false_positive_rate").alias("bt_fpr"), at("forward", "false_positive_rate").alias("fw_fpr"))
    return wide.withColumns({"d_f1": F.col("bt_f1") - F.col("fw_f1"),
                             "d_recall": F.col("bt_recall") - F.col("fw_recall"),
                             "d_fpr": F.col("fw_fpr") - F.col("bt_fpr")})


def model_summary(table: DataFrame) -> DataFrame:
    """Per run: models that lost F1, the largest loss and the best forward model."""
    loss, best = F.coalesce("d_f1", F.lit(0.0)), F.coalesce("fw_f1", F.lit(0.0))
    return table.groupBy("run").agg(
        F.count("*").alias("models"), F.count_if(F.col("d_f1") > 0).alias("degraded"),
        F.max(F.struct(loss.alias("v"), "model")).alias("_w"), F.max(F.struct(best.alias("v"), "model")).alias("_b"),
    ).select("run", "models", "degraded", F.col("_w.model").alias("largest_loss_model"),
             F.col("_w.v").alias("largest_loss"), F.col("_b.model").alias("best_model"), F.col("_b.v").alias("best_forward_f1"))


def with_calibration(table: DataFrame, calibration: DataFrame) -> DataFrame:
    """Model table with the forward Brier score and calibration error, if recorded."""
    return table.join(calibration.select("run", "model", "brier", "ece"), ["run", "model"], "left")


def run_index(metadata: DataFrame, table: DataFrame, strategies: DataFrame, superseded: DataFrame) -> DataFrame:
    """One row per run: status, models, strategies, best forward F1, worst loss.

    ``metadata``: run, kind, finished. ``superseded``: run. Strategies are counted, not keys.
    """
    best = table.groupBy("run").agg(F.max("fw_f1").alias("best_forward_f1"), F.max("d_f1").alias("worst_f1_degradation"),
                                    F.array_join(F.array_sort(F.collect_set("model")), ";").alias("models"))
    named = strategies.groupBy("run").agg(F.count_distinct("strategy").alias("strategies"))
    out = (metadata.join(best, "run", "left").join(named, "run", "left")
           .join(superseded.select("run", F.lit(True).alias("_s")), "run", "left"))
    status = F.when(F.col("_s"), "superseded").when(F.col("finished"), "complete").otherwise("incomplete")
    return out.withColumn("status", status).drop("_s").na.fill(0, ["strategies"])


def strategy_gains(strategies: DataFrame, backtest: DataFrame | None = None,
                   columns: Sequence[str] = ("f1", "recall", "precision", "false_positive_rate")) -> DataFrame:
    """Gain over the unadapted row of the same model, and the share of the loss recovered."""
    w = Window.partitionBy("run", "model")
    out = strategies
    if backtest is not None:
        out = out.join(backtest.select("run", "model", *[F.col(c).alias(f"_back_{c}") for c in columns]),
                       ["run", "model"], "left")
    made = {}
    for c in columns:
        before = F.max(F.when(F.col("strategy") == "none", F.col(c))).over(w)
        made[f"{c}_gain"] = F.col(c) - before
        if backtest is not None:
            lost = F.col(f"_back_{c}") - before
            made[f"{c}_recovery_pct"] = F.when(lost != 0, 100.0 * (F.col(c) - before) / lost)
    return out.withColumns(made).drop(*[f"_back_{c}" for c in columns])


def aliased_strategies(strategies: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Models whose recent and rolling strategies scored the same, which hints at a mix-up."""
    def at(name):
        return F.max(F.when(F.col("strategy") == name, F.col("f1")))

    pair = strategies.groupBy("run", "model").agg(
        at("recent_window_retrain").alias("recent_f1"), at("rolling_window_retrain").alias("rolling_f1"))
    return pair.withColumn("identical", F.coalesce(
        F.abs(F.col("recent_f1") - F.col("rolling_f1")) < tolerance, F.lit(False)))


def reproduction_errors(strategies: DataFrame, metrics: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Unadapted strategy rows that do not reproduce the model's forward values."""
    forward = metrics.where(F.col("period") == "forward").select(
        "run", "model", F.col("f1").alias("forward_f1"), F.col("model_threshold"))
    none = strategies.where(F.col("strategy") == "none").select("run", "model", "f1", "strategy_threshold")
    both = none.join(forward, ["run", "model"])
    return both.where((F.abs(F.col("f1") - F.col("forward_f1")) > tolerance)
                      | ~F.col("strategy_threshold").eqNullSafe(F.col("model_threshold")))


def gain_directions(gains: DataFrame, by: str = "dataset", strategy: str = "rolling_window_retrain") -> DataFrame:
    """Per dataset: models a strategy helped and hurt against their own unadapted score."""
    rows = gains.where((F.col("strategy") == strategy) & (F.col("model") != "majority"))
    return rows.groupBy(by).agg(F.count_if(F.col("f1_gain") > 0).alias("helped"),
                                F.count_if(F.col("f1_gain") < 0).alias("hurt"),
                                F.round(F.avg("f1_gain"), 9).alias("mean_gain"))


def period_problems(periods: DataFrame) -> DataFrame:
    """Inverted, overlapping or non-adding periods of stored splits.

    ``periods``: run, period, start_ts, end_ts, row_count, rows_total.
    """
    order = Window.partitionBy("run").orderBy("_rank")
    whole = Window.partitionBy("run")
    ranked = periods.withColumn("_rank", period_rank()).withColumns({
        "previous_end": F.lag("end_ts").over(order), "_sum": F.sum("row_count").over(whole)})
    checks = F.array(
        F.when(F.col("start_ts") > F.col("end_ts"), F.lit("starts after it ends")),
        F.when(F.col("start_ts") < F.col("previous_end"), F.lit("overlaps the previous period")),
        F.when((F.col("_rank") == 1) & (F.col("_sum") != F.col("rows_total")), F.lit("period rows do not add up")))
    return ranked.select("run", "period", F.explode(F.array_compact(checks)).alias("problem"))


def latest_runs(runs: DataFrame, by: Sequence[str] = ("kind", "dataset")) -> DataFrame:
    """The newest finished run per kind and dataset, generated data last."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("is_synthetic").asc(), F.col("run").desc()))
    return runs.where("finished").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def best_rows(df: DataFrame, by: Sequence[str], metric: str, keep: Sequence[str]) -> DataFrame:
    """The row with the highest metric per group, with its parameters."""
    return df.groupBy(*by).agg(F.max(F.struct(metric, *keep)).alias("_b")).select(
        *by, *[F.col(f"_b.{c}").alias(c) for c in (metric, *keep)])


def shift_families(records: DataFrame) -> DataFrame:
    """Per shift kind: settings, verified ones, alerts, mean, best and worst degradation."""
    d = F.col("f1_degradation")
    return records.groupBy("shift").agg(
        F.count("*").alias("settings"), F.count_if("realized_verified").alias("verified"),
        F.sum("drift_alerts").cast("long").alias("alerts"), F.round(F.avg(d), 9).alias("mean_degradation"),
        F.round(F.max(d), 9).alias("max_degradation"), F.round(F.min(d), 9).alias("min_degradation"))


def shift_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("f1_degradation") > 0).alias("degraded"),
        F.count_if(F.col("adapt_recovery") > 0).alias("recovered"))


def ablation_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("run").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.coalesce(F.col("note").startswith("failed"), F.lit(False))).alias("failed"))


def shift_problems(records: DataFrame) -> DataFrame:
    """(run, problem) of shift runs: absent kinds, unmeasured rows, shifts that moved nothing."""
    absent = missing_values(records, ["run"], "shift", KINDS).select(
        "run", F.concat(F.lit("shift family did not run: "), "shift").alias("problem"))
    label = F.concat_ws("/", "model", "shift", F.col("magnitude").cast("string"))
    flags = F.array(
        F.when(F.col("realized_verified").isNull(), F.concat(label, F.lit(": realized_verified is not recorded"))),
        F.when(F.col("realized_max_abs_cohens_d").isNull(), F.concat(label, F.lit(": effect is not recorded"))),
        F.when(~F.col("realized_verified"), F.concat(label, F.lit(": nothing measurable moved"))))
    return absent.unionByName(records.select("run", F.explode(F.array_compact(flags)).alias("problem")))


def ablation_problems(records: DataFrame) -> DataFrame:
    """(run, problem) of ablation runs: absent families and failed rows."""
    absent = missing_values(records, ["run"], "ablation", REQUIRED_ABLATIONS).select(
        "run", F.concat(F.lit("ablation family did not run: "), "ablation").alias("problem"))
    failed = records.where(F.lower(F.coalesce(F.col("status"), F.lit(""))).isin("failed", "error")).groupBy("run").agg(
        F.concat(F.count("*").cast("string"), F.lit(" ablation rows failed")).alias("problem"))
    return absent.unionByName(failed)


def temporal_problems(metadata: DataFrame, metrics: DataFrame, strategies: DataFrame, drift_rows: DataFrame,
                      calibration: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(run, problem) of temporal runs: incomplete metadata, metrics, models, strategies, drift.

    ``drift_rows``: run, n. A run without an entry there measured no drift.
    """
    problems = []

    def add(rows: DataFrame, text: Column) -> None:
        problems.append(rows.select("run", text.alias("problem")))

    empty = F.array(*[
        F.when(F.col(c).isNull() if c in ("random_seed",) else _is_empty(metadata.schema[c].dataType, c), F.lit(c))
        for c in REQUIRED_METADATA])
    add(metadata.select("run", F.explode(F.array_compact(empty)).alias("c")),
        F.concat(F.lit("metadata."), "c", F.lit(" is missing or empty")))
    version = F.array(*[F.when(F.coalesce(F.col("package_versions")[p], F.lit("")).isin("", "not installed"), F.lit(p))
                        for p in REQUIRED_PACKAGES])
    add(metadata.select("run", F.explode(F.array_compact(version)).alias("c")),
        F.concat(F.lit("package version of "), "c", F.lit(" is missing")))
    bounds = F.array(*[F.when(F.col("temporal_split")[f"{p}_period"].isNull(), F.lit(p))
                       for p in ("train", "validation", "backtest", "forward")])
    add(metadata.select("run", F.explode(F.array_compact(bounds)).alias("c")),
        F.concat(F.lit("temporal_split."), "c", F.lit("_period is missing")))
    add(metadata.where(F.col("superseded").isNotNull()), F.lit("run is marked superseded"))
    add(metadata.join(metrics, "run", "left_anti"), F.lit("no model metrics: this run never finished"))
    add(missing_values(metrics, ["run", "model"], "period", ["backtest", "forward"]),
        F.concat_ws(".", "model", F.concat("period", F.lit(" is missing"))))
    gaps = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_METRICS])
    add(metrics.select("run", "model", "period", F.explode(F.array_compact(gaps)).alias("c")),
        F.concat_ws(".", "model", "period", F.concat("c", F.lit(" is missing"))))
    for table in (metrics, strategies.drop("recovery")):
        add(bad_numbers(table, [c for c in ("run", "model", "period", "strategy") if c in table.columns]),
            F.concat("model", F.lit(": "), "path", F.lit(" is not a finite number")))
    add(metadata.join(drift_rows.where("n > 0"), "run", "left_anti"), F.lit("the drift stage measured nothing"))
    if calibration is not None:
        add(metrics.select("run", "model").distinct().join(calibration.na.drop(subset=["brier", "ece"]), ["run", "model"], "left_anti"),
            F.concat("model", F.lit(": calibration is missing")))
    if strict:
        add(missing_values(metrics, ["run"], "model", REQUIRED_MODELS),
            F.concat(F.lit("required model missing: "), "model"))
        add(missing_values(strategies, ["run", "model"], "strategy", REQUIRED_STRATEGIES),
            F.concat("model", F.lit(": strategy missing: "), "strategy"))
    out = problems[0]
    for part in problems[1:]:
        out = out.unionByName(part)
    return out


def _is_empty(kind: T.DataType, column: str) -> Column:
    if isinstance(kind, T.MapType):
        return F.col(column).isNull() | (F.size(column) == 0)
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def identity_problems(metadata: DataFrame) -> DataFrame:
    """(run, problem): wrong or repeated ids, unfinished status, unknown commits."""
    copies = F.count("*").over(Window.partitionBy("experiment_id"))
    checks = F.array(
        F.when(F.col("experiment_id") != F.col("run"), F.lit("recorded id differs from the folder")),
        F.when(F.col("experiment_id").isNotNull() & (F.col("_copies") > 1), F.lit("duplicate experiment id")),
        F.when(~F.coalesce(F.col("status"), F.lit("complete")).isin("complete", "finished"), F.lit("status is not complete")),
        F.when(F.coalesce(F.col("git_commit"), F.lit("")).isin("", "unknown", "None"), F.lit("no commit recorded")))
    return metadata.withColumn("_copies", copies).select("run", F.explode(F.array_compact(checks)).alias("problem"))


def comparison_table(rows: DataFrame, sets: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Static model comparison in a fixed order of feature sets and models."""
    def position(column, order):
        return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))

    return rows.withColumns({"set_position": position("feature_set", sets),
                             "model_position": position("model", models)}).orderBy(
        "set_position", "model_position")


def set_differences(rows: DataFrame, first: str, second: str,
                    columns: Sequence[str] = ("f1_score", "false_positive_rate")) -> DataFrame:
    """Per model: a metric on one feature set minus the same metric on another."""
    aggs = []
    for c in columns:
        a = F.max(F.when(F.col("feature_set") == first, F.col(c)))
        b = F.max(F.when(F.col("feature_set") == second, F.col(c)))
        aggs.append((a - b).alias(f"{c}_difference"))
    return rows.groupBy("model").agg(*aggs)


def union_records(tables: Sequence[DataFrame]) -> DataFrame:
    """Result tables with different columns under one another."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def operating_points(metrics: DataFrame) -> DataFrame:
    return metrics.select("run", "model", "period", "recall", "false_positive_rate", "f1")


def failure_volumes(documents: DataFrame) -> DataFrame:
    """Error counts and mean error scores from stored failure documents."""
    return documents.select(
        "run", "model", F.col("false_positives.count").alias("false_positives"),
        F.col("false_positives.mean_score").alias("fp_mean_score"),
        F.col("false_negatives.count").alias("false_negatives"),
        F.col("false_negatives.mean_score").alias("fn_mean_score"),
        F.col("false_negatives.high_confidence_misses").alias("high_confidence_misses"))
