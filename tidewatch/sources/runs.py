"""Recorded runs: nested result documents and tables under ``<root>/<run id>/``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RATES = ["precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "balanced_accuracy",
          "roc_auc", "pr_auc", "threshold"]
METRICS = T.StructType([T.StructField(c, T.DoubleType()) for c in _RATES] + [
    T.StructField("rows", T.LongType()), T.StructField("attacks", T.LongType())])
STRATEGY = T.StructType([
    T.StructField("strategy", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("rows_used", T.LongType()), T.StructField("training_seconds", T.DoubleType()),
    T.StructField("refits", T.LongType()), T.StructField("metrics", METRICS),
    T.StructField("recovery", T.MapType(T.StringType(), T.DoubleType()))])
MODEL = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("model", T.StringType()), T.StructField("threshold", T.DoubleType()),
        T.StructField("train_seconds", T.DoubleType()), T.StructField("backtest", METRICS),
        T.StructField("forward", METRICS), T.StructField("f1_degradation", T.DoubleType()),
        T.StructField("recall_degradation", T.DoubleType()), T.StructField("fpr_increase", T.DoubleType())])),
    T.StructField("adaptation", T.StructType([
        T.StructField("history_rows", T.LongType()), T.StructField("strategies", T.ArrayType(STRATEGY))]))])
RUN_METRICS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("split", T.MapType(T.StringType(), T.StringType())),
    T.StructField("drift_summary", T.MapType(T.StringType(), T.StringType())),
    T.StructField("models", T.ArrayType(MODEL))])
RUN_METADATA = T.StructType([
    T.StructField("experiment_id", T.StringType()), T.StructField("created_utc", T.StringType()),
    T.StructField("git_commit", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("feature_schema_hash", T.StringType()),
    T.StructField("random_seed", T.LongType()),
    T.StructField("package_versions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("superseded", T.MapType(T.StringType(), T.StringType())),
    T.StructField("temporal_split", T.MapType(T.StringType(), T.StringType()))])


def run_of_path() -> Column:
    """The run id: the folder a result file lies in."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def documents(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """One named JSON document of every run that has it, with its run id."""
    reader = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True)
    return reader.json(f"{root}/*/{name}").select("*", run_of_path().alias("run"))


def texts(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(run, file, text) of every matching document."""
    return spark.read.option("wholetext", True).text(f"{root}/*/{pattern}").select(
        run_of_path().alias("run"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def tables(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One named CSV of every run, all columns as text (audits look at the raw cells)."""
    return spark.read.option("header", True).csv(f"{root}/*/{name}").select("*", run_of_path().alias("run"))


def run_list(metadata: DataFrame) -> DataFrame:
    return metadata.select("run", "dataset", "git_commit", "created_utc", kind_of("run").alias("kind"))


def kind_of(run: str) -> Column:
    found = F.regexp_extract(F.col(run), "_(temporal|shift|ablation)_", 1)
    return F.when(found == "", "unknown").otherwise(found)


def period_bound(document: Column, end: bool = False) -> Column:
    """Start or end of a period stored as ``[a, b]`` or as ``{start, end}``."""
    as_list = F.get_json_object(document, "$[1]" if end else "$[0]")
    return F.coalesce(as_list, F.get_json_object(document, "$.end" if end else "$.start"))


def model_rows(metrics: DataFrame) -> DataFrame:
    """(run, model, period, metrics...) from the nested run documents."""
    exploded = metrics.select("run", F.explode("models").alias("m"))
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"m.result.{p}").alias("v"))
                        for p in ("backtest", "forward")])
    rows = exploded.select("run", F.coalesce("m.result.model", "m.model").alias("model"),
                           F.col("m.result.threshold").alias("model_threshold"), F.inline(periods))
    return rows.where(F.col("v").isNotNull()).select("run", "model", "model_threshold", "period", "v.*")


def strategy_rows(metrics: DataFrame) -> DataFrame:
    """(run, model, strategy, threshold, metrics...) from the nested run documents."""
    exploded = metrics.select("run", F.explode("models").alias("m"))
    rows = exploded.select("run", F.coalesce("m.result.model", "m.model").alias("model"),
                           F.inline("m.adaptation.strategies"))
    return rows.select("run", "model", "strategy", F.col("threshold").alias("strategy_threshold"),
                       "rows_used", "training_seconds", "refits", "metrics.*", "recovery")


def period_rows(metrics: DataFrame) -> DataFrame:
    """(run, period, start_ts, end_ts, row_count) from the split block of a run document."""
    names = ["train", "validation", "backtest", "forward"]
    entries = F.array(*[F.struct(
        F.lit(p).alias("period"), period_bound(F.col("split")[f"{p}_period"]).alias("start_ts"),
        period_bound(F.col("split")[f"{p}_period"], True).alias("end_ts"),
        F.get_json_object(F.col("split")[f"{p}_count"], "$.rows").cast("long").alias("row_count")) for p in names])
    return metrics.select("run", F.col("split")["rows_total"].cast("long").alias("rows_total"),
                          F.inline(entries)).where(F.col("start_ts").isNotNull())
