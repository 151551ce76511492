"""Reports over the drift table. It has one row per (window, feature, method), so these are small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.drift import METHODS


def drift_summary(events: DataFrame) -> DataFrame:
    """Alerts and comparisons per method, per feature and overall, with the first alert."""
    grouped = events.groupingSets([["method"], ["feature"], []], "method", "feature").agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("comparisons"),
        F.count_if("alert").alias("alerts"),
        F.count_distinct("window_start").alias("windows"),
        F.min(F.when(F.col("alert"), F.col("window_start"))).alias("first_alert"))
    level = F.when(F.col("_g") == 1, "method").when(F.col("_g") == 2, "feature").otherwise("all")
    name = F.coalesce("method", "feature", F.lit("all"))
    return grouped.select(level.alias("level"), name.alias("name"), "windows", "comparisons", "alerts", "first_alert")


def method_table(events: DataFrame) -> DataFrame:
    """Per detector: comparisons, alerts, alert rate, effect sizes, median p-value."""
    size = F.abs("effect_size")
    return events.groupBy("method").agg(
        F.count("*").alias("n"), F.count_if("alert").alias("alerts"),
        F.round(F.avg(F.col("alert").cast("int")), 6).alias("alert_rate"),
        F.round(F.median(size), 6).alias("median_effect"), F.round(F.max(size), 6).alias("max_effect"),
        F.median("p_value").alias("median_p"))


def effect_by_alert(events: DataFrame) -> DataFrame:
    """Median effect size when a detector alerts and when it stays quiet."""
    size = F.abs("effect_size")
    return events.groupBy("method").agg(
        F.round(F.median(F.when(F.col("alert"), size)), 6).alias("alerting"),
        F.round(F.median(F.when(~F.col("alert"), size)), 6).alias("quiet"))


def detector_agreement(events: DataFrame) -> DataFrame:
    """How many (window, feature) pairs all, some or none of the detectors flag."""
    pairs = events.groupBy("window_start", "feature").agg(F.count_if("alert").alias("hits"))
    methods = events.agg(F.count_distinct("method")).scalar()
    return pairs.withColumn("m", methods).agg(
        F.count("*").alias("pairs"), F.count_if(F.col("hits") == F.col("m")).alias("all_agree"),
        F.count_if((F.col("hits") > 0) & (F.col("hits") < F.col("m"))).alias("split"),
        F.count_if(F.col("hits") == 0).alias("none_alerted"))


def alert_rates(events: DataFrame, k: int = 20) -> DataFrame:
    """Alert rate per method and feature, the k first by method and falling rate."""
    rates = events.groupBy("method", "feature").agg(
        F.count_if("alert").alias("alerts"), F.count("*").alias("windows"))
    rates = rates.withColumn("rate", F.round(F.col("alerts") / F.col("windows"), 6))
    return rates.orderBy("method", F.col("rate").desc(), "feature").limit(k)


def alert_timeline(events: DataFrame, k: int = 6) -> DataFrame:
    """Alerts per window for the k features that alert most."""
    counts = events.groupBy("feature", "window_start").agg(F.count_if("alert").alias("alerts"))
    top = (counts.groupBy("feature").agg(F.sum("alerts").alias("_total"))
           .orderBy(F.col("_total").desc(), "feature").limit(k))
    return counts.join(top.select("feature"), "feature", "left_semi")


def detector_comparison(events: DataFrame, order: Sequence[str] = METHODS) -> DataFrame:
    """Alert rate and median effect per detector in a fixed order, unknown detectors last."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    rows = events.groupBy("method").agg(
        F.round(F.avg(F.col("alert").cast("int")), 6).alias("alert_rate"),
        F.round(F.median(F.abs("effect_size")), 6).alias("median_effect"))
    rank = F.row_number().over(Window.orderBy(F.when(position > 0, position).otherwise(999), "method"))
    return rows.select("method", "alert_rate", "median_effect", rank.alias("position"))


def strongest_features(events: DataFrame, k: int = 8) -> DataFrame:
    """Features with the largest median effect among alerting windows."""
    flagged = events.where("alert").groupBy("feature").agg(
        F.median("effect_size").alias("median_effect_size"), F.max("effect_size").alias("max_effect_size"),
        F.count("*").alias("alerting_windows"))
    return flagged.orderBy(F.col("median_effect_size").desc(), "feature").limit(k).select(
        "feature", F.round("median_effect_size", 6).alias("median_effect_size"),
        F.round("max_effect_size", 6).alias("max_effect_size"), "alerting_windows")


def strongest_feature(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The single feature with the largest effect (per group, if any)."""
    best = events.groupBy(*by, "feature").agg(F.max("effect_size").alias("effect"))
    ranked = F.struct("effect", "feature")
    return best.groupBy(*by).agg(F.max(ranked).alias("_b")).select(
        *by, F.col("_b.feature").alias("feature"), F.round("_b.effect", 6).alias("effect_size"))

