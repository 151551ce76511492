"""Structured Streaming drift and quality monitors against a frozen reference.

Every function takes a streaming table of flows. Watermarks need a zoned timestamp, so the
time column is cast (sessions run in UTC).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import psi as ps
from tidewatch.operators.twosample import melt
from tidewatch.schema import TIME


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for stream output and progress, under the shared checkpoint folder."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files, with the schema of the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def timed(stream: DataFrame, delay: str, ts: str = TIME) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_end(stream: DataFrame, sink: str, progress: str, partition_by: Sequence[str] = ()) -> None:
    """Process all available input into Parquet and stop."""
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).outputMode("append").start().awaitTermination()


def window_bins(stream: DataFrame, edges: dict[str, list[float]], bins: int, window: str, slide: str | None = None,
                delay: str = "10 minutes") -> DataFrame:
    """Rows per (window, feature) and quantile bin; each window appears once, complete.

    State is a few counters per window and feature, however many rows arrive.
    """
    spark = stream.sparkSession
    table = spark.createDataFrame(list(edges.items()), "feature string, edges array<double>")
    long = melt(timed(stream, delay), list(edges), [TIME])
    frame = F.window(TIME, window, slide) if slide else F.window(TIME, window)
    counted = ps.bin_table(long.withColumn("w", frame), table, ["w", "feature"], bins)
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature",
                          *[f"b{i}" for i in range(bins)], "n")


def psi_writer(reference_bins: DataFrame, edges: dict[str, list[float]], sink: str, threshold: float = 0.2,
               min_samples: int = 0, bins: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: PSI of every window that closed in the batch.

    A batch replaces its own output folder, so a replayed batch leaves no second copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = spark.createDataFrame(list(edges.items()), "feature string, edges array<double>")
        psi = ps.psi(reference_bins, batch, table, ["window_start", "window_end"], bins)
        (psi.where(F.col("n_window") >= min_samples)
         .select("window_start", "window_end", "feature", "psi", (F.col("psi") > threshold).alias("alert"),
                 "n_reference", "n_window")
         .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"))
    return write


def psi_stream(stream: DataFrame, reference_bins: DataFrame, edges: dict[str, list[float]], sink: str, progress: str,
               window: str, slide: str | None = None, bins: int = 10, delay: str = "10 minutes",
               threshold: float = 0.2, min_samples: int = 0):
    """Start a PSI monitor over the available input and return the query."""
    counts = window_bins(stream, edges, bins, window, slide, delay)
    return (counts.writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True)
            .foreachBatch(psi_writer(reference_bins, edges, sink, threshold, min_samples, bins)).start())


def window_quality(scored: DataFrame, threshold: float, window: str, min_rows: int = 0,
                   delay: str = "10 minutes") -> DataFrame:
    """Recall, FPR and error counts per window of a scored stream (y_true, y_score)."""
    y, hit = F.col("y_true"), F.col("y_score") >= threshold
    out = timed(scored, delay).groupBy(F.window(TIME, window).alias("w")).agg(
        F.count("*").alias("row_count"), F.sum(y).cast("long").alias("attacks"),
        F.try_divide(F.count_if((y == 1) & hit), F.count_if(y == 1)).alias("recall"),
        F.try_divide(F.count_if((y == 0) & hit), F.count_if(y == 0)).alias("fpr"),
        F.avg("y_score").alias("mean_score"),
        F.count_if((y == 0) & hit).alias("false_positives"), F.count_if((y == 1) & ~hit).alias("false_negatives"))
    out = out.where(F.col("row_count") >= min_rows) if min_rows else out
    return out.select(F.col("w.start").alias("bucket"), *[c for c in out.columns if c != "w"])


def reference_moments(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, anchor, mu, sigma, n_reference) of a frozen reference; mu is relative to anchor, the least value.

    Differences from a value of the reference itself are exact where values lie close to each other,
    however far from 0 they are.
    """
    long = melt(reference, features)
    anchors = long.groupBy("feature").agg(F.min("value").alias("anchor"))
    apart = long.join(F.broadcast(anchors), "feature")
    sigma = F.stddev_pop(F.col("value") - F.col("anchor"))
    return apart.groupBy("feature").agg(
        F.first("anchor").alias("anchor"), F.avg(F.col("value") - F.col("anchor")).alias("mu"),
        F.when(sigma > 0, sigma).otherwise(1.0).alias("sigma"), F.count("*").alias("n_reference"))


def mean_shift(stream: DataFrame, moments: DataFrame, window: str, slide: str | None = None, threshold: float = 0.5,
               min_samples: int = 0, delay: str = "10 minutes") -> DataFrame:
    """Shift of mean and spread per closed (window, feature) against ``reference_moments``.

    State is the mergeable moments of a window and feature (count, mean and squared deviations from it),
    kept relative to the anchor, so they lose no digits far from 0. ``effect_size`` is the distance of the means in
    reference deviations and alerts above ``threshold``; ``spread`` is the ratio of deviations.
    """
    frame = F.window(TIME, window, slide) if slide else F.window(TIME, window)
    features = [r.feature for r in moments.select("feature").collect()]
    long = melt(timed(stream, delay), features, [TIME]).join(F.broadcast(moments), "feature")
    apart = F.col("value") - F.col("anchor")
    out = long.groupBy(frame.alias("w"), "feature", "anchor", "mu", "sigma", "n_reference").agg(
        F.count("*").alias("n_window"), F.avg(apart).alias("mean"), F.var_pop(apart).alias("variance"))
    effect = F.abs(F.col("mean") - F.col("mu")) / F.col("sigma")
    out = out.where(F.col("n_window") >= min_samples) if min_samples else out
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature",
                      (F.col("mean") - F.col("mu")).alias("mean_shift"), effect.alias("effect_size"),
                      (F.sqrt("variance") / F.col("sigma")).alias("spread"), (effect > threshold).alias("alert"),
                      "n_reference", "n_window")


def feed(rows: DataFrame, folder: str, starts: Sequence[str], ts: str = TIME) -> None:
    """Append a table to a stream's input folder in time order, one file for each step from its start to the next.

    Stands for an upstream job that delivers as time passes; steps without rows deliver nothing.
    """
    kind = rows.schema[ts].dataType
    for low, high in zip(starts, [*starts[1:], None]):
        step = rows.where(F.col(ts) >= F.lit(low).cast(kind))
        step = step if high is None else step.where(F.col(ts) < F.lit(high).cast(kind))
        if not step.isEmpty():
            step.coalesce(1).write.mode("append").parquet(folder)
