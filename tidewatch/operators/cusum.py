"""Windowed two-sided CUSUM from running sums, and its calibrated null thresholds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import micros
from tidewatch.operators.running import number_rows, reflected_sums
from tidewatch.schema import TIME
from tidewatch.session import materialize, rows_per_slice, run_once

CHUNK = 100_000


def sequence_means(windows: DataFrame, features: Sequence[str], tiebreak: Sequence[str], block: int,
                   expected_rows: int, ts: str = TIME, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(k, feature, step, x): each window as a time-ordered sequence of block means.

    Windows under two blocks keep single rows; an incomplete last block is left out. Rows
    are numbered once per window, and all features share the numbering. ``derive`` adds features that follow from other
    columns of the same row; it runs on numbered rows, so only what it reads is shuffled. The means of large inputs are stored.
    """
    narrow = windows
    if derive is None:
        narrow = windows.select("k", ts, *tiebreak, *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    numbered = number_rows(narrow, ["k"], [ts, *tiebreak], "_rn", expected_rows, size="n_window", place=micros(F.col(ts)))
    if derive is not None:
        numbered = derive(numbered).select("k", "_rn", "n_window", *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    size = F.when(F.col("n_window") >= 2 * block, F.lit(block)).otherwise(F.lit(1)) if block > 1 else F.lit(1)
    tagged = (numbered.withColumn("_size", size)
              .withColumn("step", F.floor(F.col("_rn") / F.col("_size")))
              .where(F.col("step") < F.floor(F.col("n_window") / F.col("_size"))))
    means = tagged.groupBy("k", "step", "n_window").agg(*[F.avg(f"_{f}").alias(f) for f in features])
    if expected_rows > rows_per_slice(windows.sparkSession):
        means = materialize(run_once(means))
    return means.unpivot(["k", "step", "n_window"], list(features), "feature", "x")


def longest_sequence(windows: DataFrame, block: int) -> int:
    """Steps of the longest sequence that ``sequence_means`` makes of any window."""
    rows = windows.groupBy("k").agg(F.count("*").alias("n"))
    return rows.agg(F.max(sequence_length(F.col("n"), block))).first()[0] or 0


def cusum_path(sequence: DataFrame, moments: DataFrame, drift: float = 0.5, warmup: int = 20,
               longest: int | None = None) -> DataFrame:
    """Running CUSUM value at every step past the warm-up.

    The recursion max(0, s + z - drift) is a reflected sum, so it needs no loop. Sequences that are longer than a task should
    sort, or may be (``longest`` is the number of steps of the longest one), are cut into chunks of steps. Chunks read the
    sequences three times, whole ones once.
    """
    z = (F.col("x") - F.col("mu")) / F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    whole = longest is not None and longest <= rows_per_slice(sequence.sparkSession)
    steps = sequence.where(F.col("step") >= warmup).withColumn("_chunk", F.floor(F.col("step") / CHUNK))
    # One value a step is shuffled; both directions follow from it.
    steps = steps.repartition("k", "feature") if whole else steps.repartition("k", "feature", "_chunk")
    steps = steps.join(F.broadcast(moments.select("feature", "mu", "sigma")), "feature").withColumns({"up": z - drift, "down": -z - drift})
    paths = reflected_sums(steps, ["k", "feature"], ["step"], {"c_up": "up", "c_down": "down"}, None if whole else "_chunk")
    return paths.withColumn("cusum", F.greatest("c_up", "c_down"))


def cusum_peaks(path: DataFrame, threshold: str) -> DataFrame:
    """(k, feature) -> peak and the first step whose value passes the threshold column."""
    return path.groupBy("k", "feature").agg(
        F.max("cusum").alias("cusum"),
        F.min(F.when(F.col("cusum") > F.col(threshold), F.col("step"))).alias("first_alarm"))


def sequence_length(n_window, block: int):
    return F.when(n_window >= 2 * block, F.floor(n_window / F.lit(block))).otherwise(n_window) \
        if block > 1 else n_window


def null_thresholds(lengths: DataFrame, drift: float = 0.5, warmup: int = 20, rate: float = 0.01,
                    trials: int = 200, seed: int = 0, same_warmup: bool = True) -> DataFrame:
    """(n_sequence, threshold): high quantile of the CUSUM peak of pure noise.

    One task per distinct length. ``same_warmup=False`` shortens the warm-up to a quarter
    of the sequence in the null only, which makes short windows nearly unable to alarm.
    """
    def simulate(batches):
        for batch in batches:
            out = []
            for length in batch["n_sequence"]:
                skip = warmup if same_warmup else min(warmup, max(int(length) // 4, 1))
                rng = np.random.default_rng(seed)
                peaks = np.empty(trials)
                for trial in range(trials):
                    z = rng.normal(0.0, 1.0, max(int(length), skip + 1))[skip:]
                    peak = 0.0
                    for side in (z - drift, -z - drift):
                        path = np.cumsum(side)
                        low = np.minimum(np.minimum.accumulate(path), 0.0)
                        peak = max(peak, float(np.max(path - low)))
                    peaks[trial] = peak
                out.append(float(np.quantile(peaks, 1.0 - rate)))
            yield pd.DataFrame({"n_sequence": batch["n_sequence"], "threshold": out})

    spread = lengths.select(F.col("n_sequence").cast("long")).distinct().repartition("n_sequence")
    return spread.mapInPandas(simulate, "n_sequence long, threshold double")


def effects(windows: DataFrame, features: Sequence[str], moments: DataFrame) -> DataFrame:
    """(k, feature) -> standardised mean shift of the whole window."""
    means = (windows.groupBy("k").agg(F.count("*").alias("n_window"),
                                      *[F.avg(F.col(f).cast("double")).alias(f) for f in features])
             .unpivot(["k", "n_window"], list(features), "feature", "mean"))
    sigma = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)
    return means.join(F.broadcast(moments), "feature").select(
        "k", "feature", "n_window", "n_reference",
        (F.abs(F.col("mean") - F.col("mu")) / sigma).alias("effect"))
