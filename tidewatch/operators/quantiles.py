"""Exact quantiles from value counts, without a value map in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.running import cut_slices, running_sums


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n): the map-side combined form every ordered statistic starts from."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def pick_quantiles(ranked: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, p, q) by linear interpolation between neighbouring ranks.

    ``ranked`` holds ``value``, its count ``n``, the running count ``cum`` and the group
    size ``total``.
    """
    first = F.col("cum") - F.col("n")

    def near(p):
        position = (F.col("total") - 1) * p
        return (F.ceil(position) >= first) & (F.floor(position) < F.col("cum"))

    # Keep the few rows that hold a wanted rank, then repeat only those per probability.
    some = near(F.lit(float(probs[0])))
    for p in probs[1:]:
        some = some | near(F.lit(float(p)))
    frame = ranked.where(some).withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    position = (F.col("total") - 1) * F.col("_p")
    low, high = F.floor(position), F.ceil(position)
    holds_low = (low >= first) & (low < F.col("cum"))
    holds_high = (high >= first) & (high < F.col("cum"))
    picked = (frame.where(holds_low | holds_high)
              .groupBy(*by, "_p")
              .agg(F.max(F.when(holds_low, F.col(value))).alias("_lo"),
                   F.max(F.when(holds_high, F.col(value))).alias("_hi"),
                   F.first(position - low).alias("_t")))
    step = F.col("_hi") - F.col("_lo")
    mixed = F.when(F.col("_t") >= 0.5, F.col("_hi") - step * (1.0 - F.col("_t"))).otherwise(
        F.col("_lo") + step * F.col("_t"))
    return picked.select(*by, F.col("_p").alias("p"), mixed.alias("q"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    expected_rows: int, counted: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` within ``by``; ``counted`` input already has ``n``."""
    counts = df if counted else value_counts(df, by, value)
    sliced, slices = cut_slices(counts, [*by, value], expected_rows)
    ranked = running_sums(sliced, by, [value], {"cum": "n"}, {"total": "n"}, slices)
    return pick_quantiles(ranked, by, value, probs)
